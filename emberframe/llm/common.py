"""Small helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.sources.shared import looked_up, stored  # noqa: F401  used by the operators through this module

#: Text bytes that one block of documents holds, but for a single longer document.
BLOCK_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Limits what one Arrow batch of long texts takes in a Python worker, for this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def sampled(df: DataFrame, n: int, *columns: str) -> DataFrame:
    """About n rows of df (all, if there are no more), by the hash of `columns`: the same rows each time. At most 2n,
    and no task sorts or keeps more than its own share of them."""
    total = df.count()
    if total > n:
        df = df.filter(F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) < int((1 << 40) * n / total))
    return df.limit(2 * n)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under names of our own, so that other columns can't clash."""
    return df.select(*(df[f"`{src}`"].alias(name) for name, src in columns.items()))


def id_and_text(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text), the id as text on its way through Python: pandas makes doubles of integers next to nulls."""
    return pick(df, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))


def id_list(ids) -> list:
    return [x if isinstance(x, str) else None for x in ids]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """n rising integers of which a hash exchange into n partitions puts one in each."""
    ids = spark.range(n * 40 + 400).select(F.col("id").cast("int").alias("id"))
    got = {r["p"]: r["id"] for r in ids.groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).collect()}
    return sorted(got.values()) if len(got) == n else list(range(n))


def block_number(n: int) -> int:
    """Number of this task's n-th block: the same when the task runs again."""
    return (TaskContext.get().partitionId() << 32) | n


def arrow_blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """As `blocks`, over Arrow batches, whose other columns stay as they are."""
    held, size = [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = 0
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                yield pa.Table.from_batches([*held, batch.slice(start, i - start)])
                held, size, start = [], 0, i
            size += n
        held.append(batch.slice(start))
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def blocks(batches: Iterator[pd.DataFrame], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pd.DataFrame]:
    """Regroups a task's batches into blocks of about `limit` characters."""
    held, size = [], 0
    for pdf in batches:
        lengths = pdf[column].str.len().fillna(0).to_numpy(dtype=np.int64)
        start = 0
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                held.append(pdf.iloc[start:i])
                yield pd.concat(held, ignore_index=True)
                held, size, start = [], 0, i
            size += int(n)
        held.append(pdf.iloc[start:])
    if held and sum(map(len, held)):
        yield pd.concat(held, ignore_index=True)


#: First bytes below ONE are values; those below TWO and THREE take one and two more bytes, the last one four.
ONE, TWO, THREE = 176, 240, 255
AT_TWO, AT_THREE = ONE, ONE + ((TWO - ONE) << 8)
AT_RAW = AT_THREE + ((THREE - TWO) << 16)


def pack(a: np.ndarray) -> bytes:
    """Unsigned integers of up to 32 bits, small ones in fewer bytes, all first bytes before all second ones, under zstd."""
    a = np.ascontiguousarray(a, dtype=np.uint32)
    two, three, raw = (a >= AT_TWO) & (a < AT_THREE), (a >= AT_THREE) & (a < AT_RAW), a >= AT_RAW
    first = a.astype(np.uint8)
    first[two] = ONE + ((a[two] - AT_TWO) >> 8)
    first[three] = TWO + ((a[three] - AT_THREE) >> 16)
    first[raw] = THREE
    mid, low = (a[two] - AT_TWO).astype(np.uint8), a[three] - AT_THREE
    body = (first, mid, (low >> 8).astype(np.uint8), low.astype(np.uint8), a[raw])
    return zstandard.ZstdCompressor(level=6).compress(len(a).to_bytes(4, "little") + b"".join(x.tobytes() for x in body))


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n = int.from_bytes(raw[:4].tobytes(), "little")
    first, rest = raw[4 : 4 + n], raw[4 + n :]
    two, three, whole = (first >= ONE) & (first < TWO), (first >= TWO) & (first < THREE), first == THREE
    n2, n3 = int(two.sum()), int(three.sum())
    out = first.astype(np.uint32)
    out[two] = AT_TWO + ((out[two] - ONE) << 8) + rest[:n2]
    out[three] = AT_THREE + ((out[three] - TWO) << 16) + (rest[n2 : n2 + n3].astype(np.uint32) << 8) + rest[n2 + n3 : n2 + 2 * n3]
    out[whole] = np.frombuffer(rest[n2 + 2 * n3 :].tobytes(), np.uint32)
    return out


def pack_words(words: list[bytes]) -> bytes:
    return pack_lists(np.fromiter(map(len, words), np.uint32, len(words)), zstandard.ZstdCompressor(level=3).compress(b"".join(words)))


def unpack_words(data: bytes) -> list[bytes]:
    lengths, body = unpack_lists(data)
    raw = zstandard.ZstdDecompressor().decompress(body)
    out, a = [], 0
    for b in np.cumsum(lengths, dtype=np.int64).tolist():
        out.append(raw[a:b])
        a = b
    return out


def pack_lists(lengths: np.ndarray, body: bytes) -> bytes:
    """Lengths of lists before their packed contents."""
    head = pack(lengths)
    return len(head).to_bytes(4, "little") + head + body


def unpack_lists(data: bytes) -> tuple[np.ndarray, bytes]:
    n = 4 + int.from_bytes(data[:4], "little")
    return unpack(data[4:n]), data[n:]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of the slices [starts, starts + lengths), one after another."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def crc_mod(column: str, m: int):
    """crc32 of the id as text modulo m; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % m
