"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

Each task cuts its documents into pre-tokens and keeps, for a block of documents, the distinct words and, as a
compressed array of word numbers, the place of every pre-token. The words travel to the bucket of their hash, where a
word that any number of blocks hold is encoded once; its ids travel back to the blocks, where the places turn into id
sequences. Rows that cross the network are one per (block, bucket), so a frequent word costs at most one entry a block.

Nulls count as empty texts. A document without text has no ids. Repeated rows and repeated ids are encoded row by row,
so the result has as many rows as the input; ids may be any long. Other columns of the input are not read. Blocks are
named by what they hold: documents that change while a task runs again (no table of files does) fail the job instead of
mixing blocks.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import block_number, blocks, even_keys, id_and_text, id_list, pack, pack_lists, pack_words, partitions, ragged, unpack, unpack_lists, unpack_words

#: Characters of a block: the larger, the fewer blocks repeat a word.
BLOCK = 16 << 20
PACKED = "block long, bucket int, ids array<string>, counts array<int>, words binary, places binary, owners binary"


def load_ranks(path: str) -> dict[bytes, int]:
    """The token ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def block_name(number: int, pdf: pd.DataFrame) -> int:
    """A block's name holds its rows: a task that runs again over other rows gives other names, so its parts can't be
    taken for those of the first run."""
    h = xxhash.xxh64(seed=number)
    for x in (*pdf["doc_id"], *pdf["text"]):
        h.update(b"\1" + x.encode("utf-8", "surrogatepass") if isinstance(x, str) else b"\0")
    return h.intdigest() >> 1


def cut_blocks(split: Callable[[str], list], keys: list[int], hashed: Callable[[object], int], size: int = BLOCK):
    """Pre-tokens of documents by block: one row with the places, and one for each bucket (named by its key) with the
    words it deals with."""
    buckets = len(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for n, pdf in enumerate(blocks(batches, limit=size)):
            block, number, places, counts = block_name(block_number(n), pdf), {}, [], []
            for text in pdf["text"]:
                found = split(text) if isinstance(text, str) else []
                counts.append(len(found))
                places.append(np.array([number.setdefault(w, len(number)) for w in found], dtype=np.uint32))
            flat = np.concatenate(places) if places else np.zeros(0, np.uint32)
            words = list(number)
            bucket = np.fromiter((hashed(w) % buckets for w in words), np.int64, len(words))
            # Words are numbered by falling count: small numbers compress well. Each bucket has its words in that order.
            by_count = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[by_count] = np.arange(len(words), dtype=np.uint32)
            order = by_count[np.argsort(bucket[by_count], kind="stable")]
            ids = id_list(pdf["doc_id"])
            rows = [(block, keys[zlib.crc32(str(block).encode()) % buckets], ids, counts, None, pack(rank[flat]), pack(bucket[by_count]))]
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(edges)):
                own = [words[i] for i in order[edges[b] : edges[b + 1]]]
                rows.append((block, keys[b], None, None, pack_words([w if isinstance(w, bytes) else w.encode() for w in own]), None, None))
            yield pd.DataFrame(rows, columns=["block", "bucket", "ids", "counts", "words", "places", "owners"])

    return run


def encode(docs: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id", text: str = "text", with_bytes: bool = False, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_tokens, token_ids): each match of `pattern` encoded by the ranks in the file `vocabulary`.

    token_ids holds little-endian unsigned 32-bit integers. The vocabulary (a file of bounded size) is broadcast.
    `with_bytes` decodes the ids in the same pass, as `decode` does, into the column `decoded`.
    A smaller `block` (characters) takes less memory and shuffles more.
    """
    spark = docs.sparkSession
    buckets = partitions(spark)
    ranks = spark.sparkContext.broadcast(load_ranks(vocabulary))
    lookup = byte_lookup(ranks)

    def split(t: str, cache: list = []) -> list[str]:  # noqa: B006  compiled once a worker
        if not cache:
            import regex

            cache.append(regex.compile(pattern))
        return cache[0].findall(t)

    def encode_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        # One pre-token is one match of this pattern, so it isn't cut again.
        encoder = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=ranks.value, special_tokens={})
        known: dict[bytes, bytes] = {}
        for pdf in batches:
            out = []
            for words in pdf["words"]:
                if words is None:
                    out.append(None)
                    continue
                ids = []
                for w in unpack_words(words):
                    if (x := known.get(w)) is None:
                        known[w] = x = array("I", encoder.encode_ordinary(w.decode())).tobytes()
                    ids.append(x)
                lengths = np.fromiter(map(len, ids), np.uint32, len(ids)) // 4
                out.append(pack_lists(lengths, pack(np.frombuffer(b"".join(ids), np.uint32))))
                if len(known) > 1_000_000:  # bounds memory; a word seen again later is encoded again
                    known.clear()
            yield pdf.assign(words=out)

    def reassemble(rows: pd.DataFrame) -> pd.DataFrame:
        heads, parts = rows[rows["places"].notna()], [unpack_lists(x) for x in rows[rows["words"].notna()].sort_values("bucket")["words"]]
        head = heads.iloc[0] if len(heads) == 1 else None
        if head is None or sum(len(n) for n, _ in parts) != len(owners := unpack(head["owners"])):
            raise RuntimeError("the documents changed while they were encoded; store them first")
        places, counts = unpack(head["places"]), np.asarray(head["counts"], dtype=np.int64)
        lengths = np.concatenate([n for n, _ in parts] or [np.zeros(0, np.uint32)]).astype(np.int64)
        table, starts = np.concatenate([unpack(x) for _, x in parts] or [np.zeros(0, np.uint32)]), np.cumsum(lengths) - lengths
        numbers = np.argsort(owners, kind="stable")  # of the words in bucket order
        starts[numbers], lengths[numbers] = starts.copy(), lengths.copy()
        ids, texts, at = [], [], 0
        for n in counts:
            own = places[at : at + n]
            at += n
            x = table[ragged(starts[own], lengths[own])].astype("<u4")
            ids.append(x.tobytes())
            if with_bytes:
                texts.append(lookup(x))
        out = pd.DataFrame({"doc_id": id_list(head["ids"]), "n_tokens": [len(x) // 4 for x in ids], "token_ids": ids})
        return out.assign(decoded=texts) if with_bytes else out

    cut = id_and_text(docs, doc_id, text).mapInPandas(cut_blocks(split, even_keys(spark, buckets), lambda w: zlib.crc32(w.encode()), block), PACKED)
    coded = cut.repartition(buckets, "bucket").mapInPandas(encode_words, PACKED)
    out = coded.groupBy("block").applyInPandas(reassemble, "doc_id string, n_tokens long, token_ids binary" + ", decoded binary" * with_bytes)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def byte_lookup(ranks) -> Callable[[np.ndarray], bytes]:
    """Bytes of ids by the token-byte table, which a worker makes once of the broadcast ranks."""

    def run(ids: np.ndarray, table: list = []) -> bytes:  # noqa: B006
        if not table:
            table.append({v: k for k, v in ranks.value.items()})
        return b"".join(map(table[0].__getitem__, ids.tolist()))

    return run


def decode(encoded: DataFrame, vocabulary: str, ids: str = "token_ids") -> DataFrame:
    """Adds `decoded` (the bytes of the ids in column `ids`) by lookup in the token-byte table, which is broadcast."""
    lookup = byte_lookup(encoded.sparkSession.sparkContext.broadcast(load_ranks(vocabulary)))

    @F.pandas_udf("binary")
    def to_bytes(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else lookup(np.frombuffer(x, "<u4")))

    return encoded.withColumn("decoded", to_bytes(F.col(ids)))


def digest(encoded: DataFrame) -> DataFrame:
    """The ids and the decoded bytes as sha256."""
    return encoded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
