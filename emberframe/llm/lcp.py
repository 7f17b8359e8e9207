"""Document fingerprints by locally consistent parsing.

A text is parsed bottom up. On each level, runs of one name become a single element; then deterministic coin tossing gives
every element a label that depends on it and a few elements before it: first the lowest bit in which it differs from its
left neighbour, with the bit's own value, then the same again over labels, until fewer than eight labels are left and
neighbours still differ. Elements whose label is larger than both neighbours' start a phrase. A phrase's name is a hash of
its elements' names, so names need no dictionary, and equal substrings get equal phrases and names wherever they
stand, but for a few elements at their ends. Phrases of one level are the elements of the next; they have about three
elements each. Levels end when every text is one phrase.

A text's signatures are the names of its phrases from its lowest level up: level 3 (about 25 characters) for long texts,
lower ones for texts under SHORT characters, which have few phrases. The fingerprint holds the SKETCH smallest of the different
signatures, 32 bits each, as hexadecimal digits, so equal texts have equal fingerprints. The likeness of two fingerprints is
the share of the smallest SKETCH of their union that both hold: an estimate of how many of their signatures they share.

Nulls count as empty texts. An empty text has an empty fingerprint; two empty ones have likeness 1. Rows that repeat an
id or a text count each. Other columns are not read. A task parses texts in groups of about GROUP characters; a longer
text is a group of its own, and takes some 60 bytes of memory a character.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import even_keys, id_list, partitions, pick

SKETCH, GROUP = 64, 1 << 19
#: Texts of fewer characters than SHORT[i] use the phrases from level i up; all others those from level len(SHORT) up.
SHORT = (24, 96, 400)
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes of 64-bit numbers."""
    x = x * _MIX
    x ^= x >> np.uint64(32)
    x *= _STEP
    x ^= x >> np.uint64(29)
    return x


def _toss(before: int, now: int) -> int:
    """Label of a number after another one: the lowest bit that differs, and its value."""
    low = (before ^ now) & -(before ^ now)
    return 0 if not low else 2 * (low.bit_length() - 1) + bool(now & low)


#: From two labels under 64 to one under 12, and from three of those to one under 6 or so.
_SECOND = np.array([[_toss(a, b) for b in range(64)] for a in range(64)], np.uint8).ravel()
_FOURTH = np.array([[[_toss(_toss(a, b), _toss(b, c)) for c in range(16)] for b in range(16)] for a in range(16)], np.uint8).ravel()


def _labels(names: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Small labels by coin tossing; the first elements of each text (at `starts`) see zeros before them."""
    x = np.empty_like(names)
    x[0], x[1:] = 0, names[:-1]
    x[starts] = 0
    x ^= names
    x &= -x
    at = x.astype(np.float32).view(np.uint32)  # a power of two: its exponent is the bit's number
    at >>= np.uint32(23)
    at -= np.uint32(127)
    own = ((names & x) != 0).astype(np.uint8)
    first = (at.astype(np.uint8) * np.uint8(2) + own) & np.uint8(63)

    def shifted(a: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(len(a), np.uint16)
        out[n:] = a[:-n] if n < len(a) else 0
        for i in range(n):
            out[np.minimum(starts + i, len(a) - 1)] = 0
        return out

    second = _SECOND[(shifted(first, 1) << np.uint16(6)) | first]
    return _FOURTH[(shifted(second, 2) << np.uint16(8)) | (shifted(second, 1) << np.uint16(4)) | second]


def _collapsed(names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, starts, places) with runs of one name as one element; places: where each element begins."""
    fresh = np.empty(len(names), bool)
    fresh[0], fresh[1:] = True, names[1:] != names[:-1]
    fresh[starts] = True
    places = np.flatnonzero(fresh)
    if len(places) == len(names):
        return names, starts, places
    run = np.diff(places, append=len(names)).astype(np.uint64)
    out = names[places]
    many = np.flatnonzero(run > 1)
    out[many] = (_mixed(out[many].astype(np.uint64) + (run[many] << np.uint64(32))) >> np.uint64(32)).astype(np.uint32)
    return out, np.searchsorted(places, starts), places


def _phrases(names: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places at which phrases start: local maxima of the labels, and the first element of each text. A text's second and
    last elements start none, so a phrase has two elements at least, unless it is a whole text."""
    label = _labels(names, starts)
    top = np.zeros(len(names), bool)
    top[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:])
    top[np.minimum(starts + 1, len(names) - 1)] = False
    top[starts[1:] - 1] = False
    top[starts] = True
    return np.flatnonzero(top)


def _named(names: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Names of the phrases that start at `at`; a phrase of one element has its name."""
    size = np.diff(at, append=len(names))
    place = np.arange(len(names), dtype=np.uint32) - np.repeat(at.astype(np.uint32), size)
    x = names.astype(np.uint64)
    x += place.astype(np.uint64) << np.uint64(32)
    out = (_mixed(np.add.reduceat(_mixed(x), at) + size.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)
    return np.where(size == 1, names[at], out)


def levels(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For level 0 (characters) and up: (names, starts, places) of the phrases of all texts: their 32-bit names, where each
    text's phrases begin among the names, and where each phrase begins among the characters of all texts. A text that is one
    phrase stays as it is on further levels. Texts may not be empty."""
    names = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(size) - size
    places = np.arange(len(names), dtype=np.int64)
    while True:
        names, starts, own = _collapsed(names, starts)
        places = places[own]
        yield names, starts, places
        if len(names) == len(starts):
            return
        at = _phrases(names, starts)
        names, starts, places = _named(names, at), np.searchsorted(at, starts), places[at]


def sketches(texts: list[str]) -> list[np.ndarray]:
    """Each text's SKETCH smallest signatures (32 bits), rising."""
    out = [np.zeros(0, np.uint32)] * len(texts)
    full = [i for i, t in enumerate(texts) if t]
    if not full:
        return out
    own = [texts[i] for i in full]
    least = np.searchsorted(SHORT, np.fromiter(map(len, own), np.int64, len(own)), "right")
    owners, values, none = [], [], np.ones(len(own), bool)

    def add(owner: np.ndarray, names: np.ndarray, level: int) -> None:
        owners.append(owner.astype(np.uint64))
        values.append(_mixed(names.astype(np.uint64) + np.uint64(level << 32)) >> np.uint64(32))

    for level, (names, starts, _) in enumerate(levels(own)):
        size = np.diff(starts, append=len(names))
        use = (least <= level) & (size > 1)
        none &= ~use
        if use.any():
            keep = np.repeat(use, size)
            add(np.repeat(np.arange(len(own))[use], size[use]), names[keep], level)
    add(np.flatnonzero(none), names[starts[none]], 255)  # one phrase before their own level
    keys = np.unique(np.concatenate(owners) << np.uint64(32) | np.concatenate(values))
    edges = np.searchsorted(keys, np.arange(len(own) + 1, dtype=np.uint64) << np.uint64(32))
    values = keys.astype(np.uint32)
    for i, a, b in zip(full, edges[:-1].tolist(), edges[1:].tolist()):
        out[i] = values[a : min(b, a + SKETCH)]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the smallest SKETCH different values of both that both hold."""
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a, b)[:SKETCH]
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def as_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def grouped(texts: list[str]) -> Iterator[list[str]]:
    """Texts in groups of about GROUP characters."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > GROUP:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every text."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return pd.Series([as_text(x) for g in grouped(list(column)) for x in sketches(g)], dtype=object)

    own = pick(docs, doc_id=doc_id, text=text).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    return own.select("doc_id", F.length("text").cast("long").alias("n_chars"), run("text").alias("fingerprint"))


def phrases(docs: DataFrame, level: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, end, name): the phrases of a level, in characters, with their names. Texts that are parsed into one
    phrase below that level have this phrase."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, texts = id_list(pdf["doc_id"]), list(pdf["text"])
            at = 0
            for own in grouped(texts):
                for got in zip(range(level + 1), levels(own)):
                    names, starts, places = got[1]
                size = np.diff(starts, append=len(names))
                owner = np.repeat(np.arange(len(own)), size)
                length = np.fromiter(map(len, own), np.int64, len(own))
                base = np.cumsum(length) - length
                ends = np.append(places[1:], base[-1] + length[-1])
                yield pd.DataFrame({"doc_id": [ids[at + i] for i in owner.tolist()], "start": places - base[owner], "end": ends - base[owner], "name": names.astype(np.int64)})
                at += len(own)

    own = pick(docs, doc_id=doc_id, text=text).filter("text <> ''").select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInPandas(run, "doc_id string, start long, end long, name long").withColumn("doc_id", F.col("doc_id").cast("long"))


def edited(own: str, following: str) -> str:
    """`own` with its last third (rounded down) replaced by as many characters from the beginning of `following`."""
    n = len(own) // 3
    return own[: len(own) - n] + following[:n]


KEYS = ("known", "id", "tie")


def in_turn(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows (place, known, id, tie, text, extra) in tasks of their own ranges of falling ids, sorted: each task's last row is the
    first one of the range after it (extra = 1), and after the last range comes the first. Null ids come last; rows that
    share an id go by a hash of their text; rows that share both are alike. Texts cross the network once.

    The keys are dealt by ranges first, which tells where ranges begin; rows then find their range by those bounds, of
    which there are as many as partitions."""
    spark = docs.sparkSession
    n = partitions(spark)
    rows = pick(docs, id=doc_id, text=text).select(F.col("id").isNotNull().cast("int").alias("known"), F.coalesce(F.col("id").cast("long"), F.lit(0)).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    falling = [F.col(k).desc() for k in KEYS]
    ranges = rows.select(*KEYS).repartitionByRange(n, *falling).groupBy(F.spark_partition_id().alias("p")).agg(F.max(F.struct(*KEYS)).alias("first")).orderBy(F.col("first").desc()).collect()
    heads = [tuple(r["first"]) for r in ranges]
    bounds = [tuple(-x for x in h) for h in heads]
    keys = even_keys(spark, len(heads)) if heads else [0]

    @F.pandas_udf("array<int>")
    def places(known: pd.Series, at: pd.Series, tie: pd.Series) -> pd.Series:
        out = []
        for k in zip(*([-int(x) for x in c] for c in (known, at, tie))):
            i = bisect_left(bounds, k)
            if i < len(bounds) and bounds[i] == k:
                out.append([keys[i], -keys[(i - 1) % len(keys)] - 1])  # a range's first row is also the last one before
            else:
                out.append([keys[i - 1]])
        return pd.Series(out, dtype=object)

    dealt = rows.select(F.explode(places("known", "id", "tie")).alias("x"), *KEYS, "text").withColumn("extra", (F.col("x") < 0).cast("int"))
    dealt = dealt.withColumn("place", F.when(F.col("x") < 0, -F.col("x") - 1).otherwise(F.col("x")).cast("int")).drop("x")
    return dealt.repartition(max(1, len(heads)), "place").sortWithinPartitions("place", "extra", *falling)


def compared(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): every text's fingerprint
    next to that of its edited text and of the next document, by falling id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the row that waits for the next one: (place, id, text, sketch)
        for pdf in batches:
            rows = []
            texts = list(pdf["text"])
            prints = [x for g in grouped(texts) for x in sketches(g)]
            for place, known, i, extra, t, x in zip(pdf["place"].tolist(), pdf["known"].tolist(), pdf["id"].tolist(), pdf["extra"].tolist(), texts, prints):
                if held is not None and held[0] == place:
                    rows.append((*held[1:], t, x))
                held = None if extra else (place, str(i) if known else None, t, x)
            new = [edited(own, following) for _, own, _, following, _ in rows]
            after = [x for g in grouped(new) for x in sketches(g)]
            yield pd.DataFrame(
                {
                    "doc_id": [r[0] for r in rows],
                    "n_chars": [len(r[1]) for r in rows],
                    "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new],
                    "fingerprint": [as_text(r[2]) for r in rows],
                    "edited_fingerprint": [as_text(x) for x in after],
                    "near_edited": [likeness(r[2], x) for r, x in zip(rows, after)],
                    "near_next": [likeness(r[2], r[4]) for r in rows],
                }
            )

    out = in_turn(docs, doc_id, text).select("place", "known", "id", "extra", "text").mapInPandas(run, "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
