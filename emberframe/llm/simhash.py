"""SimHash near-duplicates with a Gray-order hierarchical index.

Distinct fingerprints are dealt by four keys, each a quarter of the bits: two that differ in at most three bits share
one. Within a key they are sorted by Gray rank, so that neighbours differ in few bits, and every FANOUT of them form a
node that holds the bits all of them share (a mask and a pattern); nodes form upper nodes likewise. A search adds up a
fingerprint's differences to the bits that each level newly fixes, drops a whole group once they exceed the limit, and
accepts a whole group when even its unshared bits can't exceed it. Keys with more than HOT_KEY fingerprints are dealt
again by four other divisions of the bits, so no task holds a large one. Links become components by star contraction.

Nulls count as empty texts; texts without words have fingerprint zero and are linked like any other. Repeated rows and
ids each keep their row; component_id is the smallest non-null doc_id of the component (null if it has none). An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import looked_up, partitions, pick, ragged, stored
from emberframe.operators.graph import components

LIMIT, TABLES, FANOUT, HOT_KEY, SEED = 3, 4, 16, 2048, 42
#: How often a hot group is dealt at most: after ten divisions a key fixes so many bits that few fingerprints share it.
LEVELS = 10
#: Fingerprints that one index holds, but for a larger group.
CHUNK = 200_000


def fingerprint(text: str | None, width: int = 3) -> int:
    """Majority bits of the XXH64 hashes of all word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends[min(width, len(words)) - 1 :] - 1).tolist()
    hashed = xxhash.xxh64_intdigest
    h = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts, stops, strict=False)], dtype="<u8")
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint as a signed long."""

    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64))

    return pick(docs, doc_id=doc_id, text=text).select("doc_id", hashed(F.col("text").cast("string")).alias("fp"))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of n nodes reaches over the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(hop := new[new], new):
            new = hop
        if np.array_equal(new, root):
            return root
        root = new


class GrayIndex:
    """Nodes over fingerprints that are sorted by group and Gray rank. Level 0 holds the fingerprints themselves."""

    def __init__(self, fps: np.ndarray, group: np.ndarray):
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        # Of each level: pattern, mask, and the first child and number of children in the level below.
        self.levels = [(fps, np.full(len(fps), full), None, None)]
        self.first = [np.arange(len(fps))]  # a fingerprint below each node
        while True:
            pattern, mask, _, _ = self.levels[-1]
            n = len(pattern)
            edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
            sizes = np.diff(np.append(edge, n))
            if not n or (len(self.levels) > 1 and sizes.max() == 1):
                break
            parts = -(-sizes // FANOUT)
            start = np.repeat(edge, parts) + FANOUT * (ragged(np.zeros(len(edge), np.int64), parts))
            count = np.minimum(FANOUT, np.repeat(edge + sizes, parts) - start)
            agree_1 = np.bitwise_and.reduceat(pattern | ~mask, start)
            agree_0 = np.bitwise_or.reduceat(pattern & mask, start)
            up_mask = np.bitwise_and.reduceat(mask, start) & ~(agree_1 ^ agree_0)
            self.levels.append((agree_0 & up_mask, up_mask, start, count))
            self.first.append(self.first[-1][start])
            group = group[start]
        self.top_group = group

    def links(self, fps: np.ndarray, group: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places: a fingerprint, and a member of each group that lies wholly, or alone, within the limit."""
        top = len(self.levels) - 1
        if not top:
            return
        lo, hi = np.searchsorted(self.top_group, group, "left"), np.searchsorted(self.top_group, group, "right")
        for i in range(0, len(fps), 4096):
            j = np.arange(i, min(i + 4096, len(fps)))
            q, node = np.repeat(j, hi[j] - lo[j]), ragged(lo[j], hi[j] - lo[j])
            known, diff = np.zeros(len(q), np.uint64), np.zeros(len(q), np.int64)
            for level in range(top, -1, -1):
                pattern, mask, start, count = self.levels[level]
                fixed = mask[node] & ~known
                diff = diff + np.bitwise_count((fps[q] ^ pattern[node]) & fixed)
                near = diff <= limit
                q, node, diff = q[near], node[near], diff[near]
                free = np.bitwise_count(~mask[node])
                whole = diff + free <= limit
                if whole.any():
                    yield q[whole], self.first[level][node[whole]]
                q, node, diff = q[~whole], node[~whole], diff[~whole]
                if not len(q) or not level:
                    break
                known = np.repeat(mask[node], count[node])
                q, diff, node = np.repeat(q, count[node]), np.repeat(diff, count[node]), ragged(start[node], count[node])


def bit_classes(level: int, tables: int = TABLES) -> list[int]:
    """64 bits in `tables` classes: quarters at level 0, and at each further level a different division, so that keys over
    classes of several levels fix ever more bits."""
    if not level:
        edges = [64 * i // tables for i in range(tables + 1)]
        owner = [next(t for t in range(tables) if bit < edges[t + 1]) for bit in range(64)]
    else:
        owner = (np.argsort(np.random.default_rng(level).random(64)) % tables).tolist()
    masks = [0] * tables
    for bit, t in enumerate(owner):
        masks[t] |= 1 << bit
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def dealt(rows: DataFrame, level: int, tables: int) -> DataFrame:
    """(fp, mask, group): each row once for each class of bits, its group named by all bits fixed so far."""
    masks = F.array(*(F.col("mask").bitwiseOR(F.lit(m)) for m in bit_classes(level, tables)))
    each = rows.select("fp", F.explode(masks).alias("mask"))
    return each.select("fp", "mask", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("group"))


def near_links(distinct: DataFrame, limit: int = LIMIT, tables: int = TABLES) -> DataFrame:
    """(a, b): links between distinct fingerprints `fp` that connect whatever pairs within `limit` bits connect.

    `tables` must exceed `limit`. A group whose members all lie within the limit is linked through one member. A group of
    over HOT_KEY fingerprints is dealt again, by keys that fix bits of a second division as well, and so on: each
    fingerprint of it goes to `tables` smaller groups, so the work grows with the group, not with its square.
    """
    if tables <= limit:
        raise ValueError("tables must exceed limit")
    spark = distinct.sparkSession
    rows, level, ready = distinct.select("fp", F.lit(0).cast("long").alias("mask")), 0, []
    while True:
        rows = stored(dealt(rows, level, tables), f"simhash-keys-{level}")
        level += 1
        if level == LEVELS:
            ready.append(rows)
            break
        hot = stored(rows.groupBy("group").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_KEY), "simhash-hot")
        if hot.isEmpty():
            ready.append(rows)
            break
        total = rows.count()
        # Copies of a fingerprint in one group (by other masks, as hashes meet) do no harm.
        ready.append(rows.join(hot.select("group"), "group", "left_anti"))
        rows = looked_up(rows, hot, "group", "n", total)
    every = reduce(DataFrame.unionByName, (r.select("fp", "group") for r in ready))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole groups, about CHUNK fingerprints at once."""
        held, size = [], 0
        for pdf in batches:
            held.append((pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["group"].to_numpy(np.int64)))
            size += len(pdf)
            if size >= CHUNK:
                fps, group = (np.concatenate(x) for x in zip(*held))
                end = int(np.searchsorted(group, group[-1]))  # the last group may go on
                if end:
                    yield links_within(fps[:end], group[:end], limit)
                held, size = [(fps[end:], group[end:])], len(fps) - end
        if size:
            yield links_within(*(np.concatenate(x) for x in zip(*held)), limit)

    return every.repartition(partitions(spark), "group").sortWithinPartitions("group").mapInPandas(run, "a long, b long")


def links_within(fps: np.ndarray, group: np.ndarray, limit: int) -> pd.DataFrame:
    """Links (a, b) that connect the members of each group that pairs within the limit connect."""
    order = np.lexsort((gray_rank(fps), group))
    fps, group = fps[order], group[order]
    a = b = np.zeros(0, np.int64)
    for x, y in GrayIndex(fps, group).links(fps, group, limit):
        a, b = np.concatenate([a, x]), np.concatenate([b, y])
        if len(a) > 1_000_000:  # contract what has been found
            root = roots_of(len(fps), a, b)
            a = np.flatnonzero(root != np.arange(len(fps)))
            b = root[a]
    root = roots_of(len(fps), a, b)
    at = np.flatnonzero(fps[root] != fps)
    return pd.DataFrame({"a": fps[at].view(np.int64), "b": fps[root[at]].view(np.int64)}).drop_duplicates()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs."""
    each = stored(fingerprints(docs, doc_id, text), "simhash")
    distinct = stored(each.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    rooted = components(stored(near_links(distinct.select("fp"), limit), "simhash-links"))
    classes = stored(distinct.join(rooted.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root")), "simhash-classes")
    tops = stored(classes.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size")), "simhash-tops")
    ids = stored(looked_up(classes, tops, "root", "size", classes.count()).select("fp", "n", "component_id"), "simhash-ids")
    return looked_up(each, ids, "fp", "n", each.count()).select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
