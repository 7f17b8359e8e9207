"""Exact top-k inner-product search with a pivot-distance index.

Vectors become integers. With one more component that gives all of them the length of the longest, the largest inner
product is the smallest distance, and the triangle inequality holds: a vector at distance d from a pivot is at least
|d(query, pivot) - d| from the query. All rows are keyed by nearest pivot and distance, sorted and packed into annuli
of at most ANNULUS rows. Consecutive annuli of a shell (SHELLS ranges of distance a pivot) form a slice of SLICE_ROWS rows, or
more where the table would have over SLICES slices; a slice is what the joins know by name.

Queries are keyed and sorted likewise and packed by PACK, so the queries of a pack lie near each other. Each query visits
slices by rising bound: first RING of them, then WIDER times as many, and so on, in rounds. After each round its k-th best
score is known, and it stops at the first slice whose bound can't reach that. A pack meets the annuli of a slice in a join
on the slice; an annulus computes products only for the queries of the pack that it can still serve. Neither queries nor
rows pass through the driver, only the sample, the pivots and each slice's least and greatest distance.

Scores and the k-th best ones are 64-bit integers throughout. The bounds by distance are doubles, which allow for their own
rounding. Vectors so long that a product might not fit (squared length of 2^63 and more) raise an error.

Pivots, radii, and each query's first bound come from a sample of about SAMPLE rows, chosen by hash; the answer is exact.

Rows with a null id, or a vector that is null or holds null or non-finite components, take no part. Shorter vectors
count as padded with zeros. Ties go to the smaller id. Rows that repeat an id are candidates each, but never of a query
with that id; query rows that repeat an id are answered each. No queries or no candidates give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe.llm.common import block_number, partitions, pick, sampled, stored

SAMPLE, PIVOTS, SHELLS, ANNULUS, PACK = 2048, 32, 4, 1024, 1024
SLICE_ROWS, SLICES = 1 << 16, 1 << 13
#: Slices that a query has visited after the first round, and how many times more after each further one.
RING, WIDER = 4, 8
NONE = np.iinfo(np.int64).min
PACKED = "pack long, ids binary, rows binary, bounds binary"
FOUND = "pack long, at int, query_id long, vec_id long, score long"


def integers(df: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    v = F.col("v").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return pick(df, id=vec_id, v=vector).filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(fine).select(F.col("id").cast("long"), F.transform(v, lambda x: F.floor(x * scale)).alias("v"))


def matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, x in enumerate(vectors):
        out[i, : len(x)] = x
    return out


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Each next pivot is the row farthest from those chosen."""
    at, dist = [0], np.full(len(sample), np.inf)
    while len(at) < min(n, len(sample)):
        dist = np.minimum(dist, ((sample - sample[at[-1]]) ** 2).sum(1))
        at.append(int(dist.argmax()))
    return sample[at]


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]


class Best:
    """The k best rows of each query of some packs, as far as a task has seen them."""

    def __init__(self, k: int):
        self.k, self.packs = k, {}

    def pack(self, pack: int, at: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, dict]:
        bound, own = self.packs.setdefault(pack, (np.full(PACK, NONE), {}))
        bound[at] = np.maximum(bound[at], bounds)
        return bound, own

    def add(self, bound: np.ndarray, own: dict, at: int, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if at in own:
            ids, scores = np.concatenate([own[at][1], ids]), np.concatenate([own[at][2], scores])
        keep = best(ids, scores, self.k)
        own[at] = (query, ids[keep], scores[keep])
        if len(keep) == self.k:
            bound[at] = max(int(bound[at]), int(scores[keep[-1]]))

    def rows(self) -> pd.DataFrame:
        out = [(pack, at, *x) for pack, (_, own) in self.packs.items() for at, x in own.items()]
        sizes = [len(x[3]) for x in out]
        column = lambda i: np.repeat(np.array([x[i] for x in out], np.int64), sizes)
        flat = lambda i: np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64)
        self.packs = {}
        return pd.DataFrame({"pack": column(0), "at": column(1), "query_id": column(2), "vec_id": flat(3), "score": flat(4)})


def search(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row of `vectors` where `is_query` (over column id) holds."""
    spark = vectors.sparkSession
    ints = integers(vectors, vec_id, vector, scale)
    shape = ints.agg(F.max(F.size("v")).alias("width"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("norm"), F.count("*").alias("n")).first()
    if shape["width"] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, longest = int(shape["width"]), float(shape["norm"])
    if longest >= 2.0**63 * (1 - 1e-9):
        raise ValueError("the vectors are too long for 64-bit scores; take a smaller scale")
    slice_rows = max(SLICE_ROWS, shape["n"] // SLICES)
    kind = np.float64 if longest < 2.0**52 else np.int64

    def lifted(m: np.ndarray) -> np.ndarray:
        return np.hstack([m, np.sqrt(np.maximum(longest - (m * m).sum(1), 0))[:, None]])

    cell = next(t for t in (np.int16, np.int32, np.int64) if longest < float(np.iinfo(t).max) ** 2 or t is np.int64)
    picked = sorted(sampled(ints, SAMPLE, "id").collect(), key=lambda r: r["id"])
    sample_ids, sample = np.array([r["id"] for r in picked], np.int64), matrix([r["v"] for r in picked], width)
    pivots = choose_pivots(lifted(sample), PIVOTS)

    def distances(m: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((m * m).sum(1)[:, None] - 2 * m @ pivots.T + (pivots * pivots).sum(1), 0))

    to_pivot = distances(lifted(sample))
    near = to_pivot.argmin(1)
    radii = [np.unique(np.quantile(to_pivot[near == p, p], np.linspace(0, 1, SHELLS + 1)[1:-1])) for p in range(len(pivots))]

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = distances(lifted(matrix(pdf["v"], width)))
                own = d.argmin(1)
                d = d[np.arange(len(d)), own]
                yield pdf.assign(shell=[int(p * SHELLS + np.searchsorted(radii[p], x, "right")) for p, x in zip(own.tolist(), d)], dist=d)

    def ordered(df: DataFrame) -> DataFrame:
        out = df.mapInPandas(keyed, "id long, v array<long>, shell int, dist double")
        return out.repartitionByRange(partitions(spark), "shell", "dist", "id").sortWithinPartitions("shell", "dist", "id")

    def annuli(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, at, held = -1, None, 0
        for pdf in batches:
            for shell, own in pdf.groupby("shell", sort=True):
                for i in range(0, len(own), ANNULUS):
                    part = own.iloc[i : i + ANNULUS]
                    if shell != at or held >= slice_rows:
                        n, at, held = n + 1, shell, 0
                    held += len(part)
                    yield pd.DataFrame({"slice": [block_number(n)], "shell": [shell], "low": [part["dist"].min()], "high": [part["dist"].max()], "ids": [part["id"].to_numpy().tobytes()], "rows": [matrix(part["v"], width).astype(cell).tobytes()]})

    def packs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = 0
        for pdf in batches:
            for i in range(0, len(pdf), PACK):
                part = pdf.iloc[i : i + PACK]
                ids, rows = part["id"].to_numpy(np.int64), matrix(part["v"], width)
                scores = (rows.astype(kind) @ sample.astype(kind).T).astype(np.int64)
                scores[ids[:, None] == sample_ids[None, :]] = NONE
                bounds = np.sort(scores, 1)[:, -k] if scores.shape[1] >= k else np.full(len(ids), NONE)
                yield pd.DataFrame({"pack": [block_number(n)], "ids": [ids.tobytes()], "rows": [rows.astype(cell).tobytes()], "bounds": [bounds.tobytes()]})
                n += 1

    index = stored(ordered(ints).mapInPandas(annuli, "slice long, shell int, low double, high double, ids binary, rows binary"), "pivot-index")
    queries = stored(ordered(ints.filter(is_query)).mapInPandas(packs, PACKED), "pivot-queries")
    slices = sorted(tuple(r) for r in index.groupBy("slice", "shell").agg(F.min("low"), F.max("high")).collect())
    names, shells, low, high = (np.array(x) for x in zip(*slices)) if slices else (np.zeros(0, np.int64),) * 4

    def reach(q: np.ndarray, pivot: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of queries (rows) and ranges of distance from a pivot: no row in the range scores higher. Squared distances are
        right but for about 1e-12 of the lengths, which counts against the bound."""
        lengths = (q * q).sum(1)[:, None]
        slack = 1e-12 * (lengths + 2 * longest)
        d = distances(np.hstack([q, np.zeros((len(q), 1))]))[:, pivot] ** 2
        near, far = np.sqrt(np.maximum(d - slack, 0)), np.sqrt(d + slack)
        least = np.maximum(np.maximum(np.sqrt(np.maximum(low * low - slack, 0)) - far, near - np.sqrt(high * high + slack)), 0)
        return (lengths + longest - least * least) / 2 + 1 + 1e-9 * (lengths + longest)

    def ring(first: int, after: int):
        """Each pack's queries by the slices that come `first` to before `after` for them and may hold better rows."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for pack, ids, rows, bounds in pdf[["pack", "ids", "rows", "bounds"]].itertuples(index=False):
                    ids, bounds = np.frombuffer(ids, np.int64), np.frombuffer(bounds, np.int64)
                    rows = np.frombuffer(rows, cell).reshape(len(ids), width)
                    wanted = np.zeros((len(ids), len(names)), bool)
                    step = max(1, (1 << 20) // len(names))
                    for i in range(0, len(ids), step):
                        most = reach(rows[i : i + step].astype(float), shells // SHELLS, low, high)
                        place = np.argsort(np.argsort(-most, 1, kind="stable"), 1)
                        wanted[i : i + step] = (place >= first) & (place < after) & (most >= bounds[i : i + step, None])
                    for j in np.flatnonzero(wanted.any(0)).tolist():
                        at = np.flatnonzero(wanted[:, j])
                        yield pd.DataFrame({"slice": [names[j]], "pack": [pack], "at": [at.astype(np.int16).tobytes()], "query_ids": [ids[at].tobytes()], "queries": [rows[at].tobytes()], "bounds": [bounds[at].tobytes()]})

        return run

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Best(k)
        for pdf in batches:
            for shell, pack, at, query_ids, q, bounds, a, z, ids, rows in pdf[["shell", "pack", "at", "query_ids", "queries", "bounds", "low", "high", "ids", "rows"]].itertuples(index=False):
                at, query_ids, ids = np.frombuffer(at, np.int16), np.frombuffer(query_ids, np.int64), np.frombuffer(ids, np.int64)
                q, rows = np.frombuffer(q, cell).reshape(len(at), width).astype(kind), np.frombuffer(rows, cell).reshape(len(ids), width).astype(kind)
                bound, own = held.pack(pack, at, np.frombuffer(bounds, np.int64))
                use = np.flatnonzero(reach(q.astype(float), np.array([shell // SHELLS]), a, z)[:, 0] >= bound[at])
                got = q[use] @ rows.T
                for j, row in zip(use.tolist(), got):
                    good = np.flatnonzero((row >= bound[at[j]]) & (ids != query_ids[j]))
                    if len(good):
                        held.add(bound, own, int(at[j]), int(query_ids[j]), ids[good], row[good].astype(np.int64))
                if len(held.packs) > 16:
                    yield held.rows()
        yield held.rows()

    def tightened(own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        """A pack with its queries' k-th best scores as bounds."""
        kth = found[found["rank"] == k]
        bounds = np.frombuffer(own["bounds"].iloc[0], np.int64).copy()
        bounds[kth["at"]] = np.maximum(bounds[kth["at"]], kth["score"])
        return own.assign(bounds=[bounds.tobytes()])

    order = Window.partitionBy("pack", "at").orderBy(F.col("score").desc(), "vec_id")
    top = None
    first, after = 0, RING
    while first < len(names):
        met = queries.mapInPandas(ring(first, after), "slice long, pack long, at binary, query_ids binary, queries binary, bounds binary")
        met = met.hint("merge").join(index, "slice")  # no broadcast: a pack goes to many slices, which its table's size doesn't tell
        found = met.mapInPandas(walk, FOUND)
        found = found if top is None else found.unionByName(top.drop("rank"))
        top = stored(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "pivot-best")
        first, after = after, after * WIDER
        if first >= len(names):
            break
        queries = stored(queries.groupBy("pack").cogroup(top.groupBy("pack")).applyInPandas(tightened, PACKED), "pivot-queries")
    if top is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return top.select("query_id", "rank", "vec_id", "score")
