"""Vector codes: product quantization whose assignments are found by LAESA.

Vectors become integers and are cut into PARTS equal consecutive parts; each position has a codebook of up to ENTRIES
entries, which starts as that part of the smallest ids. PIVOTS of these entries a position stay fixed as pivots. The
distances of every part to its pivots are computed once and stored next to the integers. In each round, only the distances
between pivots and the current entries are new: for an entry, the largest difference between the part's and the entry's
distance to a pivot is a lower bound of their distance. A part meets entries by rising bound, evaluates exact integer
distances, and stops at the first bound beyond the best one; an entry whose bound only equals it is still evaluated, as
ties go to the lower index. Bounds have a margin for rounding, so results don't depend on it.

Sums and counts of an entry are added within a task first, then by entry: at most PARTS * ENTRIES rows a task, whatever
the entries' shares. Only codebooks (bounded by ENTRIES vectors) pass through the driver.

Rows whose vector is null, or holds null or non-finite components, are left out; so nothing is left of an empty table.
Null ids stay and come last among the ids that start the codebooks; of repeated ids the smaller vector comes first; fewer
rows than ENTRIES make smaller codebooks. Vectors are padded with zeros to the least multiple of PARTS that holds the
longest. Integers of 2^62 and more, and sums that no long holds, raise an error. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import looked_up, pick, stored

PARTS, ENTRIES, ROUNDS, PIVOTS = 16, 64, 2, 4
#: Parts that are assigned at a time: bounds the matrices of a task.
CHUNK = 8192


def whole_numbers(vectors: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    v = F.col("v").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    floor = lambda x: F.when(F.abs(x * scale) < float(1 << 62), F.floor(x * scale)).otherwise(F.raise_error(F.lit("a component is too large for a vector code")).cast("long"))
    return pick(vectors, vec_id=vec_id, label=label, v=vector).filter(F.col("v").isNotNull()).filter(fine).withColumn("v", F.transform(v, floor))


def farthest_first(entries: np.ndarray, n: int) -> np.ndarray:
    """Up to n different entries (rows), each next one the farthest from those chosen."""
    at, away = [0], np.full(len(entries), np.inf)
    while len(at) < min(n, len(entries)):
        away = np.minimum(away, lengths(entries - entries[at[-1]]))
        if away.max() == 0:
            break
        at.append(int(away.argmax()))
    return entries[at]


def squares(d: np.ndarray) -> np.ndarray:
    return (d * d).sum(-1)


def lengths(d: np.ndarray) -> np.ndarray:
    return np.sqrt(squares(d).astype(np.float64))


def pivot_distances(parts: np.ndarray, pivots: list[np.ndarray]) -> np.ndarray:
    """Of (n, positions, width) integers: (n, positions, pivots) distances, as far as a position has pivots."""
    out = np.zeros((len(parts), len(pivots), max(map(len, pivots))), np.float32)
    for p, own in enumerate(pivots):
        for j, x in enumerate(own):
            out[:, p, j] = lengths(parts[:, p] - x)
    return out


def nearest(parts: np.ndarray, away: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, squared distance) of each part's nearest entry, ties to the lower index, and how many exact distances that
    took. parts: (n, width) integers; away: their distances to the pivots (n, pivots)."""
    n, evaluated = len(parts), 0
    bound = np.zeros((n, len(entries)))
    for j, x in enumerate(pivots):
        own, theirs = away[:, j, None].astype(np.float64), lengths(entries - x)[None, :]
        np.maximum(bound, np.abs(own - theirs) * (1 - 1e-6) - 1e-6 * np.minimum(own, theirs), out=bound)
    order = np.argsort(bound, 1, kind="stable")
    bound = np.take_along_axis(bound, order, 1) ** 2
    first = order[:, 0]
    best, at, active = squares(parts - entries[first]), first.copy(), np.arange(n)
    evaluated += n
    for k in range(1, len(entries)):
        active = active[bound[active, k] <= best[active].astype(np.float64) * (1 + 1e-9)]
        if not len(active):
            break
        e = order[active, k]
        d = squares(parts[active] - entries[e])
        evaluated += len(active)
        better = (d < best[active]) | ((d == best[active]) & (e < at[active]))
        at[active[better]], best[active[better]] = e[better], d[better]
    return at, best, evaluated


def code(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, n_pivots: int = PIVOTS) -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label, code binary of one byte a part, error), codebooks): the codes of all vectors, and an array of
    integer entries for each part. `entries` is at most 256."""
    spark = vectors.sparkSession
    ints = whole_numbers(vectors, vec_id, vector, label, scale)
    size = ints.agg(F.max(F.size("v")).alias("width"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
    if size["width"] is None:
        return spark.createDataFrame([], "vec_id long, label string, code binary, error long"), []
    width = -(-int(size["width"]) // parts)
    most = int(size["most"] or 0)
    kind = np.int64 if width * parts * (2 * most + 1) ** 2 < 1 << 62 else object  # exact at any size
    cell = next(t for t in (np.int16, np.int32, np.int64) if most <= np.iinfo(t).max)

    def matrix(lists) -> np.ndarray:
        out = np.zeros((len(lists), parts * width), cell)
        for i, x in enumerate(lists):
            out[i, : len(x)] = x
        return out

    def cut(rows: np.ndarray) -> np.ndarray:
        return rows.astype(kind).reshape(len(rows), parts, width)

    starts = ints.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    first = cut(matrix([r["v"] for r in starts]))
    books = [first[:, p] for p in range(parts)]
    pivots = [farthest_first(b, n_pivots) for b in books]

    @F.pandas_udf("row binary, away binary")
    def packed(v: pd.Series) -> pd.DataFrame:
        rows = matrix(v)
        away = pivot_distances(cut(rows), pivots)
        return pd.DataFrame({"row": [x.tobytes() for x in rows], "away": [x.tobytes() for x in away]}, columns=["row", "away"])

    table = stored(ints.select("vec_id", "label", packed("v").alias("x")).select("vec_id", "label", "x.*"), "vector-parts")

    def assigned(rows: pd.Series, away: pd.Series, books: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(parts, index, squared distance) by chunks of vectors."""
        step = max(1, CHUNK // parts)
        for i in range(0, len(rows), step):
            own = cut(np.frombuffer(b"".join(rows[i : i + step]), cell).reshape(len(rows[i : i + step]), parts * width))
            far = np.frombuffer(b"".join(away[i : i + step]), np.float32).reshape(len(own), parts, -1)
            got = [nearest(own[:, p], far[:, p], books[p], pivots[p]) for p in range(parts)]
            yield own, np.stack([g[0] for g in got], 1), np.stack([g[1] for g in got], 1)

    sums = [f"s{i}" for i in range(width)]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)

        def tally(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            total = np.zeros((parts, entries, width), object if kind is object else np.int64)
            n = np.zeros((parts, entries), np.int64)
            for pdf in batches:
                for own, at, _ in assigned(pdf["row"], pdf["away"], shared.value):
                    for p in range(parts):
                        np.add.at(total[p], at[:, p], own[:, p])
                        n[p] += np.bincount(at[:, p], minlength=entries)
            part, entry = np.nonzero(n)
            yield pd.DataFrame({"part": part, "entry": entry, "n": n[part, entry]} | {s: total[part, entry, i] for i, s in enumerate(sums)})

        fields = ", ".join(f"{s} long" for s in sums)
        per_task = table.select("row", "away").mapInPandas(tally, f"part int, entry int, n long{', ' * bool(sums)}{fields}")
        for r in per_task.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(s).alias(s) for s in sums)).toLocalIterator():
            if r["part"] is not None:
                books[r["part"]] = books[r["part"]].copy()
                books[r["part"]][r["entry"]] = [r[s] // r["n"] for s in sums]

    final = spark.sparkContext.broadcast(books)

    @F.pandas_udf("code binary, error long")
    def coded(row: pd.Series, away: pd.Series) -> pd.DataFrame:
        codes, errors = [], []
        for _, at, d in assigned(row, away, final.value):
            codes += [x.tobytes() for x in at.astype(np.uint8)]
            errors += [int(x) for x in d.sum(1)]
        return pd.DataFrame({"code": codes, "error": errors}, columns=["code", "error"])

    out = table.select("vec_id", "label", coded("row", "away").alias("x")).select("vec_id", "label", "x.*")
    return stored(out, "vector-codes"), books


def codebooks_text(books: list[np.ndarray]) -> str:
    """All entries' components, by part, entry and position."""
    return ",".join(str(int(x)) for book in books for entry in book for x in entry)


def with_group_error(codes: DataFrame, out: str = "label_error") -> DataFrame:
    """Adds the error summed over the rows of equal labels, nulls being equal. A frequent label is summed in each task first
    and looked up in a small broadcast table."""
    keyed = codes.withColumn("__key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    sums = keyed.groupBy("__key").agg(F.sum("error").alias(out), F.count("*").alias("__n"))
    return looked_up(keyed, sums, "__key", "__n", codes.count()).drop("__key")


def digest(codes: DataFrame, books: list[np.ndarray]) -> DataFrame:
    sha = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    return with_group_error(codes).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def decode(codes: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """Adds `decoded`, the integers that each code stands for (with the padding)."""
    shared = codes.sparkSession.sparkContext.broadcast([np.asarray(b, np.int64) for b in books])

    @F.pandas_udf("array<long>")
    def run(code: pd.Series) -> pd.Series:
        return code.map(lambda c: np.concatenate([b[i] for b, i in zip(shared.value, c)]).tolist())

    return codes.withColumn("decoded", run("code"))
