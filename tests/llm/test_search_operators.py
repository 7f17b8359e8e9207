"""SimHash near-duplicates, components and top-k search against brute force, and their edge cases."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from emberframe.llm import queries, simhash, topk
from emberframe.operators import graph


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_roots(values, near):
    """Smallest place reachable from each place over near pairs."""
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def near3(a, b):
    return (a ^ b).bit_count() <= 3


def check_classes(rows, pairs):
    fps = [slow_fingerprint(t) for _, t in pairs]
    roots = slow_roots(fps, near3)
    least = {}
    for (i, _), r in zip(pairs, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = sorted(((i, f"{f:016x}", least.get(r)) for (i, _), f, r in zip(pairs, fps, roots)), key=str)
    assert sorted((tuple(r) for r in rows), key=str) == want


def test_simhash_equals_brute_force(spark, small):
    pairs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    check_classes(queries.op3_simhash(spark, small).collect(), pairs)


def test_simhash_odd_rows(spark):
    pairs = [(5, None), (3, ""), (3, " \n"), (None, "A b"), (9, "a  B"), (1, "word " * 4000), (7, "a b c É"), (7, "a b c É"), (2**53 + 1, "own text of one"), (2**53 + 3, "other words here")]
    df = spark.createDataFrame([(*p, 1) for p in pairs], "doc_id long, text string, fp int")
    check_classes(simhash.digest(simhash.near_duplicates(df)).collect(), pairs)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [8, 2048])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_KEY", hot)
    rng = random.Random(1)
    values = {rng.getrandbits(64) for _ in range(60)}
    for centre in list(values)[:4]:  # dense groups, chains and far pairs
        for _ in range(70):
            x = centre
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5])):
                x ^= 1 << b
            values.add(x)
    values = sorted(values)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = [tuple(r) for r in simhash.near_links(df).collect()]
    at = {x: i for i, x in enumerate(signed)}
    a, b = np.array([at[x] for x, _ in links]), np.array([at[y] for _, y in links])
    assert simhash.roots_of(len(values), a, b).tolist() == slow_roots(values, near3)


def test_gray_rank_orders_the_gray_sequence():
    codes = np.arange(256, dtype=np.uint64) ^ (np.arange(256, dtype=np.uint64) >> np.uint64(1))
    assert simhash.gray_rank(codes).tolist() == list(range(256))


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7), (200, 250), (250, 201), (None, 3)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100, 200: 200, 201: 200, 250: 200}


@pytest.mark.parametrize("sizes", [{}, {"ANNULUS": 7, "PACK": 3, "RING": 1, "WIDER": 2, "SLICE_ROWS": 20}])
def test_topk_equals_brute_force(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.normal(size=8).round(2).tolist(), "x") for i in range(300)]
    rows += [(300 + i, rows[0][1], "x") for i in range(60)]  # ties, some of them queries
    rows += [(2**53 + 3, rows[1][1], "x"), (2**53 + 9, rows[1][1], "x"), (50, rows[2][1], "x")]  # ids beyond doubles; a query twice
    rows += [(None, [1.0] * 8, "x"), (900, None, "x"), (950, [None] * 8, "x"), (1000, [float("nan")] * 8, "x"), (1050, [1.0, float("inf")], "x"), (1100, [], "x"), (1150, [1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    ints = []
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            ints.append((i, np.floor(256 * np.array([*map(np.float32, v)] + [0] * (8 - len(v)), float)).astype(int)))
    want = []
    for q, x in ints:
        if q % 50 == 0:
            order = sorted((-int(x @ y), c) for c, y in ints if c != q)[:5]
            want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(order)]
    got = sorted(tuple(r) for r in topk.search(df, F.col("id") % 50 == 0).collect())
    assert got == sorted(want)
    assert topk.search(df.limit(0), F.col("id") % 50 == 0).collect() == []
    assert len(topk.search(df.filter("vec_id < 3"), F.col("id") % 50 == 0).collect()) == 2


def test_a_hot_key_costs_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_KEY", 32)
    made, plain = [], simhash.dealt
    monkeypatch.setattr(simhash, "dealt", lambda *a: made.append(x := plain(*a)) or x)
    rows = []
    for n in (1500, 3000):
        rng = random.Random(n)  # one 16-bit key holds all; the other bits are free
        df = spark.createDataFrame([(rng.getrandbits(47) << 16 | 7,) for _ in range(n)], "fp long")
        made.clear()
        assert simhash.near_links(df).count() == 0
        rows.append(sum(x.count() for x in made))
    assert rows[1] < 2.5 * rows[0]


def test_whole_groups_in_chunks(spark, monkeypatch):
    rng = random.Random(4)
    values = sorted({c ^ 1 << b for c in (rng.getrandbits(62) for _ in range(40)) for b in range(12)})
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    want = None
    for chunk in (200_000, 7):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        got = {r["node"]: r["root"] for r in graph.components(simhash.near_links(df)).collect()}
        assert len(set(got.values())) == 40 and want in (None, got)
        want = got


def test_frequent_keys_are_looked_up_apart(spark):
    from emberframe.sources.shared import looked_up

    rows = spark.createDataFrame([(1, i) for i in range(5000)] + [(2 + i % 40, i) for i in range(80)] + [(None, 1)], "k long, v long")
    table = rows.filter("k is not null").groupBy("k").count().withColumnRenamed("count", "n").withColumn("x", F.col("k") * 2)
    got = looked_up(rows, table, "k", "n", 5080).filter("k < 42")
    assert sorted(map(tuple, got.collect())) == sorted((k, v, 2 * k) for k, v in map(tuple, rows.collect()) if k is not None and k < 42)


def test_components_of_a_hub(spark):
    edges = [(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(60)] + [(5030, 17)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {0} and len(got) == 3000 + 61


def test_topk_stops_early(spark):
    """Clustered vectors: most shells are never visited, and the answer is still exact."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 4)) * 40
    points = [(i, (centres[i % 12] + rng.normal(size=4) * 0.05).tolist()) for i in range(2400)]
    df = spark.createDataFrame(points, "vec_id long, embedding array<double>")
    x = np.floor(256 * np.array([v for _, v in points])).astype(np.int64)
    want = []
    for q in range(0, 2400, 50):
        s = x @ x[q]
        order = [c for c in np.lexsort((np.arange(2400), -s)) if c != q][:5]
        want += [(q, n + 1, int(c), int(s[c])) for n, c in enumerate(order)]
    assert sorted(map(tuple, topk.search(df, F.col("id") % 50 == 0).collect())) == want


@pytest.mark.parametrize("scale", [1.0, 1e3, 1e6])
def test_topk_is_whole_at_any_length(spark, monkeypatch, scale):
    """Scores of over 53 bits: no row is lost to a rounded bound."""
    monkeypatch.setattr(topk, "SLICE_ROWS", 50)
    x = np.random.default_rng(11).normal(size=(900, 12)) * scale
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    ints = np.floor(256 * x).astype(np.int64).astype(object)
    want = []
    for q in range(0, 900, 40):
        scores = ints @ ints[q]
        want += [(q, n + 1, c, int(scores[c])) for n, c in enumerate(sorted((c for c in range(900) if c != q), key=lambda c: (-scores[c], c))[:5])]
    assert sorted(map(tuple, topk.search(df, F.col("id") % 40 == 0).collect())) == want


def test_topk_refuses_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(i, [1e8 * i, 3e8]) for i in range(60)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="too long"):
        topk.search(df, F.col("id") % 50 == 0)


def test_topk_deals_a_shell_over_many_keys(spark, monkeypatch):
    """One dense place: its annuli get many names, so that they don't meet in one task."""
    monkeypatch.setattr(topk, "SLICE_ROWS", 100)
    names = []
    real = topk.stored

    def spy(df, name):
        out = real(df, name)
        if name == "pivot-index":
            names.extend(r[0] for r in out.groupBy("shell").agg(F.count_distinct("slice").alias("n")).select("n").collect())
        return out

    monkeypatch.setattr(topk, "stored", spy)
    x = np.random.default_rng(1).normal(size=(4000, 3)) * 0.01 + 5
    topk.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("id") % 50 == 0).collect()
    assert sum(names) >= 40


def test_topk_broadcasts_no_pack(spark, monkeypatch):
    plans, stored = [], topk.stored
    monkeypatch.setattr(topk, "stored", lambda df, name: (plans.append((name, df._jdf.queryExecution().sparkPlan().toString())), stored(df, name))[1])
    rows = [(i, [float((i * 7919 + 31 * j) % 97) for j in range(6)]) for i in range(300)]
    assert topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 5 == 0).count() == 300
    met = [plan for name, plan in plans if name == "pivot-best"]
    assert met and all("SortMergeJoin" in plan and "BroadcastHashJoin" not in plan for plan in met)
