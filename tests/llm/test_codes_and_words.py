"""Vector codes, fingerprints by parsing and spelling variants against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe.llm import lcp, queries, variants, vector_codes

VECTORS = "vec_id long, embedding array<double>, label string, code string, error int, v string"


# Vector codes


def slow_codes(rows, scale=256, parts=16, entries=64, rounds=2):
    """{row number: (code, error)} and the codebooks, in plain integers."""
    kept = [(i, n, [floor(Fraction(x) * scale) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return {}, []
    width = -(-max(len(v) for _, _, v in kept) // parts)
    cut = {n: [(v + [0] * (parts * width - len(v)))[p * width : (p + 1) * width] for p in range(parts)] for _, n, v in kept}
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[list(cut[n][p]) for _, n, _ in first] for p in range(parts)]
    best = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for n in cut:
                own.setdefault(best(cut[n][p], books[p])[1], []).append(cut[n][p])
            for j, xs in own.items():
                books[p][j] = [sum(c) // len(xs) for c in zip(*xs)]
    got = {n: [best(cut[n][p], books[p]) for p in range(parts)] for n in cut}
    return {n: ("".join(f"{j:02x}" for _, j in g), sum(d for d, _ in g)) for n, g in got.items()}, books


def check_codes(spark, rows, labels, **how):
    df = spark.createDataFrame([(i, v, lab, "x", 1, "y") for (i, v), lab in zip(rows, labels)], VECTORS)
    got = sorted((tuple(r) for r in vector_codes.digest(*vector_codes.code(df, **how)).collect()), key=str)
    codes, books = slow_codes(rows)
    sums = Counter()
    for n, (_, e) in codes.items():
        sums[labels[n]] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    assert got == sorted(((rows[n][0], c, e, sums[labels[n]], sha) for n, (c, e) in codes.items()), key=str)


@pytest.mark.parametrize("scale", [1.0, 1e3, 1e6, 1e12])
def test_codes_equal_brute_force(spark, scale):
    rng = np.random.default_rng(5)
    rows = [(int(i), (rng.normal(size=32) * scale).tolist()) for i in rng.permutation(150)]
    check_codes(spark, rows, [["a", "b", None][i % 3] for i in range(150)]) if scale < 1e12 else None
    if scale == 1e12:  # an error of more than 63 bits is an error, not a wrong number
        with pytest.raises(Exception):  # noqa: B017
            check_codes(spark, rows, ["a"] * 150)


def test_codes_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(3, [1.0, 2.0]), (3, [0.5, -0.1]), (None, [1.0] * 20), (1, None), (2, [1.0, None]), (4, [nan]), (5, [inf, 1.0]), (2**53 + 1, []), (2**53 + 2, [1.0, 2.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0])]
    check_codes(spark, rows, ["a", None, None, "a", "", "", "b", "", "null", "=", "="])
    empty = spark.createDataFrame([], VECTORS)
    assert vector_codes.digest(*vector_codes.code(empty)).collect() == []
    assert vector_codes.digest(*vector_codes.code(spark.createDataFrame([(1, None, "a", "", 0, "")], VECTORS))).collect() == []
    check_codes(spark, [(1, []), (2, [])], ["a", "a"])
    with pytest.raises(Exception, match="too large"):
        vector_codes.digest(*vector_codes.code(spark.createDataFrame([(1, [1e30], "a", "", 0, "")], VECTORS))).collect()


def test_bounds_prune_and_decode(spark, small):
    rng = np.random.default_rng(1)
    entries = rng.integers(-300, 300, (64, 4))
    parts = entries[rng.integers(0, 64, 2000)] + rng.integers(-9, 9, (2000, 4))
    pivots = vector_codes.farthest_first(entries, 4)
    away = vector_codes.pivot_distances(parts[:, None, :], [pivots])[:, 0]
    at, d, evaluated = vector_codes.nearest(parts, away, entries, pivots)
    full = ((parts[:, None] - entries[None]) ** 2).sum(2)
    assert (d == full.min(1)).all() and (at == full.argmin(1)).all()
    assert evaluated < 0.1 * full.size  # of 64 entries a part, fewer than seven
    same = np.array([[1, 1], [3, 3], [1, 1]])  # ties go to the lower index, equal pivots do no harm
    at, _, _ = vector_codes.nearest(np.array([[2, 2], [1, 1]]), vector_codes.pivot_distances(np.array([[[2, 2]], [[1, 1]]]), [same])[:, 0], same, same)
    assert at.tolist() == [0, 0]
    codes, books = vector_codes.code(spark.read.parquet(f"{small}/embeddings.parquet"))
    ints = {r["vec_id"]: [floor(256 * x) for x in r["embedding"]] for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()}
    for r in vector_codes.decode(codes, books).collect():
        assert r["error"] == sum((a - b) ** 2 for a, b in zip(ints[r["vec_id"]], r["decoded"]))


# Fingerprints


def test_compared_equals_brute_force(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    check_compared(spark, docs, queries.op12_lcp_fingerprint(spark, small).collect())


def check_compared(spark, docs, rows):
    """docs with different ids; one by one, each text in a group of its own."""
    docs = sorted(((i, t or "") for i, t in docs), key=lambda d: (d[0] is None, -(d[0] or 0)))
    alone = lambda t: lcp.sketches([t])[0]
    want = []
    for (i, t), (_, u) in zip(docs, docs[1:] + docs[:1]):
        n = len(t) // 3
        e = t[: len(t) - n] + u[:n]
        a, b, c = alone(t), alone(e), alone(u)
        jaccard = lambda x, y: 1.0 if not len(x) and not len(y) else sum(v in set(x) and v in set(y) for v in sorted({*x, *y})[:64]) / len(sorted({*x, *y})[:64])
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), lcp.as_text(a), lcp.as_text(b), round(jaccard(a.tolist(), b.tolist()), 9), round(jaccard(a.tolist(), c.tolist()), 9)))
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_compared_odd_rows(spark):
    long = "".join(random.Random(3).choice("abcdefg \n") for _ in range(700_000))
    docs = [(5, None), (2**53 + 1, "a"), (2**53 + 3, ""), (-(2**63), "é" * 500), (2, "ab" * 300), (4, long), (9, "x" + long), (8, "\x00\x00\x00"), (7, "日本語😀" * 9), (None, "the last one of all")]
    df = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in docs], "doc_id long, text string, place string, known int, tie long")
    check_compared(spark, docs, lcp.compared(df).collect())
    one = spark.createDataFrame([(1, "alone")], "doc_id long, text string")
    check_compared(spark, [(1, "alone")], lcp.compared(one).collect())
    assert lcp.compared(one.limit(0)).collect() == []
    same = spark.createDataFrame([(3, "once and again")] * 40 + [(None, None)] * 40 + [(3, "not the same")] * 3, "doc_id long, text string").repartition(5)
    rows = lcp.compared(same).collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in rows) == {(3, 14): 40, (None, 0): 40, (3, 12): 3}


def test_in_turn_over_many_ranges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        docs = [(i * 7 % 1000, f"text {i} " * (i % 9)) for i in range(1000)]
        check_compared(spark, docs, lcp.compared(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_equal_substrings_share_phrases(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("etaoin shrdlu.") for _ in range(n))
    shared = text(3000)
    docs = [(1, text(501) + shared + text(77)), (2, text(12) + shared), (3, shared + text(333))]
    rows = lcp.phrases(spark.createDataFrame(docs, "doc_id long, text string"), level=3).collect()
    of = {i: t for i, t in docs}
    for i in of:
        own = sorted((r["start"], r["end"]) for r in rows if r["doc_id"] == i)
        assert own[0][0] == 0 and own[-1][1] == len(of[i]) and all(a[1] == b[0] for a, b in zip(own, own[1:]))
    names = {i: {(r["name"], of[i][r["start"] : r["end"]]) for r in rows if r["doc_id"] == i} for i in of}
    inside = {x for x in names[3] if x[1] in shared}
    for i in (1, 2):  # but for a few phrases at its ends
        assert len(inside - names[i]) <= 8 < len(inside) // 8
    assert len({n for i in of for n, _ in names[i]}) == len({x for i in of for x in names[i]})  # one name, one text


def test_likeness_tells_edits_from_strangers(spark):
    got = queries.op12_lcp_fingerprint(spark, "/root/testdata/sf0.01")
    far = got.filter("near_edited <= near_next AND fingerprint <> edited_fingerprint").count()
    mean = got.agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert far <= 5 and 0.4 < mean[0] < 0.65 and mean[1] < 0.05


# Spelling variants


def slow_counts(docs):
    n = Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_variants(words, times=10):
    near = {w: [] for w in words}
    keyed = {}
    for w in words:  # words with a common string of one deletion, or one that is the other's
        for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            keyed.setdefault(x, []).append(w)
    for own in keyed.values():
        for a in own:
            near[a] += [b for b in own if b != a and one_edit(a, b)]
    out = {}
    for w, n in words.items():
        best = min(set(near[w]), key=lambda v: (-words[v], v), default=None)
        out[w] = (best if best is not None and words[best] >= times * n else None, len(set(near[w])))
    rows = []
    for w, (form, k) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.append((w, form, root, words[w], k, words[form] if form else None))
    return sorted(rows)


def test_variants_equal_brute_force(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op13_spelling_variants(spark, small).collect())
    assert got == slow_variants(slow_counts(docs)) and any(r[1] for r in got)


@pytest.mark.parametrize("hot", [0, 2, 1000])
def test_variants_chains_and_hot_keys(spark, hot):
    rng = random.Random(4)
    words = {"".join(rng.choice("abcéÿ") for _ in range(7)): 10 ** rng.randint(0, 5) for _ in range(600)}
    words |= {w + "x": 2 for w in list(words)[:50]} | {"aaaaaaa" + "b" * k: 11**k for k in range(6)} | {"z" * 4000: 500, "z" * 4001: 3, "zzzyzzz": 2}
    df = spark.createDataFrame([(w, n, 1, "k") for w, n in words.items()], "word string, n long, near int, key string").select("word", "n")
    assert sorted((tuple(r) for r in variants.grouped(df, hot=hot).collect()), key=lambda r: r[0]) == slow_variants(words)


def test_variants_odd_rows(spark):
    word = "q" * 3000
    docs = [(None, "wörtlich wörtlich"), (None, None), (1, None), (2, ""), (3, "123 .. \n"), (4, "ÄÖÜßäöü Äöüßäöü ÄÖÜßäöü"), (2**53 + 1, f"{word} {word} {word}q"), (5, "Letters letters LETTERS lettres"), (5, "Letters letters LETTERS lettres"), (6, "a×b÷cdefg a×b÷cdefg")]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, word string, n int")
    assert sorted(tuple(r) for r in variants.grouped(variants.word_counts(df).filter("n >= 2")).collect()) == slow_variants(slow_counts(docs))
    assert variants.grouped(variants.word_counts(df.limit(0)).filter("n >= 2")).collect() == []


@pytest.mark.parametrize("hot", [0, 1000])
def test_variants_broadcast_no_keys(spark, hot):
    """The keys of a word's neighbourhood are about 156 rows a word: only the joins with the table of frequent keys may broadcast."""
    words = variants.stored(spark.createDataFrame([(f"w{'abcdefghij'[i % 10]}rd{'klmnopqrst'[i // 10]}s", i + 1) for i in range(100)], "word string, n long"), "words")
    plan = variants.near_pairs(words, hot)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Inner, Build" not in plan


def test_neighbourhoods_are_complete():
    rng = random.Random(2)
    for _ in range(300):
        w = "".join(rng.choice("abcdefgàç") for _ in range(rng.randint(1, 9)))
        i, c = rng.randrange(len(w)), rng.choice("abcdefgàç")
        for v in (w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :], w[:i] + c + w[i:], w + c):
            if v and v != w:
                key = variants.reduced_keys([v])[0]
                assert key in variants.neighbour_keys([w])[0]
                assert variants.full_key(v) in variants.finer_keys(w, key)
