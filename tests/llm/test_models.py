"""HMM scores, toxicity and personal data: exact parts against brute force, learned parts against held-out rows."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe.llm import hmm, pii, queries, toxicity

ODD = [(7, None, 1), (None, "", 1), (8, "A b\x0bc É a", None), (8, "A b\x0bc É a", 2), (9, "word " * 3000, 2), (2**53 + 1, "b", 2), (2**53 + 3, "b", 2)]


def base_scores(docs):
    learn = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2
    cut = lambda t: ["w" + x for x in re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))] + ["end"]
    c = Counter(w for i, t in docs if learn(i) for w in cut(t))
    n, v = sum(c.values()), len(c)
    out = [(i, not learn(i), len(cut(t)), sum(c[w] > 0 for w in cut(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in cut(t))) for i, t in docs]
    return sorted(out, key=str)


def check_base(rows, docs):
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in rows), key=str)
    want = base_scores(docs)
    assert sorted(g[:5] for g in map(tuple, got) if g[0] is not None) == sorted(w[:5] for w in want if w[0] is not None)
    assert sorted(g[5] for g in got) == pytest.approx(sorted(w[5] for w in want))
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)


def test_hmm_base_and_held_out_gain(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op1_hmm_score(spark, small).collect()
    check_base(rows, docs)
    assert sum(r["score"] for r in rows if r["held_out"]) > sum(r["base_score"] for r in rows if r["held_out"])


def test_hmm_odd_rows(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, held int")
    check_base(hmm.score(df, hmm.held_out(), rounds=1).collect(), [r[:2] for r in ODD])
    assert hmm.score(df.limit(0), hmm.held_out(), rounds=1).collect() == []


def random_model(rng, states=3, classes=5):
    norm = lambda x, a: x / x.sum(a, keepdims=True)
    return hmm.Model(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((classes, states)), 0))


def by_paths(seqs, m):
    """Expected starts, moves, emissions and log-likelihood by enumeration of all state paths."""
    k = len(m.start)
    start, move, emit, total = np.zeros(k), np.zeros((k, k)), np.zeros(m.emit.shape), 0.0
    for s in seqs:
        paths = [(p, m.start[p[0]] * m.emit[s[0], p[0]] * math.prod(m.move[a, b] * m.emit[c, b] for a, b, c in zip(p, p[1:], s[1:]))) for p in itertools.product(range(k), repeat=len(s))]
        z = sum(w for _, w in paths)
        total += math.log(z)
        for p, w in paths:
            start[p[0]] += w / z
            for a, b in zip(p, p[1:]):
                move[a, b] += w / z
            for a, c in zip(p, s):
                emit[c, a] += w / z
    return np.concatenate([start, move.ravel(), emit.ravel(), [total]])


@pytest.mark.parametrize(("walk", "stretch", "portion"), [(2048, 128, 400_000), (4, 2, 400_000), (3, 3, 5), (1, 2, 1)])
def test_expected_counts_equal_enumerated_paths(monkeypatch, walk, stretch, portion):
    for name, value in (("WALK", walk), ("STRETCH", stretch), ("PORTION", portion)):
        monkeypatch.setattr(hmm, name, value)
    rng = np.random.default_rng(1)
    m, seqs = random_model(rng), [rng.integers(0, 5, n) for n in (1, 2, 7, 3, 8, 5, 6)]
    counts, flat = np.array([len(s) for s in seqs]), np.concatenate(seqs)
    assert hmm.expected_counts(counts, flat, m) == pytest.approx(by_paths(seqs, m), rel=1e-5, abs=1e-5)
    assert hmm.log10_likelihoods(counts, flat, m) == pytest.approx([by_paths([s], m)[-1] / math.log(10) for s in seqs], rel=1e-9)


def test_likelihood_never_falls(monkeypatch):
    for name, value in (("WALK", 40), ("STRETCH", 16), ("SMOOTH", 0)):
        monkeypatch.setattr(hmm, name, value)
    rng = np.random.default_rng(2)
    counts, m, last = np.array([1, 33, 200, 99, 40, 41]), random_model(rng), -np.inf
    flat = rng.integers(0, 5, counts.sum())
    for _ in range(12):
        sums = hmm.expected_counts(counts, flat, m)
        assert sums[12:27].sum() == pytest.approx(len(flat), rel=1e-5)  # each token is in one state
        assert sums[-1] > last - 1e-3
        last, m = sums[-1], hmm.improved(m, sums, np.full(5, 0.2))
    assert m.emit.sum(0) == pytest.approx(np.ones(3)) and m.move.sum(1) == pytest.approx(np.ones(3))


def test_hmm_does_not_depend_on_the_files(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = []
    for n in (1, 6, 40):
        docs.repartition(n).write.parquet(str(tmp_path / str(n)))
        rows = hmm.score(spark.read.parquet(str(tmp_path / str(n))), hmm.held_out()).collect()
        got.append(np.array([(r["base_score"], r["score"]) for r in sorted(rows, key=lambda r: r["doc_id"])]))
    assert np.abs(got[0] - got[1]).max() < 1e-6 * np.abs(got[0]).max() and np.abs(got[0] / got[2] - 1).max() < 1e-6


def slow_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]

    def luhn(s):
        d = [int(c) for c in s[::-1]]
        return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0

    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (pii.KINDS.index(s[0]), s[1]))


TRICKY = ["", "a@b@c.d x.y@z", "a@b.c@d.e.f", "@x.y", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 00000255.1.1.1", "4111 1111-1111 1111 4111111111111112", "+1 (017) 555-7713 é +1", "é" * 130 + "4111111111111111" + " " * 90 + "ü@ü.de ab.c%d+e-f@g-h.i-j. +12345678"]


def test_base_spans_equal_plain_patterns(spark, small):
    texts = TRICKY + [r[0] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    for t in texts:
        assert sorted(pii.base_spans(t), key=lambda s: (pii.KINDS.index(s[0]), s[1])) == slow_spans(t)


def test_base_spans_take_linear_time():
    import time

    for t in ("7" * 1_000_000, "7." * 500_000, "+7(" * 300_000, "a@" * 500_000, "a." * 500_000 + "@", "1 " * 500_000, "@a" * 500_000):
        began = time.time()
        pii.base_spans(t)
        assert time.time() - began < 3, t[:9]


def test_addresses_equal_the_pattern():
    rng = np.random.default_rng(8)
    for _ in range(400):
        t = "".join(rng.choice(list("0129....  x"), 60)).replace("9", str(rng.integers(0, 300)))
        assert [s for s in slow_spans(t) if s[0] == "ip"] == [("ip", a, b) for a, b in pii.addresses(t)]


def test_tags_equal_the_best_path_by_enumeration():
    t, rng = pii.Tagger(3), np.random.default_rng(1)
    x = rng.integers(0, 9, (5, 4))
    em, p = t.emissions(x.T), t.p
    for i, got in enumerate(t.tag(x)):
        value = lambda y: p["start"][y[0]] + em[0, i, y[0]] + sum(p["trans"][a, b] + em[k + 1, i, b] for k, (a, b) in enumerate(zip(y, y[1:])))  # noqa: E731, B023
        assert tuple(got) == max(itertools.product(range(pii.TAGS), repeat=4), key=value)


def test_windows_are_reconciled_by_the_nearest_middle(tagger):
    """A whole text's tags equal those of every window, skipped ones included, each taken around its own middle."""
    texts = [t for t, _ in pii.made_up(30, seed=5)] + ["é" * 90 + "4111111111111112" + "x" * 200 + " +1 (017) 555-7713", "1" * 300]
    for text in texts:
        starts = np.arange(0, len(text), pii.STRIDE)
        tags = tagger.tag(pii.cut(pii.classes(text), starts, pii.PAD))
        whole = np.zeros(len(text), np.int64)
        for c in range(len(text)):
            k = min(range(len(starts)), key=lambda k: abs(2 * (c - starts[k]) - pii.WINDOW + 1) if 0 <= c - starts[k] < pii.WINDOW else 10**6)
            whole[c] = tags[k][c - starts[k]]
        base = pii.base_spans(text)
        got = [(d["kind"], d["start"], d["end"]) for d in pii.spans_of([text], tagger)[0] if not d["base"]]
        assert got == sorted(pii.added_spans(text, whole, base), key=lambda s: (pii.KINDS.index(s[0]), s[1]))


def test_training_windows_come_from_the_whole_text():
    text = "x 1 " * 5000
    x, y = pii.training_windows(text, [], 40)
    assert x.shape == y.shape == (40, pii.WINDOW)
    places = pii.window_starts(text)
    kept = places[np.argsort(pii.mixed(places))[:40]]
    assert kept.max() > 0.8 * len(text) and kept.min() < 0.2 * len(text)


@pytest.fixture(scope="module")
def tagger():
    t = pii.Tagger()
    pairs = [pii.training_windows(text, spans, pii.WINDOWS_PER_TEXT) for text, spans in pii.made_up()]
    t.train(*(np.concatenate(x) for x in zip(*pairs)))
    return t


def test_gradients_are_right():
    t, rng = pii.Tagger(), np.random.default_rng(0)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    x, y = rng.integers(0, 9, (6, 2)), rng.integers(0, pii.TAGS, (6, 2))
    _, g = t.gradients(x, y)
    for k in t.p:
        at = tuple(rng.integers(0, n) for n in t.p[k].shape) if k != "embed" else (int(x[0, 0]), 1)
        old, e = t.p[k][at], 1e-2
        t.p[k][at] = old + e
        up, _ = t.gradients(x, y)
        t.p[k][at] = old - e
        down, _ = t.gradients(x, y)
        t.p[k][at] = old
        assert g[k][at] == pytest.approx((up - down) / (2 * e), abs=2e-3), k


def test_tagger_finds_what_patterns_turn_down(tagger):
    new = pii.made_up(80, seed=99)
    want = {(i, *s) for i, (t, spans) in enumerate(new) for s in spans}
    got = {(i, d["kind"], d["start"], d["end"]) for i, ds in enumerate(pii.spans_of([t for t, _ in new], tagger)) for d in ds}
    assert len(want & got) > 0.9 * len(want) and len(want & got) > 0.85 * len(got)


def test_pii_rows(spark, tagger):
    texts = [*TRICKY, None]
    df = spark.createDataFrame([(i % 3 and 2**53 + i or None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    rows = pii.digest(pii.find(df, tagger)).collect()
    assert sorted((r["doc_id"] or 0 for r in rows)) == sorted(i % 3 and 2**53 + i for i in range(len(texts)))
    assert all(r["n_spans"] == len([x for x in r["spans"].split(",") if x]) >= r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in rows)
    base = {t: ",".join(f"{k}:{a}:{b}" for k, a, b in slow_spans(t or "")) for t in texts}
    assert sorted(r["base_sha256"] for r in rows) == sorted(hashlib.sha256(b.encode()).hexdigest() for b in base.values())
    for t in texts:
        spans = pii.spans_of([t], tagger)[0]
        assert [s for s in spans if s["base"]] == [{"kind": k, "start": a, "end": b, "base": True} for k, a, b in slow_spans(t or "")]
    clean = {r["text"] for r in pii.redacted(df, tagger).collect()}
    assert None in clean and "" in clean and not any("4111111111111111" in t for t in clean if t)
    assert pii.find(df.limit(0), tagger).count() == 0


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = queries.op6_toxicity(spark, d).collect()
    assert len(rows) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in held) > 0.93 * len(held)


def test_toxicity_odd(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (None, "", None), (2, "you IDIOT!!! " * 2000, 1.0), (2, "you 1d10t", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 0), (1, None), (None, 1), (2, 1), (77, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, labels).count() == 4
    assert {r["score"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_trees_and_isotonic():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(int)
    raw = toxicity.Trees(x[:1500], y[:1500]).raw(x[1500:])
    assert ((raw > 0) == y[1500:]).mean() > 0.95
    curve = toxicity.Isotonic(raw, y[1500:])
    assert (np.diff(curve.y) > 0).all() and 0 <= curve(np.array([-1e9]))[0] <= curve(np.array([1e9]))[0] <= 1


def test_packed_integers_round_trip():
    from emberframe.llm.common import AT_RAW, AT_THREE, AT_TWO, pack, pack_words, unpack, unpack_words

    edges = [0, 1, *(x + d for x in (AT_TWO, AT_THREE, AT_RAW) for d in (-1, 0, 1)), 2**32 - 1, 65535, 65536, 300]
    rng = np.random.default_rng(5)
    for a in ([], edges, rng.permutation(edges * 5), rng.integers(0, 2**32, 1000), rng.zipf(1.3, 5000) % 2**32):
        assert unpack(pack(np.array(a, dtype=np.uint64))).tolist() == [int(x) for x in a]
    for words in ([], [b""], [b"a", b"", b"b" * 70_000, "é".encode()]):
        assert unpack_words(pack_words(words)) == words


def columns_differ(m):
    return all(np.abs(m.emit[:, i] - m.emit[:, j]).sum() > 1e-3 for i in range(m.emit.shape[1]) for j in range(i))


def test_first_model_has_no_equal_states():
    overall = np.full(5, 0.2)
    for texts in ([], [np.array([1, 2, 2])], [np.array([1, 2, 2])] * 20, [np.array([0]), np.array([4])]):
        m = hmm.first_model(overall, texts)
        assert m.emit.sum(0) == pytest.approx(np.ones(hmm.STATES)) and columns_differ(m)


@pytest.mark.parametrize("first", ["long", "held out", "short", "copies"])
def test_hmm_starts_come_from_all_blocks(spark, monkeypatch, first):
    learn = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = next(i for i in range(200) if i not in learn)
    block = {"long": [(learn[0], "same words again " * 3000)], "held out": [(held, "held out words " * 300)], "short": [(learn[0], "a b")], "copies": [(i, "hot text " * 60) for i in learn[:40]]}[first]
    rest = [(i, f"topic{i} of{i} its{i} own{i} " * 20) for i in learn[50:70]]
    sc = spark.sparkContext
    df = spark.createDataFrame(sc.union([sc.parallelize(block, 1), sc.parallelize(rest, 2)]), "doc_id long, text string")
    seen, plain = [], hmm.first_model
    monkeypatch.setattr(hmm, "first_model", lambda overall, texts, *a: seen.append((texts, m := plain(overall, texts, *a))) or m)
    assert len(hmm.score(df, hmm.held_out(), rounds=1).collect()) == len(block) + len(rest)
    texts, m = seen[0]
    assert len(texts) == len({t.tobytes() for t in texts}) == len(rest) + (first != "held out") and columns_differ(m)
    monkeypatch.setattr(hmm, "START_TEXTS", 5)
    assert len(hmm.least(np.arange(9.0), np.arange(3.0))) == 5


def test_a_tree_takes_the_best_split_of_all():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 6, (60, 3)).astype(float)
    y = (x[:, 1] + rng.normal(size=60) > 3).astype(int)
    t = toxicity.Trees(x, y, trees=1, depth=1, rate=1.0, smooth=5.0)
    p = y.mean()
    g, h = p - y, np.full(60, p * (1 - p))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 5) + g[~m].sum() ** 2 / (h[~m].sum() + 5)
    (feature, value), = t.trees[0][0]
    assert gain(x[:, feature[0]] < value[0]) == pytest.approx(max(gain(x[:, f] < v) for f in range(3) for v in set(x[:, f])))
    left = x[:, feature[0]] < value[0]
    want = np.where(left, -g[left].sum() / (h[left].sum() + 5), -g[~left].sum() / (h[~left].sum() + 5))
    assert t.raw(x) - t.base == pytest.approx(want, rel=1e-3)


def test_isotonic_is_the_best_rising_fit():
    rng = np.random.default_rng(7)
    x, y = np.arange(40.0), (rng.random(40) < np.linspace(0.1, 0.9, 40)).astype(int)
    curve = toxicity.Isotonic(x, y)
    fit = np.array([max(min(y[a : b + 1].mean() for b in range(i, 40)) for a in range(i + 1)) for i in range(40)])
    assert sorted(set(curve.y.round(9))) == sorted(set(fit.round(9)))
    assert curve(curve.x) == pytest.approx(curve.y)
    tied, swap = np.array([0.0, 0, 1, 1]), np.array([1, 0, 3, 2])
    assert toxicity.Isotonic(tied, np.array([0, 1, 0, 1])).y.tolist() == toxicity.Isotonic(tied[swap], np.array([0, 1, 0, 1])[swap]).y.tolist() == [0.5]


def test_features_by_hand():
    names = dict(zip(toxicity.NAMES, toxicity.features("YOU idiot, you 1d10t!! So baaad? abcdefgh 42", {"abcde": 2.0, "abcdefg": 3.0})))
    assert names["words"] == pytest.approx(np.log1p(8)) and names["insults"] == 2 and names["insult_density"] == 2 / 8
    assert (names["learned"], names["learned_weight"]) == (1, 3 / 8) and names["second_density"] == 2 / 8 and names["near_second"] == 2 / 8
    assert names["obfuscated_insults"] == 1 / 8 and names["exclamations"] == 2 / 8 and names["questions"] == 1 / 8 and names["stretched"] == 1 / 8
    assert names["capitals"] == pytest.approx(4 / 44) and names["shouted_words"] == 1 / 8 and names["distinct_share"] == 7 / 8


def test_toxicity_query_equals_the_model_row_by_row(spark, small):
    """The registered query against plain Python: learned lexicon, features, trees and calibration recomputed from rows."""
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in queries.op6_toxicity(spark, small).collect()}
    learn = {r["doc_id"]: r["toxic"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    part = {r["doc_id"]: r["p"] for r in docs.selectExpr("doc_id", "pmod(xxhash64(doc_id, 5), 5) as p").collect()}
    rows = [(r["doc_id"], r["text"], learn[r["doc_id"]]) for r in docs.collect() if r["doc_id"] in learn]
    other, toxic = Counter(), Counter()
    sizes = Counter(y for i, _, y in rows if part[i] > 1)
    for i, t, y in rows:
        if part[i] > 1:
            (toxic if y else other).update(toxicity.stems(t))
    odds = {}
    for s, a in toxic.items():
        o = math.log(((a + 0.5) / (sizes[1] + 1)) / ((other[s] + 0.5) / (sizes[0] + 1)))
        if a >= 4 and o > 1.5 and o / math.sqrt(1 / (a + 0.5) + 1 / (other[s] + 0.5)) > 3.5:
            odds[s] = o
    rows = sorted({(i, y, int(part[i] == 0), tuple(toxicity.features(t, odds))) for i, t, y in rows})
    x, y, spare = np.array([r[3] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows], bool)
    model = toxicity.Model(odds, x, y, spare)
    plain = {r["doc_id"]: model.score([r["text"]])[0] for r in docs.collect()}
    assert sorted(got) == sorted(plain) and [got[i]["score"] for i in plain] == pytest.approx(list(plain.values()), abs=1e-6)
    repeated = docs.unionByName(docs.filter("doc_id % 3 = 1").crossJoin(spark.range(30)).drop("id"))
    assert toxicity.fit(repeated, labels, F.lit(True)).share == toxicity.fit(docs, labels, F.lit(True)).share
