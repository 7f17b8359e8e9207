"""Each stage of the pipeline against a brute-force version on what its predecessor kept."""

import hashlib

import pytest

import corpus_pipeline
from emberframe.llm import bpe, pii, queries
from tests.llm.test_search_operators import near3, slow_fingerprint, slow_roots
from tests.llm.test_text_operators import expected_hits


@pytest.fixture(scope="module")
def stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, small).cache()
        out.append(docs)
    return [[r.asDict() for r in d.collect()] for d in out]


def test_columns(stages):
    for rows in stages[:-1]:
        assert list(rows[0]) == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxic_rows_go(spark, small, stages):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in stages[1]}
    same = [(d["doc_id"] not in kept) == bool(labels[d["doc_id"]]) for d in stages[0] if d["doc_id"] in labels]
    assert sum(same) > 0.9 * len(same)
    before = {r["doc_id"]: r for r in stages[0]}
    assert all(before[r["doc_id"]] == r for r in stages[1])


def test_one_of_each_group(stages):
    ids, fps = [r["doc_id"] for r in stages[1]], [slow_fingerprint(r["text"]) for r in stages[1]]
    least = {}
    for i, root in zip(ids, slow_roots(fps, near3)):
        least[root] = min(i, least.get(root, i))
    assert sorted(r["doc_id"] for r in stages[2]) == sorted(least.values())


def test_benchmark_passages_go(spark, small, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    hits = {r[0]: r for r in expected_hits([(r["doc_id"], r["text"]) for r in stages[2]], items)}
    left = {r[0]: r for r in expected_hits([(r["doc_id"], r["text"]) for r in stages[3]], items)}
    assert sorted(hits) == sorted(left) and any(r[2] for r in hits.values())
    for i, (_, n_words, n_hit, *_) in hits.items():
        assert left[i][1] == n_words - n_hit
    before = {r["doc_id"]: r for r in stages[2]}
    assert all(before[r["doc_id"]] == r for r in stages[3] if not hits[r["doc_id"]][2])


def test_personal_data_goes(stages):
    before = {r["doc_id"]: r for r in stages[3]}
    assert len(before) == len(stages[4])
    for r in stages[4]:
        assert not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        if not pii.MAY_HOLD.search(before[r["doc_id"]]["text"]):
            assert before[r["doc_id"]] == r


def test_tokens(stages):
    import tiktoken

    path, pattern = queries.vocabulary()
    enc = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in stages[4]}
    assert len(texts) == len(stages[5])
    for r in stages[5]:
        ids = enc.encode_ordinary(texts[r["doc_id"]])
        assert bytes(r["token_ids"]) == b"".join(x.to_bytes(4, "little") for x in ids) and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_odd_rows_and_empty(spark, small):
    rows = [(3, None, "en", "s", None), (None, "a b c", None, "s", 5), (None, "a b c", None, "s", 5), (4, "", "en", None, 0), (9, "mail a@b.cd now", "en", "s", 15), (9, "mail a@b.cd now", "en", "s", 15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for d, n in ((docs, 3), (docs.limit(0), 0)):
        for _, f in corpus_pipeline.STAGES:
            d = f(spark, d, small)
        assert d.count() == n


def test_clashing_names(spark, small):
    rows = [(i, f"own words of row {i} and more {i * 7}", 0.9, "k", i) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic_score double, row_key string, row_number long")
    for f in (corpus_pipeline.without_toxic, corpus_pipeline.one_of_near_duplicates):
        assert sorted(map(tuple, f(spark, docs, small).collect())) == rows


def test_one_id_on_two_texts(spark, small):
    a, b = (" ".join(f"{w}{i}" for i in range(60)) for w in ("sea", "oak"))
    kept = lambda rows: sorted(tuple(r) for r in corpus_pipeline.one_of_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), small).collect())
    assert kept([(5, a), (5, b)]) == [(5, b), (5, a)]
    assert kept([(3, a), (5, a), (5, b), (5, b)]) == [(3, a), (5, b)]
    assert kept([(3, b), (5, a), (5, b), (7, a)]) == [(3, b), (5, a)]
