"""Removal of repeated substrings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from emberframe.llm import suffix


def covered(raw, length):
    """Of each byte string: which bytes strings of `length` that stand twice cover."""
    seen = Counter(b[k : k + length] for b in raw for k in range(len(b) - length + 1))
    for b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        yield gone


def slow(docs, length, passage):
    raw = [(t or "").encode() for _, t in docs]
    out = []
    for (i, _), b, gone, told in zip(docs, raw, covered(raw, length), covered(raw, passage)):
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest(), sum(told)))
    return sorted(out, key=str)


def fast(df, **k):
    return sorted((tuple(r) for r in suffix.digest(suffix.deduplicated(df, **k)).collect()), key=str)


def corpus(seed, n=70, size=400):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice("ab éc ") for _ in range(k))
    passages = [text(rng.randint(30, 130)) for _ in range(8)] + ["ab" * 60, "a" * 90]
    docs = []
    for i in range(n):
        parts = [text(rng.randint(0, size)) for _ in range(3)]
        parts.insert(1, rng.choice(passages))
        if i % 3 == 0:
            p = rng.choice(passages)
            parts.append(p[rng.randint(0, 30) :])
        docs.append((i, "".join(parts)))
    docs += docs[:5] + [(None, None), (3, ""), (99, "ab" * 400), (98, "x" * 39), (2**53 + 1, "b"), (2**53 + 3, "b")]
    copy = docs[7][1]
    return docs + [(200 + i, copy[: (k := rng.randrange(len(copy)))] + "#" + copy[k + 1 :]) for i in range(25)]


@pytest.mark.parametrize(("seed", "group", "passage", "blind"), [(1, 1500, 40, False), (2, 3, 32, False), (3, 1500, 32, True)])
def test_equals_brute_force(spark, monkeypatch, seed, group, passage, blind):
    monkeypatch.setattr(suffix, "GROUP", group)
    if blind:  # all hashes meet: the bytes decide
        monkeypatch.setattr(suffix.Hasher, "__init__", lambda self, size=1 << 16: self.__dict__.update(room=size))
        monkeypatch.setattr(suffix.Hasher, "sums", lambda self, data: None)
        monkeypatch.setattr(suffix.Hasher, "strings", lambda self, sums, starts, length: np.zeros(len(starts), np.uint64))
    docs = corpus(seed)
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_bytes int").repartition(3)
    want = slow(docs, 40, passage)
    assert any(w[3] > 1 for w in want)
    assert fast(df, length=40, passage=passage) == want


def test_documents_and_empty(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    assert fast(df) == slow([tuple(r) for r in df.select("doc_id", "text").collect()], 400, 256)
    assert fast(df.limit(0)) == []


def test_loser_tree_merges_with_prefixes():
    rng = random.Random(3)
    runs = [sorted("".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode() for _ in range(rng.randint(0, 30))) for _ in range(7)]
    shared = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    coded = [(r, [0] + [shared(a, b) for a, b in zip(r, r[1:])]) for r in runs]
    got = [(runs[r][i], n) for r, i, n in suffix.LoserTree(coded)]
    want = sorted(k for r in runs for k in r)
    assert [k for k, _ in got] == want
    assert [n for _, n in got] == [0] + [shared(a, b) for a, b in zip(want, want[1:])]
    assert list(suffix.LoserTree([])) == []


def test_run_round_trip():
    keys = sorted({b"abcd" * 5 + bytes([i]) for i in range(50)} | {b"", b"abcdx"})
    n = len(keys)
    meta = {"right": np.arange(n), "count": np.arange(n) % 7, "weight": np.ones(n, np.int64), "first": np.arange(n, dtype=np.int64)[::-1] * 70_000}
    back, _, fields = suffix.decoded(suffix.front_coded(keys, meta))
    assert back == keys and all((fields[k] == meta[k]).all() for k in meta)


def test_bytes_tell_strings_apart_whose_hashes_meet():
    data = b"abcabdabc"
    starts, entry = np.array([0, 3, 6]), np.arange(3)
    lead, own = suffix.equal_strings(data, starts, entry, 3, np.zeros(3, np.int64), np.zeros(3, np.uint64))
    assert own[0] == own[2] != own[1] and lead.tolist() == [0, 1]
