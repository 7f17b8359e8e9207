"""Byte BPE, decontamination, license scan and token counts against brute force, and their edge cases."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from emberframe.llm import bpe, decontaminate, license, queries, tokens

ODD = [(1, None, 7), (None, "", 7), (2, "The the\n\n  THE É 12'll " * 3, None), (2, "The the\n\n  THE É 12'll " * 3, 1), (3, "x" * 5000, 1), (4, "été 日本   end \t\n", 1), (2**53 + 1, "b", 1), (2**53 + 3, "b", 1)]
SCHEMA = "doc_id long, text string, block int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def rows(spark, small, table="documents"):
    return [tuple(r) for r in spark.read.parquet(f"{small}/{table}.parquet").select(*(["doc_id", "text"] if table == "documents" else ["item_id", "text"])).collect()]


@pytest.fixture(scope="module")
def encoder():
    import tiktoken

    path, pattern = queries.vocabulary()
    return tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})


def expected_bpe(encoder, docs):
    out = []
    for i, t in docs:
        ids = encoder.encode_ordinary(t or "")
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        out.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_bpe_equals_the_library(spark, small, encoder):
    got = [tuple(r) for r in queries.op2_byte_bpe(spark, small).collect()]
    assert sorted(got, key=str) == expected_bpe(encoder, rows(spark, small))


def test_bpe_odd_rows_and_empty(spark, odd, encoder):
    path, pattern = queries.vocabulary()
    run = lambda df: [tuple(r) for r in bpe.digest(bpe.decode(bpe.encode(df, path, pattern), path)).collect()]
    assert sorted(run(odd), key=str) == expected_bpe(encoder, [r[:2] for r in ODD])
    assert run(odd.limit(0)) == []


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def expected_hits(docs, items, window=10):
    table = {}
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            table.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    sizes, out = {len(k) for k in table}, []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a : a + n])) in table:
                    hit.update(range(a, a + n))
                    found |= table[k]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_decontaminate_equals_brute_force(spark, small):
    got = sorted((tuple(r) for r in queries.op4_decontaminate(spark, small).collect()), key=str)
    want = expected_hits(rows(spark, small), rows(spark, small, "benchmark"))
    assert got == want and any(r[-1] for r in want)


def test_decontaminate_odd(spark):
    docs = [(1, "a b c d a b c d a b", None), (2, None, 1), (2, "", 1), (None, "b", 1), (2**53 + 1, "b", 2**53 + 3), (3, "zz a-B_c, q " * 40, 1), (3, "one two three four five six seven eight nine ten eleven", 1)]
    items = [(10, "A b C"), (11, None), (12, "  "), (13, "one two three four five six seven eight nine ten x"), (14, "a b c"), (15, "d a")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string, n_words long"), spark.createDataFrame(items, "item_id long, text string")
    ask = lambda d, b, **k: sorted((tuple(r) for r in decontaminate.digest(decontaminate.contamination(d.select("doc_id", "text"), b, **k)).collect()), key=str)
    want = expected_hits([r[:2] for r in docs], items)
    assert ask(df, bench) == want
    assert ask(df, bench, phrase_block=2) == want  # several passes
    assert all(r[2] == 0 for r in ask(df, bench.limit(0))) and ask(df.limit(0), bench) == []
    cut = {tuple(r) for r in decontaminate.decontaminated(df, bench).collect()}
    assert len(cut) == 7 and {(3, " eleven", 1), (1, " b", None), (2, None, 1), (2**53 + 1, "b", 2**53 + 3)} <= cut
    clash = df.withColumns({"text_": F.lit("x"), "word_spans": F.lit(1), "c0": F.lit(5)})
    got = decontaminate.contamination(clash, bench)
    assert got.columns == ["doc_id", "text", "text_", "c0", "n_words", "word_spans", "item_ids"]
    assert {(r["doc_id"], r["text_"], r["c0"]) for r in got.collect()} == {(d[0], "x", 5) for d in docs}
    assert sorted(map(tuple, decontaminate.digest(got).collect()), key=str) == want


def test_license_base_against_brute_force(spark, small):
    docs = rows(spark, small) + [(900, "Under the MIT license; under-the_mit\nlicense! cc by nc"), (901, None), (902, ""), (903, "xunder the mit license cc by ncx Apache License, Version 2.0")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("t", F.lit(1))
    got = {r["doc_id"]: r for r in license.scan(df).collect()}
    assert len(got) == len({d for d, _ in docs})
    phrases = {"mit": "under the mit license".split(), "apache-2": "apache license version 2".split(), "cc-by-nc": "cc by nc".split()}
    for i, t in docs:
        w = words(t)
        places = [(a, k) for k, p in phrases.items() for a in range(len(w)) if w[a : a + len(p)] == p]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({k for _, k in places}))
        assert {k for _, k in places} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3"),
        ("Licensed under the GNU General Public License, version 3.", "gpl-3"),  # the longer rule wins over the plain one
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
        ("released under the BSD-3 nothing", ""),
        ("licensed under the 3-clause BSD license", "bsd-3"),
        ("a limited permit", ""),
    ],
)
def test_license_rules(spark, text, labels):
    r = license.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert r["labels"] == labels and bool(r["score"]) == bool(labels)


def test_license_rules_are_many_and_ordered(spark):
    table = license.rules()
    assert len(table) > 390 and len(license._lines(license.NOTICES, 5)) > 110 and table == sorted(table, key=lambda r: r["priority"])
    assert license.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_token_counts(spark, odd, encoder):
    path, pattern = queries.vocabulary()
    n = sorted(len(encoder.encode_ordinary(t or "")) for _, t, _ in ODD)
    sums = tokens.suffix_sums(tokens.histogram(tokens.token_lengths(odd, path, pattern)))
    got = {r["context_limit"]: r for r in sums.collect()}
    assert sorted(got) == sorted(set(n))
    for limit, r in got.items():
        assert r["docs_at_least"] == sum(x >= limit for x in n) and r["tokens_at_least"] == sum(x for x in n if x >= limit)
        assert r["truncated_tokens"] == sum(min(x, limit) for x in n) and r["total_tokens"] == sum(n)
        assert r["quantile"] == sum(x <= limit for x in n) / len(n)
    for limit in (0, 3, 17, 10_000):
        assert tokens.truncated_total(sums, limit).collect()[0][0] == sum(min(x, limit) for x in n)
    assert tokens.quantile(sums, 0.5).collect()[0][0] == n[-(-len(n) // 2) - 1]
    assert tokens.suffix_sums(tokens.histogram(odd.limit(0).select(F.lit(1).alias("length")))).count() == 0


def test_license_gate_holds_for_every_rule():
    """What each rule's pattern must hold holds a gate's substring: its literal words, or the verbs of its template."""
    for template in license.TEMPLATES.strip().splitlines():
        assert any(x in template for x in ("licen", "spdx", ") under ("))
    for notice in license.NOTICES.strip().splitlines():
        for text in alternatives(re._parser.parse(notice.split("|", 4)[4])):
            assert any(g in text.lower() for g in license.GATE), text


def alternatives(parsed):
    """Strings that a parsed regex matches: every branch, optional parts with and without, other repeats at their least."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            new = [chr(arg)]
        elif name == "BRANCH":
            new = [x for branch in arg[1] for x in alternatives(branch)]
        elif name == "SUBPATTERN":
            new = alternatives(arg[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            new = [x * n for n in sorted({arg[0], 1}) for x in alternatives(arg[2])]
        elif name == "IN":
            new = {"LITERAL": lambda a: [chr(a)], "RANGE": lambda a: [chr(a[0])], "CATEGORY": lambda a: [" "]}[str(arg[0][0])](arg[0][1])
            new += [chr(x) for k, x in arg[1:] if str(k) == "LITERAL"]
        elif name in ("ASSERT", "ASSERT_NOT"):
            new = [""]
        elif name == "ANY":
            new = ["x"]
        else:
            raise ValueError(name)
        out = list(dict.fromkeys(a + b for a in out for b in new))
    return out


def test_license_keywords_hold_for_every_alternative():
    for label, keywords, name, _ in map(license._split_license, license.LICENSES.strip().splitlines()):
        for text in alternatives(re._parser.parse(name)):
            assert any(k in text.lower() for k in keywords.split(",")), (label, text)
    for r in license.rules():
        if r["pattern"].startswith("(?i)spdx"):
            assert r["keywords"] == ["spdx"]
    for _, _, label, keywords, pattern in license._lines(license.NOTICES, 5):
        for text in alternatives(re._parser.parse(pattern)):
            assert any(k in text for k in keywords.split(",")), (label, text)


def test_license_names_without_short_forms(spark):
    cases = [
        ("Licensed under Creative Commons Zero 1.0 Universal.", "cc0"),
        ("Licensed under zero.", "cc0"),
        ("This work is licensed under Creative Commons Attribution-ShareAlike 4.0.", "cc-by-sa"),
        ("licence: Creative Commons Attribution-NoDerivatives", "cc-by-nd"),
        ("Licence: Creative Commons Attribution", "cc-by"),
        ("Licensed Under CC-BY-SA 4.0", "cc-by-sa"),
    ]
    got = license.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()
    assert [r["labels"] for r in sorted(got, key=lambda r: r["doc_id"])] == [x for _, x in cases]


def test_token_counts_query(spark, small, encoder):
    n = sorted(len(encoder.encode_ordinary(t or "")) for _, t in rows(spark, small))
    got = queries.op8_token_counts(spark, small).collect()
    assert sorted(r["context_limit"] for r in got) == sorted(set(n))
    for r in got:
        limit = r["context_limit"]
        want = (n.count(limit), sum(x >= limit for x in n), sum(x for x in n if x >= limit), len(n), sum(n), sum(x <= limit for x in n) / len(n), sum(min(x, limit) for x in n))
        assert tuple(r[c] for c in ("n_docs", "docs_at_least", "tokens_at_least", "total_docs", "total_tokens", "quantile", "truncated_tokens")) == pytest.approx(want)


def resolved(text):
    """Labels, detections and score of the rules by plain loops over all matches."""
    every = []
    for r in license.rules():
        every += [(m.start(), m.end(), r["priority"], r["label"], r["weight"]) for m in re.finditer(r["pattern"], text, re.ASCII)]
    better = lambda a, b: (a[2:], a[:2]) < (b[2:], b[:2])
    inside = lambda a, b: b[0] <= a[0] and a[1] <= b[1] and (a[:2] != b[:2] or better(b, a))
    every = sorted(set(every))
    apart = [a for a in every if not any(inside(a, b) for b in every if b != a)]
    kept = []
    for d in sorted(apart, key=lambda d: (d[2], d[0])):
        if all(d[1] <= k[0] or k[1] <= d[0] for k in kept):
            kept.append(d)
    return sorted(kept)


def test_license_detections_against_plain_containment(spark):
    import random

    rng = random.Random(2)
    parts = ["Licensed under the ", "released under the terms of the ", "MIT", " license", "Apache License, Version 2.0", " ", "GNU General Public License v3", "SPDX-License-Identifier: ", "BSD-3-Clause", "the 3-clause BSD license", "license: ", "CC BY-NC 4.0", ". All rights reserved", "Copyright (c) 2024", "in accordance with the ", "permission is hereby granted, free of charge, to any person obtaining a copy", " placed in the public domain", " under the MIT license", "the ISC", "\n", "é", "either version 2 of the License, or (at your option) any later version", "you may not use this file except in compliance with the License", "https://creativecommons.org/licenses/by-nc-sa/4.0", "for non-commercial use only"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(300)] + ["licensed under the mit license " * 60]
    rows = license.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    several = 0
    for r in rows:
        want = resolved(texts[r["doc_id"]])
        assert [(d["start"], d["end"], d["priority"], d["label"], d["weight"]) for d in r["detections"]] == want
        base = {x for x in r["base_labels"].split(",") if x}
        assert r["labels"] == ",".join(sorted(base | {d[3] for d in want}))
        assert r["score"] == max([0.95 if r["n_base"] else 0.0, *(d[4] for d in want)])
        several += len(want) > 1
    assert several > 50


def test_notices_match_their_own_words(spark):
    """Every hand-written notice is found in a text that it matches, through gate and keywords."""
    cases = []
    for _, _, label, _, pattern in license._lines(license.NOTICES, 5):
        cases += [(label, "zz " + max(alternatives(re._parser.parse(pattern)), key=len) + " zz")]
    rows = license.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")).collect()
    found = {r["doc_id"]: {d["label"] for d in r["detections"]} for r in rows}
    lost = [cases[i] for i in found if not found[i]]
    assert len(cases) > 100 and not lost
    assert sum(cases[i][0] in found[i] for i in found) > 0.9 * len(cases)
