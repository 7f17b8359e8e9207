"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a fixed insult lexicon and of a lexicon learned from labelled texts (word beginnings
that toxic texts hold far more often), lexicon words near second-person words, capitals, punctuation, obfuscated
words, lengths. The model is fitted on about SAMPLE labelled rows, chosen by hash among the rows to learn from (never
over twice as many); a fifth of them is kept for the calibration, another fifth out of the lexicon, which holds at most
LEXICON word beginnings. Every text is scored whole.

Nulls count as empty texts, which are scored like any other. Labels that are null, or belong to no document, teach
nothing; an id with several labels counts as toxic if one of them is. Repeated rows are scored each and learnt once. If there are no
labels, or of one class only, every score is the share of toxic labels (0 without labels). Only id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberframe.llm.common import crc_mod, pick, sampled, stored

SAMPLE, TREES, DEPTH, RATE, BINS, LEXICON = 20_000, 40, 3, 0.2, 32, 2000
#: Insults, fixed values.
INSULTS = frozenset(
    "idiot idiots idiotic stupid moron morons moronic clown clowns pathetic worthless disgusting trash scum loser losers dumb "
    "imbecile cretin dimwit jerk bastard bitch crap damn fool foolish freak garbage gross hate hateful hideous ignorant "
    "insane lame liar lunatic maggot nasty parasite pig psycho rat retard rotten sick slob sucker twit ugly useless vermin "
    "vile wimp wretched degenerate filth filthy repulsive revolting shameful".split()
)
#: Second-person words of the four languages, fixed values.
SECOND = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine sie ihr tú ti usted ustedes vosotros".split())
NEAR = 4
#: Letters and digits, and the signs that stand in for letters within a word.
WORDS = re.compile(r"[^\W_]+(?:[@$!*#013457|]+[^\W_]+)*")
LEET = str.maketrans("013457@$!|", "oieastasil")
NAMES = (
    "insults", "insult_density", "learned", "learned_density", "learned_weight", "near_second", "second_density", "capitals", "shouted_words",
    "exclamations", "questions", "punctuation", "obfuscated", "obfuscated_insults", "stretched", "digits", "words", "word_length", "distinct_share",
)


def tokens(text: str) -> list[str]:
    return WORDS.findall(text)


def stems(text: str | None) -> set[str]:
    """Beginnings of words that may enter the learned lexicon."""
    return {w[:n] for w in tokens(text.lower()) for n in (5, 7) if len(w) >= n} if isinstance(text, str) else set()


def features(text: str | None, learned: dict[str, float]) -> list[float]:
    text = text if isinstance(text, str) else ""
    lower = text.lower()
    words = tokens(lower)
    n = max(1, len(words))
    plain = obfuscated = odd = stretched = 0
    at, weight, known = [], 0.0, 0
    get = learned.get
    for i, w in enumerate(words):
        if w in INSULTS:
            plain += 1
            at.append(i)
        elif not w.isalpha() and not w.isdigit():
            odd += 1
            if re.sub(r"[^a-z]", "", w.translate(LEET)) in INSULTS:
                obfuscated += 1
                at.append(i)
        if len(w) >= 5:
            x = get(w[:5], 0.0)
            if len(w) >= 7:
                x = max(x, get(w[:7], 0.0))
            if x:
                known += 1
                weight += x
    second = [i for i, w in enumerate(words) if w in SECOND]
    near = sum(any(abs(i - j) <= NEAR for j in second[max(0, k - 1) : k + 2]) for i, k in zip(at, np.searchsorted(second, at).tolist())) if second and at else 0
    stretched = len(re.findall(r"([^\W\d_])\1\1", lower))
    chars = max(1, len(text))
    capitals = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text))
    shouted = len(re.findall(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b", text))
    exclamations, questions = text.count("!"), text.count("?")
    punctuation = len(re.findall(r"[^\w\s]", text))
    digits = len(re.findall(r"[0-9]", text))
    return [
        plain + obfuscated, (plain + obfuscated) / n, known, known / n, weight / n, near / n, len(second) / n, capitals / chars, shouted / n,
        exclamations / n, questions / n, punctuation / chars, odd / n, obfuscated / n, stretched / n, digits / chars, np.log1p(len(words)), chars / n, len(set(words)) / n,
    ]


class Trees:
    """Boosted regression trees on the logistic loss, over features cut into quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, smooth: float = 5.0):
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        cuts = [np.unique(np.concatenate([np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1]), np.quantile(c[c > c.min()], np.linspace(0, 1, 9)) if (c > c.min()).any() else []])) for c in x.T]
        coded = np.stack([np.searchsorted(c, v, side="right") for c, v in zip(cuts, x.T, strict=True)], 1)
        raw, self.trees, n_bins = np.full(len(y), self.base), [], max(len(c) for c in cuts) + 1
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, p * (1 - p)
            node, tree = np.zeros(len(y), np.int64), []
            for level in range(depth):
                width = 1 << level
                split = []
                for f in range(x.shape[1]):
                    key = node * n_bins + coded[:, f]
                    gs = np.bincount(key, g, width * n_bins).reshape(width, n_bins).cumsum(1)
                    hs = np.bincount(key, h, width * n_bins).reshape(width, n_bins).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + smooth) + (gt - gs) ** 2 / (ht - hs + smooth) - gt**2 / (ht + smooth)
                    gain[:, len(cuts[f]) :] = 0
                    split.append((gain.max(1), gain.argmax(1)))
                gains = np.stack([s[0] for s in split])
                feature = gains.argmax(0)
                cut = np.array([split[f][1][i] for i, f in enumerate(feature)])
                cut[gains.max(0) <= 1e-9] = n_bins  # no split: all go left
                value = np.array([cuts[f][c] if c < len(cuts[f]) else np.inf for f, c in zip(feature, cut)])
                tree.append((feature, value))
                node = 2 * node + (x[np.arange(len(y)), feature[node]] >= value[node])
            leaf = -rate * np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + smooth)
            raw += leaf[node]
            self.trees.append((tree, leaf))

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, every = np.full(len(x), self.base), np.arange(len(x))
        for tree, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, value in tree:
                node = 2 * node + (x[every, feature[node]] >= value[node])
            out += leaf[node]
        return out


class Isotonic:
    """Rising step function through pooled neighbours, straight between their centres. Equal x are one point."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        points, at, n = np.unique(x, return_inverse=True, return_counts=True)
        blocks: list[list[float]] = []  # mean, weight, sum of x
        for xi, yi, ni in zip(points, np.bincount(at, y) / n, n.astype(float)):
            blocks.append([yi, ni, xi * ni])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                b = blocks.pop()
                a = blocks[-1]
                w = a[1] + b[1]
                blocks[-1] = [(a[0] * a[1] + b[0] * b[1]) / w, w, a[2] + b[2]]
        self.x, self.y = np.array([b[2] / b[1] for b in blocks]), np.array([b[0] for b in blocks])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.x, self.y)


class Model:
    def __init__(self, learned: dict[str, float], x: np.ndarray, y: np.ndarray, spare: np.ndarray):
        self.learned, self.share = learned, float(y.mean()) if len(y) else 0.0
        self.trees = self.curve = None
        if len(set(y[~spare])) == 2:
            self.trees = Trees(x[~spare], y[~spare])
            fit = spare if spare.any() else ~spare
            self.curve = Isotonic(self.trees.raw(x[fit]), y[fit])

    def score(self, texts) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        x = np.array([features(t, self.learned) for t in texts]).reshape(-1, len(NAMES))
        return np.clip(self.curve(self.trees.raw(x)), 0, 1)


def learned_lexicon(labelled: DataFrame, n_toxic: int, n_other: int, size: int = LEXICON) -> dict[str, float]:
    """Log-odds of word beginnings that toxic texts hold more often; at most `size` of them, those seen most surely."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts: dict[str, list[int]] = {}
            for t, y in zip(pdf["text"], pdf["toxic"]):
                for s in stems(t):
                    counts.setdefault(s, [0, 0])[y] += 1
            yield pd.DataFrame([(s, a, b) for s, (a, b) in counts.items()], columns=["stem", "other", "toxic"])

    share = (F.col("toxic") + 0.5) / (n_toxic + 1)
    rest = (F.col("other") + 0.5) / (n_other + 1)
    counted = labelled.mapInPandas(run, "stem string, other long, toxic long").groupBy("stem").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    sure = F.log(share / rest) / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("other") + 0.5))
    kept = counted.filter(F.col("toxic") >= 4).select("stem", F.log(share / rest).alias("odds"), sure.alias("sure")).filter((F.col("odds") > 1.5) & (F.col("sure") > 3.5))
    return {r["stem"]: r["odds"] for r in kept.orderBy(F.col("sure").desc(), "stem").limit(size).collect()}


def fit(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, lexicon: int = LEXICON) -> Model:
    """A model from the labels of rows where `learn` (over column doc_id) holds: about `sample` labelled ids, as many rows
    (at most twice as many, whatever repeats), and a learned lexicon of at most `lexicon` word beginnings."""
    spark = docs.sparkSession
    given = pick(labels, doc_id=doc_id, toxic=label).filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).filter(learn)
    given = given.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    given = sampled(given, sample, "doc_id")  # bounded, so it may be broadcast
    rows = pick(docs, doc_id=doc_id, text=text).join(F.broadcast(given), "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)).cast("int"))
    counts = {r["toxic"]: r["count"] for r in rows.filter("part > 1").groupBy("toxic").count().collect()}
    learned = learned_lexicon(rows.filter("part > 1"), counts.get(1, 0), counts.get(0, 0), lexicon) if len(counts) == 2 else {}
    held = spark.sparkContext.broadcast(learned)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "part": pdf["part"], "x": [features(t, held.value) for t in pdf["text"]]})

    found = rows.mapInPandas(run, T.StructType([rows.schema["doc_id"], T.StructField("toxic", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))]))
    # An id may stand on any number of rows: those with equal features count once, and a sample of them is learnt from.
    got = sorted(sampled(stored(found.distinct(), "toxicity-features"), sample, "doc_id", "x").collect(), key=str)
    x = np.array([r["x"] for r in got]).reshape(-1, len(NAMES))
    return Model(learned, x, np.array([r["toxic"] for r in got], dtype=np.int64), np.array([r["part"] == 0 for r in got], dtype=bool))


def scored(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """docs with the column `into`: the probability that a text is toxic."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(held.value.score(list(texts)))

    return docs.withColumn(into, score(F.col(f"`{text}`").cast("string")))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted); labels of rows whose crc32(doc_id) mod folds is 0 are never learnt from."""
    model = fit(docs, labels, crc_mod("doc_id", folds) != 0)
    held_out = (crc_mod("doc_id", folds) == 0).alias("held_out")
    return scored(pick(docs, doc_id="doc_id", text="text"), model).select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
