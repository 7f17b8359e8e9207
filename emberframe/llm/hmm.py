"""Language-model scores by a hidden Markov model over all words of the corpus.

A word's probability is that of its class in the current latent state times its share of the class. Each of the most
frequent words (up to about FREQUENT) has a class of its own, so the states see the words themselves; the others are
classed by hashed beginnings and endings. The shares come from exact counts of every word of the training texts. So the
state parameters stay small enough to broadcast, while the word counts stay distributed: words travel to the bucket of
their hash, are counted there, and their counts travel back to the blocks of documents that hold them.

Baum-Welch runs over all training texts, each as a whole: a task sums its expected counts, the sums are added in a tree,
and only they reach the driver. Texts are walked side by side; one of over WALK tokens is walked in stretches at once,
which first exchange exact forward and backward messages (products of their transfer matrices), so nothing is cut.
Scores come from the same scaled forward recursion over the whole text.

The first model leans each state towards the class shares of one training text. It is chosen among START_TEXTS distinct
ones (by their classes) that come first by hash over all training rows of all blocks, those of over LONG tokens before
shorter ones; texts without words are left out. Each state gets a small fixed perturbation of its own, so that states
differ even when there are fewer distinct texts than states. Neither it nor the rounds depend on how rows lie in files.

Nulls count as empty texts, which hold only the end. Repeated rows and ids are counted and scored row by row; ids may be
any long. A table without training rows gives every token the probability of an unseen one. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import block_number, blocks, bounded_batches, crc_mod, even_keys, id_list, pack, pack_words, partitions, ragged, stored, unpack, unpack_words

CLASSES, FREQUENT, STATES, ROUNDS, AFFIX = 4096, 16_384, 8, 5, 3
#: The class of the end; those of frequent words follow.
END = CLASSES
#: A frequent word occurs at least so often.
LEAST = 8
#: Tokens of the longest text that is walked in one piece; tokens of a stretch of a longer one.
WALK, STRETCH = 2048, 128
BLOCK = 6 << 20
#: Distinct training texts the first model chooses from; tokens of a text that counts as long; how far a start is perturbed.
START_TEXTS, LONG, PERTURBED = 512, 50, 0.1
#: Tokens of the overall shares that each state is smoothed with.
SMOOTH = 10
CUT = "block long, bucket int, ids array<string>, held array<boolean>, counts array<int>, words binary, learned binary, places binary"
TALLIED = "block long, bucket int, ids array<string>, held array<boolean>, counts array<int>, known binary, classes binary, fine binary, places binary, histogram binary"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []


def class_of(word: bytes) -> int:
    return zlib.crc32(word[:AFFIX] + b" " + word[-AFFIX:]) % CLASSES


def own_class(word: bytes) -> int:
    """Class of a frequent word. Two may meet in one, where they have their shares like others."""
    return END + 1 + zlib.crc32(word, 1) % FREQUENT


def octaves(counts: np.ndarray) -> np.ndarray:
    """Bin of each count, eight a doubling."""
    return np.floor(8 * np.log2(counts)).astype(np.int64)


def cut(keys: list[int]):
    """Words of documents by block: one row with the places, and one a bucket with its words and their training counts."""
    buckets = len(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for n, pdf in enumerate(blocks(batches, limit=BLOCK)):
            block, number, places = block_number(n), {}, []
            for text in pdf["text"]:
                places.append(np.array([number.setdefault(w, len(number)) for w in words_of(text)], dtype=np.uint32))
            counts, held = np.array([len(x) for x in places]), pdf["held"].to_numpy(dtype=bool)
            flat, words = np.concatenate(places), list(number)
            del places, number
            total = np.bincount(flat, minlength=len(words))
            learned = np.bincount(flat[np.repeat(~held, counts)], minlength=len(words))
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
            order = np.lexsort((-total, bucket))
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words), dtype=np.uint32)
            ids = id_list(pdf["doc_id"])
            rows = [(block, keys[zlib.crc32(str(block).encode()) % buckets], ids, held.tolist(), counts.tolist(), None, None, pack(rank[flat]))]
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(edges)):
                own = order[edges[b] : edges[b + 1]]
                rows.append((block, keys[b], None, None, None, pack_words([words[i] for i in own]), pack(learned[own]), None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CUT.split(", ")])

    return run


def shaped(pdf: pd.DataFrame) -> pd.DataFrame:
    """pdf with all columns of TALLIED, null where it has none."""
    return pd.DataFrame({c: pdf[c] if c in pdf else pd.Series([None] * len(pdf), index=pdf.index, dtype=object) for c in (x.split()[0] for x in TALLIED.split(", "))})


def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts each word of the task's buckets over all blocks, then answers every block. Adds one row (block -1) with the
    counts and classes of the words themselves, and how many there are of each count."""
    counts: dict[bytes, int] = {}
    held = []
    for pdf in batches:
        heads = pdf[pdf["words"].isna()]
        if len(heads):
            yield shaped(heads)
        for block, bucket, words, learned in pdf.loc[pdf["words"].notna(), ["block", "bucket", "words", "learned"]].itertuples(index=False):
            held.append((block, bucket, words))
            for w, c in zip(unpack_words(words), unpack(learned).tolist()):
                counts[w] = counts.get(w, 0) + c

    def answer(block: int, bucket: int, words: list[bytes], **more: list) -> pd.DataFrame:
        known = np.fromiter((counts[w] for w in words), np.int64, len(words))
        coarse = np.fromiter(map(class_of, words), np.uint32, len(words))
        fine = np.fromiter((own_class(w) if c >= LEAST else 0 for w, c in zip(words, known.tolist())), np.uint32, len(words))
        return shaped(pd.DataFrame({"block": [block], "bucket": [bucket], "known": [zlib.compress(known.tobytes(), 1)], "classes": [pack(coarse)], "fine": [pack(fine)], **more}))

    for block, bucket, words in held:
        yield answer(block, bucket, unpack_words(words))
    words = [w for w, c in counts.items() if c]
    if words:
        bins = np.bincount(octaves(np.array([counts[w] for w in words])), minlength=512).astype(float)
        yield answer(-1, 0, words, histogram=[bins.tobytes()])


def frequent_from(histogram: np.ndarray | None) -> int:
    """The smallest count from which on there are at most FREQUENT words, by bins."""
    if histogram is None:
        return LEAST
    above = np.cumsum(histogram[::-1])[::-1]
    return max(LEAST, int(np.ceil(2 ** (int((above > FREQUENT).sum()) / 8))))


def chosen_classes(known: bytes, classes: bytes, fine: bytes, frequent: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and classes of words whose own class counts from `frequent` occurrences on."""
    c = np.frombuffer(zlib.decompress(known), np.int64)
    return c, np.where(c >= frequent, unpack(fine), unpack(classes))


def class_sums(frequent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, END + 1 + FREQUENT))
        for pdf in batches:
            for row in pdf[["known", "classes", "fine"]].itertuples(index=False):
                c, k = chosen_classes(*row, frequent)
                total += [np.bincount(k, c, total.shape[1]), np.bincount(k, minlength=total.shape[1])]
        yield pd.DataFrame({"sums": [total.tobytes()]})

    return run


@dataclass
class Corpus:
    """Sizes of the training texts, ends included, and of each class."""

    tokens: int
    distinct: int
    ends: int
    class_tokens: np.ndarray
    class_words: np.ndarray

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.tokens + self.distinct + 1))

    def within(self, c: np.ndarray, k: np.ndarray) -> np.ndarray:
        """log10 of a word's share of its class; all unseen words of a class share one place."""
        return np.log10((c + 1) / (self.class_tokens[k] + self.class_words[k] + 1))


def start_keys(held: np.ndarray, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Of each text: a hash of its classes, larger for short texts than for any long one; infinite if it can't be a start."""
    at = np.concatenate([[0], np.cumsum(counts)])
    out = np.full(len(counts), np.inf)
    for i in np.flatnonzero(~held & (counts > 1)).tolist():
        h = int.from_bytes(blake2b(classes[at[i] : at[i + 1]].tobytes(), digest_size=8).digest(), "little") >> 12
        out[i] = h + (0 if counts[i] > LONG else 1 << 52)  # below 2^53, exact as a double
    return out


def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest START_TEXTS distinct keys of both."""
    return np.union1d(a, b)[:START_TEXTS]


BLOCKS = "block long, ids array<string>, held array<boolean>, counts array<int>, known array<long>, base array<double>, within array<double>, classes binary, starts binary"


def coded(corpus: Corpus, frequent: int):
    """A block's words and counts to its documents' sums and class sequences, each closed by the end."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        head = rows[rows["places"].notna()].iloc[0]
        parts = rows[rows["known"].notna()].sort_values("bucket")
        own = [chosen_classes(*x, frequent) for x in parts[["known", "classes", "fine"]].itertuples(index=False)] or [(np.zeros(0, np.int64), np.zeros(0, np.uint32))]
        c, k = (np.concatenate(x) for x in zip(*own))
        places, counts = unpack(head["places"]), np.asarray(head["counts"], dtype=np.int64)
        ends = np.cumsum(counts)
        sums = [np.diff(np.concatenate([[0.0], np.cumsum(x[places])])[np.concatenate([[0], ends])]) for x in ((c > 0).astype(float), corpus.base(c), corpus.within(c, k))]
        end = np.array([corpus.ends])
        classes = np.full(len(places) + len(counts), END, np.uint32)
        inside = np.ones(len(classes), bool)
        inside[ends + np.arange(len(ends))] = False
        classes[inside] = k[places]
        keys = start_keys(np.asarray(head["held"], dtype=bool), counts + 1, classes)
        return pd.DataFrame({
            "block": [head["block"]], "ids": [head["ids"]], "held": [head["held"]], "counts": [counts + 1],
            "known": [sums[0].round().astype(np.int64) + int(corpus.ends > 0)], "base": [sums[1] + corpus.base(end)], "within": [sums[2] + corpus.within(end, np.array([END]))], "classes": [pack(classes)],
            "starts": [least(keys[np.isfinite(keys)], np.zeros(0)).tobytes()],
        })

    return run


@dataclass
class Model:
    start: np.ndarray  # of a text's first state
    move: np.ndarray  # (state, next state)
    emit: np.ndarray  # (class, state): probability of the class in the state


def first_model(overall: np.ndarray, texts: list[np.ndarray], states: int = STATES) -> Model:
    """States that lean towards the class shares of texts as unlike each other as can be found among `texts`, each perturbed."""
    shares = np.array([0.5 * overall + 0.5 * np.bincount(x, minlength=len(overall)) / len(x) for x in texts if len(x)] or [overall])
    roots = np.sqrt(shares)
    picked = [int((roots @ np.sqrt(overall)).argmin())]
    while len(picked) < states:
        near = (roots @ roots[picked].T).max(1)
        picked.append(int(near.argmin()) if len(picked) < len(shares) else picked[len(picked) % len(shares)])
    even = np.full(states, 1 / states)
    emit = shares[picked].T * (1 + PERTURBED * np.random.default_rng(1).uniform(-1, 1, (len(overall), states)))
    return Model(even, 0.9 * np.eye(states) + 0.1 / states, emit / emit.sum(0))


class Walk:
    """Texts side by side, in units: a whole text, or a stretch of one of over WALK tokens. Units stand longest first;
    tokens are numbered by step, then unit, so that each step's live units are one slice."""

    def __init__(self, counts: np.ndarray, classes: np.ndarray, m: Model, kind: type = np.float32):
        self.start, self.move = m.start.astype(kind), m.move.astype(kind)
        pieces = np.where(counts > WALK, -(-counts // STRETCH), 1)
        text, nth = np.repeat(np.arange(len(counts)), pieces), ragged(np.zeros(len(counts), np.int64), pieces)
        cut = pieces[text] > 1
        length = np.where(cut, np.minimum(STRETCH, counts[text] - nth * STRETCH), counts[text])
        order = np.argsort(-length, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.text, self.nth, self.length = text[order], nth[order], length[order]
        self.before = np.where(self.nth > 0, place[order - (self.nth > 0)], -1)  # the unit that each one continues
        at = (np.cumsum(counts) - counts)[self.text] + self.nth * np.where(cut[order], STRETCH, 0)
        self.live = np.searchsorted(-self.length, -np.arange(int(self.length.max(initial=0))), side="left")
        self.edge = np.concatenate([[0], np.cumsum(self.live)])
        unit = ragged(np.zeros(len(self.live), np.int64), self.live)
        self.symbols = classes[at[unit] + np.repeat(np.arange(len(self.live)), self.live)]
        self.b = m.emit.astype(kind)[self.symbols]
        self.last = self.edge[self.length - 1] + np.arange(len(self.length))  # each unit's last token
        self.prior = np.tile(self.start, (len(self.length), 1))  # of the first token's state
        self.behind = np.ones_like(self.prior)  # likelihood of all that follows a unit, by its last state
        if len(chain := np.flatnonzero(cut[order])):
            self.exchange(chain)

    def exchange(self, chain: np.ndarray) -> None:
        """Messages between the stretches of long texts."""
        k, edge, b = len(self.start), self.edge, self.b
        own, n_live = self.length[chain], np.searchsorted(-self.length[chain], -np.arange(int(self.length[chain[0]])), side="left")
        through = np.eye(k, dtype=b.dtype) * b[chain][:, None, :]  # from a stretch's first state to its last
        for t in range(1, int(own[0])):
            n = n_live[t]
            x = (through[:n].reshape(-1, k) @ self.move).reshape(n, k, k) * b[edge[t] + chain[:n]][:, None, :]
            through[:n] = x / x.sum((1, 2), keepdims=True)
        number = np.full(len(self.length), -1)
        number[chain] = np.arange(len(chain))
        rounds = [np.flatnonzero((self.nth == i) & (self.before >= 0)) for i in range(1, int(self.nth.max()) + 1)]
        for u in rounds:
            x = np.einsum("ni,nij->nj", self.prior[self.before[u]], through[number[self.before[u]]]) @ self.move
            self.prior[u] = x / x.sum(1, keepdims=True)
        for u in reversed(rounds):
            x = np.einsum("nij,nj->ni", through[number[u]], self.behind[u]) @ self.move.T
            self.behind[self.before[u]] = x / x.sum(1, keepdims=True)

    def forward(self, keep: bool) -> tuple[np.ndarray | None, np.ndarray]:
        """Scaled forward probabilities of all tokens (if kept), and their scales."""
        alpha, scale, now = np.empty_like(self.b) if keep else None, np.empty(len(self.b), self.b.dtype), self.prior
        for t, n in enumerate(self.live.tolist()):
            a, z = self.edge[t], self.edge[t + 1]
            now = (now[:n] @ self.move if t else now) * self.b[a:z]
            s = now.sum(1)
            now /= s[:, None]
            scale[a:z] = s
            if keep:
                alpha[a:z] = now
        return alpha, scale

    def expected(self, n_class: int) -> np.ndarray:
        """Expected starts, moves and emissions, as one flat array; last, the log-likelihood."""
        k = len(self.start)
        alpha, scale = self.forward(keep=True)
        ahead, beta = self.b / scale[:, None], np.empty_like(self.b)
        end = self.behind / (alpha[self.last] * self.behind).sum(1, keepdims=True)
        move, n_after = np.zeros((k, k)), 0
        for t in range(len(self.live) - 1, -1, -1):
            a, z, n = self.edge[t], self.edge[t + 1], int(self.live[t])
            now = beta[a:z]
            now[n_after:] = end[n_after:n]
            if n_after:
                x = ahead[z : z + n_after]
                now[:n_after] = x @ self.move.T
                move += alpha[a : a + n_after].T @ x
            ahead[a:z] *= now
            n_after = n
        joined = np.flatnonzero(self.before >= 0)
        if len(joined):
            move += alpha[self.last[self.before[joined]]].T @ ahead[joined]
        alpha *= beta  # the states' probabilities, given the whole text
        emit = np.stack([np.bincount(self.symbols, alpha[:, j], n_class) for j in range(k)], 1)
        start = alpha[: len(self.length)][self.nth == 0].sum(0, dtype=np.float64)
        return np.concatenate([start, (move * self.move).ravel(), emit.ravel(), [np.log(scale.astype(np.float64)).sum()]])


def portions(counts: np.ndarray, classes: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(texts, counts, classes): the texts longest first, about `limit` tokens at once."""
    at, order = np.cumsum(counts) - counts, np.argsort(-counts, kind="stable")
    part = (np.cumsum(counts[order]) - counts[order]) // limit
    for own in np.split(order, np.flatnonzero(np.diff(part)) + 1):
        if len(own):
            yield own, counts[own], classes[ragged(at[own], counts[own])]


#: Tokens that are walked at once.
PORTION = 400_000


def expected_counts(counts: np.ndarray, classes: np.ndarray, m: Model) -> np.ndarray:
    """Expected starts, moves and emissions of whole texts, as one flat array; last, the log-likelihood."""
    total = np.zeros(m.start.size + m.move.size + m.emit.size + 1)
    for _, n, symbols in portions(counts, classes, PORTION):
        total += Walk(n, symbols, m).expected(len(m.emit))
    return total


def improved(m: Model, sums: np.ndarray, overall: np.ndarray) -> Model:
    k, n_class = len(m.start), len(m.emit)
    start, move, emit = sums[:k], sums[k : k + k * k].reshape(k, k), sums[k + k * k : -1].reshape(n_class, k)
    used = emit.sum(0)
    emit = (emit + SMOOTH * overall[:, None]) / (used + SMOOTH)
    return Model((start + 0.1) / (start.sum() + 0.1 * k), (move + 0.1) / (move.sum(1, keepdims=True) + 0.1 * k), emit)


def added(sums: DataFrame, join: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add) -> np.ndarray | None:
    """Sum (or another `join`) of the arrays in column `sums`, in a tree of 16 branches a level, to the driver."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            for x in pdf["sums"]:
                total = np.frombuffer(x).copy() if total is None else join(total, np.frombuffer(x))
        if total is not None:
            yield pd.DataFrame({"sums": [total.tobytes()]})

    n = sums.rdd.getNumPartitions()
    while n > 16:
        n = max(4, -(-n // 16))
        sums = sums.repartition(n).mapInPandas(add, "sums binary")
    got = [np.frombuffer(r["sums"]) for r in sums.collect()]
    return reduce(join, got) if got else None


def start_texts(texts: DataFrame) -> list[np.ndarray]:
    """Class sequences, sorted, of the START_TEXTS training texts whose keys are the smallest of all blocks."""
    keys = added(texts.select(F.col("starts").alias("sums")), least)
    if keys is None or not len(keys):
        return []
    chosen = texts.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[float] = set()
        for pdf in batches:
            for held, counts, packed, starts in pdf.itertuples(index=False):
                own = set(np.intersect1d(np.frombuffer(starts), chosen.value).tolist()) - seen
                if not own:
                    continue
                counts, classes = np.asarray(counts, dtype=np.int64), unpack(packed)
                at, rows = np.concatenate([[0], np.cumsum(counts)]), []
                for i, key in enumerate(start_keys(np.asarray(held, dtype=bool), counts, classes).tolist()):
                    if key in own:
                        own.remove(key)
                        seen.add(key)
                        c, n = np.unique(classes[at[i] : at[i + 1]], return_counts=True)
                        rows.append((key, pack(c), pack(n)))
                yield pd.DataFrame(rows, columns=["key", "classes", "n"])

    found = texts.select("held", "counts", "classes", "starts").mapInPandas(run, "key double, classes binary, n binary")
    rows = found.groupBy("key").agg(F.first(F.struct("classes", "n")).alias("x")).collect()  # equal for equal keys
    return [np.repeat(unpack(r["x"]["classes"]), unpack(r["x"]["n"])) for r in sorted(rows, key=lambda r: r["key"])]


def baum_welch(texts: DataFrame, m: Model, overall: np.ndarray, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """The model after `rounds` rounds over all training texts in `texts`, and each round's log-likelihood before it."""
    seen = []
    for _ in range(rounds):
        held = texts.sparkSession.sparkContext.broadcast(m)

        def expect(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            total = None
            for pdf in batches:
                for out, counts, classes in pdf[["held", "counts", "classes"]].itertuples(index=False):
                    learn, counts = ~np.asarray(out, dtype=bool), np.asarray(counts, dtype=np.int64)
                    x = expected_counts(counts[learn], unpack(classes)[np.repeat(learn, counts)], held.value)
                    total = x if total is None else total + x
            if total is not None:
                yield pd.DataFrame({"sums": [total.tobytes()]})

        sums = added(texts.select("held", "counts", "classes").mapInPandas(expect, "sums binary"))
        if sums is None:
            break
        seen.append(float(sums[-1]))
        m = improved(m, sums, overall)
    return m, seen


def log10_likelihoods(counts: np.ndarray, classes: np.ndarray, m: Model) -> np.ndarray:
    """Exact log10 probability of each text's class sequence by the scaled forward recursion."""
    out = np.zeros(len(counts))
    for own, n, symbols in portions(counts, classes, PORTION):
        w = Walk(n, symbols, m, np.float64)
        unit = ragged(np.zeros(len(w.live), np.int64), w.live)
        out[own] = np.bincount(w.text[unit], np.log10(w.forward(keep=False)[1]), len(n))
    return out


def score(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row; `held_out` is over doc_id."""
    spark = docs.sparkSession
    n = partitions(spark)
    bounded_batches(spark)
    rows = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), docs[f"`{text}`"].cast("string").alias("text"))
    rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held"))
    tallied = stored(rows.mapInPandas(cut(even_keys(spark, n)), CUT).repartition(n, "bucket").mapInPandas(tally, TALLIED), "hmm-counts")
    own = tallied.filter("block = -1")
    frequent = frequent_from(added(own.select(F.col("histogram").alias("sums"))))
    class_tokens, class_words = added(own.select("known", "classes", "fine").mapInPandas(class_sums(frequent), "sums binary")).round().astype(np.int64).reshape(2, -1)
    ends = tallied.filter("held is not null").select(F.sum(F.size(F.filter("held", lambda x: ~x)))).first()[0] or 0
    class_tokens[END], class_words[END] = ends, int(ends > 0)
    corpus = Corpus(int(class_tokens.sum()), int(class_words.sum()), ends, class_tokens, class_words)
    overall = (class_tokens + 1) / (class_tokens + 1).sum()

    texts = stored(tallied.filter("block >= 0").select("block", "bucket", "ids", "held", "counts", "known", "classes", "fine", "places").groupBy("block").applyInPandas(coded(corpus, frequent), BLOCKS), "hmm-texts")
    model, _ = baum_welch(texts, first_model(overall, start_texts(texts)), overall, rounds)
    shared = spark.sparkContext.broadcast(model)

    def final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                counts = np.asarray(r.counts, dtype=np.int64)
                forward = log10_likelihoods(counts, unpack(r.classes), shared.value)
                yield pd.DataFrame({
                    "doc_id": id_list(r.ids), "held_out": np.asarray(r.held, dtype=bool), "n_tokens": counts, "n_known": np.asarray(r.known),
                    "train_tokens": corpus.tokens, "base_score": np.asarray(r.base), "score": forward + np.asarray(r.within),
                })

    out = texts.mapInPandas(final, "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def held_out(folds: int = 7, fold: int = 2) -> Column:
    return crc_mod("doc_id", folds) == fold
