"""Spelling variants by reduced alphabets.

Letters are hashed to SYMBOLS symbols, so a word has a reduced word, and words at most one edit apart have reduced words at
most one edit apart. Each word generates the full neighbourhood of its reduced word (itself, and every deletion,
replacement and insertion of one symbol), as 64-bit keys; these are joined with the keys of all reduced words, and the
pairs that meet are verified on the original strings. Keys that no reduced word has mostly don't travel: a bitmap of
2^BITS bits (8 MB, whatever the vocabulary; the fuller it is, the less it holds back) marks the hashes of those there are. An edit of a reduced word stands for some ninety letters divided
by SYMBOLS, so the neighbourhood is that much smaller than a word's own.

A reduced word that more than HOT words share would meet its neighbours' words as pairs. Such keys are taken out of
that join; whoever reaches one makes keys over all letters of the edits that lead there, and these are joined with the keys of
the words themselves: rows grow with the words, not with their pairs, and nothing is left out.

Words are counted in each task first. Keys of different words may be equal by chance; verification drops such pairs.

Nulls and texts without words add nothing; an empty table gives an empty result. Null ids count as empty text where the
id enters a hash. Repeated rows count each time. Words may be long: a word of n letters has about 2 * SYMBOLS * n keys.
Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import id_and_text, stored

SYMBOLS, HOT, BITS = 8, 64, 26
#: Words that a task counts before it passes its counts on.
HELD = 200_000
#: Keys that are made at a time.
KEYS = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
#: The letters of words, fixed values: a to z, and U+00C0 to U+00FF.
LETTERS = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]


def word_counts(docs: DataFrame, least: int = 7, every: int = 31, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): maximal runs of letters, A to Z lower-cased, one of `every` of a document's runs (by hash of id and run)
    without one of its letters; words of `least` letters and more, with their number in all documents."""
    run_of = re.compile(f"[a-zÀ-ÿ]{{{least},}}")

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, int] = {}
        flushed = lambda: pd.DataFrame({"word": pd.Series(list(held), dtype=object), "n": pd.Series(list(held.values()), dtype="int64")})
        for pdf in batches:
            for i, t in zip(pdf["doc_id"], pdf["text"]):
                if not isinstance(t, str):
                    continue
                head = zlib.crc32(f"{i if isinstance(i, str) else ''}:".encode())
                for w, n in Counter(run_of.findall(t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))).items():
                    h = zlib.crc32(w.encode(), head)
                    if not h % every:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                        if len(w) < least:
                            continue
                    held[w] = held.get(w, 0) + n
            if len(held) > HELD:
                yield flushed()
                held = {}
        yield flushed()

    return id_and_text(docs, doc_id, text).mapInPandas(tally, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def symbols(points: np.ndarray) -> np.ndarray:
    """Symbols (from 0) of code points."""
    return ((points.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(16)) % np.uint32(SYMBOLS)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _reduced(words: list[str]) -> np.ndarray:
    """Symbols from 1 of words of one length, as a matrix of 64-bit numbers."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return symbols(points).astype(np.uint64).reshape(len(words), -1) + np.uint64(1)


def _edits(s: np.ndarray) -> np.ndarray:
    """Keys of the neighbourhoods of reduced words of one length n (rows): the word itself, n deletions, n * SYMBOLS
    replacements (by position, then symbol; some change nothing), (n + 1) * SYMBOLS insertions."""
    rows, n = s.shape
    power = _powers(n + 1)
    weighted = s * power[:n]
    before = np.zeros((rows, n + 1), np.uint64)
    np.cumsum(weighted, 1, out=before[:, 1:])
    whole = before[:, -1:]
    every = np.arange(1, SYMBOLS + 1, dtype=np.uint64)
    gone = before[:, :-1] + (whole - before[:, 1:]) * np.uint64(_BACK)
    other = whole[:, :, None] + (every - s[:, :, None]) * power[:n, None]
    more = before[:, :, None] + every * power[:, None] + ((whole - before) * np.uint64(_BASE))[:, :, None]
    return np.hstack([whole, gone, other.reshape(rows, -1), more.reshape(rows, -1)])


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(places, words) of one length each, not too many at a time. Words may not be empty."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(words) else ():
        step = max(1, KEYS // (2 * SYMBOLS * int(size[own[0]]) + SYMBOLS + 1))
        for i in range(0, len(own), step):
            yield own[i : i + step], [words[j] for j in own[i : i + step]]


def reduced_keys(words: list[str]) -> np.ndarray:
    out = np.zeros(len(words), np.uint64)
    for at, own in _by_length(words):
        s = _reduced(own)
        out[at] = (s * _powers(s.shape[1])).sum(1, dtype=np.uint64)
    return out.view(np.int64)


def slots(keys: np.ndarray) -> np.ndarray:
    """Places of keys in the bitmap."""
    return ((keys.view(np.uint64) * np.uint64(_BASE)) >> np.uint64(64 - BITS)).astype(np.int64)


def neighbour_keys(words: list[str], bits: np.ndarray | None = None) -> list[np.ndarray]:
    """The different keys of each word's neighbourhood, its own included; with a bitmap, those that it marks."""
    out: list = [None] * len(words)
    for at, own in _by_length(words):
        keys = _edits(_reduced(own)).view(np.int64)
        if bits is not None:
            place = slots(keys)
            marked = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
        for k, i in enumerate(at.tolist()):
            out[i] = np.unique(keys[k] if bits is None else keys[k][marked[k]])
    return out


def _points(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def full_key(word: str) -> int:
    x = _points(word)
    return int((x * _powers(len(x))).sum(dtype=np.uint64).view(np.int64)) if len(x) else 0


def finer_keys(word: str, key: int) -> np.ndarray:
    """Full keys of the words that the edits of `word` which lead to the reduced key stand for."""
    s, x = _reduced([word]), _points(word)
    n, power = len(x), _powers(len(x) + 1)
    letters = np.array(LETTERS, np.uint64)
    of = [letters[symbols(letters) == i] for i in range(SYMBOLS)]
    before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * power[:n], dtype=np.uint64)])
    whole, out = before[-1], [np.zeros(0, np.uint64)]
    for e in np.flatnonzero(_edits(s).view(np.int64)[0] == key).tolist():
        if 1 <= e <= n:
            out.append(before[e - 1 : e] + (whole - before[e : e + 1]) * np.uint64(_BACK))
        elif n < e <= n + n * SYMBOLS:
            i, own = divmod(e - 1 - n, SYMBOLS)
            out.append(whole + (of[own] - x[i]) * power[i])
        elif e:
            i, own = divmod(e - 1 - n - n * SYMBOLS, SYMBOLS)
            out.append(before[i] + of[own] * power[i] + (whole - before[i : i + 1]) * np.uint64(_BASE))
    return np.unique(np.concatenate(out)).view(np.int64)


def bitmap(slot_table: DataFrame) -> np.ndarray:
    """A bit for each slot of the table."""
    bits = np.zeros(1 << (BITS - 3), np.uint8)
    at = F.col("slot") + 1  # Spark's bitmaps begin at one, and are as long as those of an integer's low 15 bits
    for r in slot_table.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("x")).toLocalIterator():
        own = np.frombuffer(bytes(r["x"]), np.uint8)
        bits[(r["b"] - 1) * len(own) : r["b"] * len(own)] = own
    return bits


def near_pairs(words: DataFrame, hot: int = HOT) -> DataFrame:
    """(word, near, n): all pairs of words (word, n) that differ by exactly one inserted, deleted or replaced letter, in both
    directions, with the count of the near one. Words must be different and not empty."""
    spark = words.sparkSession

    @F.pandas_udf("key long, slot long")
    def own_key(column: pd.Series) -> pd.DataFrame:
        keys = reduced_keys(list(column))
        return pd.DataFrame({"key": keys, "slot": slots(keys)})

    vocabulary = stored(words.select(F.col("word").alias("near"), "n", own_key("word").alias("k")).select("near", "n", "k.*"), "variant-vocabulary")
    bits = spark.sparkContext.broadcast(bitmap(vocabulary))

    @F.pandas_udf("array<long>")
    def keys(column: pd.Series) -> pd.Series:
        return pd.Series(neighbour_keys(list(column), bits.value), dtype=object)

    @F.pandas_udf("long")
    def whole_key(column: pd.Series) -> pd.Series:
        return pd.Series([full_key(w) for w in column], dtype="int64")

    @F.pandas_udf("array<long>")
    def finer(word: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series([finer_keys(w, int(k)) for w, k in zip(word, key)], dtype=object)

    sizes = vocabulary.groupBy("key").agg(F.count("*").alias("held"))
    often = stored(sizes.filter(F.col("held") > hot).select("key"), "variant-hot")
    # the planner takes the keys for no larger than the words, and would broadcast them: they are many times as large
    around = words.select("word", F.explode(keys("word")).alias("key")).hint("merge")
    near: Column = F.levenshtein("word", "near", 1) == 1
    if often.isEmpty():
        return around.join(vocabulary, "key").filter(near).select("word", "near", "n")
    plain = around.join(vocabulary.join(often, "key", "left_anti"), "key").select("word", "near", "n")
    held = vocabulary.join(often, "key", "left_semi").select("near", "n", whole_key("near").alias("full"))
    reached = around.join(often, "key", "left_semi").select("word", F.explode(finer("word", "key")).alias("full")).hint("merge")
    exact = reached.join(held, "full").select("word", "near", "n")
    return plain.unionByName(exact).filter(near)


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root): what a word's chain of forms (word, form) ends in. Steps double, until no chain goes on."""
    state = stored(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        on = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = stored(state.join(on, "root", "left"), "variant-roots")
        state = longer.select("word", F.coalesce("further", "root").alias("root"))
        if longer.filter("further IS NOT NULL").isEmpty():
            return state


def grouped(words: DataFrame, times: int = 10, hot: int = HOT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n): how many words are near, the most frequent of them if it
    has at least `times` the word's own count (ties: the first by code points), and the last form of that chain."""
    words = stored(words, "variant-words")
    first = F.min(F.struct((-F.col("n")).alias("less"), F.col("near").alias("near"))).alias("m")
    best = near_pairs(words, hot).groupBy("word").agg(F.count("*").alias("n_near"), first).select("word", "n_near", F.col("m.near").alias("near"), (-F.col("m.less")).alias("near_n"))
    chosen = F.col("near_n") >= times * F.col("n")
    with_forms = stored(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("near")).alias("form"), F.when(chosen, F.col("near_n")).alias("form_n")), "variant-forms")
    roots = last_forms(with_forms.filter("form IS NOT NULL").select("word", "form"))
    return with_forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
