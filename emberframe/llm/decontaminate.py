"""Benchmark decontamination with an FM-index over each shard of the training documents.

A shard is a block of documents that one task reads. Its words become numbers of the benchmark's own alphabet; runs of
known words shorter than the shortest phrase can't hold one and are left out, which changes no result. The FM-index of
the remaining runs (suffix array, Burrows-Wheeler transform, wavelet tree, sampled suffix positions) is searched
backward for all phrases at once; each occurrence marks its words, and marks merge into removal spans.

The benchmark is held in memory by blocks of PHRASE_BLOCK phrases: a larger one takes one more pass a block.

Nulls have no words: such documents are clean and such items have no phrase. An item without words never occurs.
Repeated items, ids and rows are kept: each row gets its own result and each item_id counts once a document. A null
item_id is not listed. Other columns of the input pass through untouched, of any type (ids may be any long), but for
those named as the result's own (FOUND), which it replaces.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberframe.llm.common import arrow_blocks, pick, ragged

#: Words are runs of ASCII letters and digits, lower-cased, and of everything beyond ASCII.
TABLE = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
WINDOW = 10
#: Columns that `contamination` adds, and the text on its way.
FOUND, TEXT = ("n_words", "word_spans", "item_ids"), "text"
PHRASE_BLOCK = 500_000
SAMPLE = 8


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split() if isinstance(text, str) else []


class WaveletTree:
    """Ranks of symbols in a sequence, by bit planes from the highest bit down."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.ones, self.zeros, at = [], [], symbols
        for b in range(bits - 1, -1, -1):
            bit = (at >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int64)]))
            self.zeros.append(len(at) - int(self.ones[-1][-1]))
            at = np.concatenate([at[bit == 0], at[bit == 1]])
        self.bits = bits

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often `symbol` stands before place i, for arrays of both."""
        low = np.zeros_like(i)
        for level in range(self.bits):
            ones, one = self.ones[level], ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            i = np.where(one, self.zeros[level] + ones[i], i - ones[i])
            low = np.where(one, self.zeros[level] + ones[low], low - ones[low])
        return i - low

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for level in range(self.bits):
            ones = self.ones[level]
            bit = ones[i + 1] - ones[i]
            out = (out << 1) | bit
            i = np.where(bit == 1, self.zeros[level] + ones[i], i - ones[i])
        return out


class FMIndex:
    """Index of runs of symbols 1..sigma. Each run ends in a mark of its own, so that nothing matches across runs."""

    def __init__(self, runs: np.ndarray, lengths: np.ndarray, sigma: int):
        n_runs = len(lengths)
        ends = np.cumsum(lengths + 1) - 1
        text = np.zeros(len(runs) + n_runs, np.int64)
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = runs
        # Marks sort before all symbols, in their own order: suffixes differ at the end of a run at the latest.
        rank = np.where(inside, text + n_runs, 0)
        rank[ends] = np.arange(n_runs)
        step, longest = 1, int(lengths.max(initial=0)) + 1
        order = np.argsort(rank, kind="stable")
        while step < longest:
            after = np.zeros_like(rank)
            after[:-step] = rank[step:] + 1
            key = rank * (int(after.max(initial=0)) + 1) + after
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            new = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
            rank = np.empty_like(rank)
            rank[order] = new
            if len(new) and new[-1] == len(new) - 1:
                break
            step *= 2
        self.n, before = len(text), order - 1
        self.tree = WaveletTree(text[before], max(1, int(sigma).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 2))])
        # Sampled places: every SAMPLE-th, and each run's start, where the walk back must stop.
        starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if n_runs else np.zeros(0, np.int64)
        keep = (order % SAMPLE == 0) | np.isin(order, starts) | ~inside[order]
        self.marked, self.sampled = np.concatenate([[0], np.cumsum(keep)]), order[keep]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of suffixes that start with each row of `phrases` (right-aligned, zeros in front)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[:, j].astype(np.int64)
            at = np.flatnonzero((c > 0) & (hi > lo))
            lo[at], hi[at] = (self.first[c[at]] + self.tree.rank(c[at], x[at]) for x in (lo, hi))
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of suffixes, by walking back to a sampled one."""
        rows, out, steps = rows.copy(), np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            r = rows[open_]
            kept = self.marked[r + 1] > self.marked[r]
            done = open_[kept]
            out[done] = self.sampled[self.marked[rows[done]]] + steps[done]
            open_ = open_[~kept]
            r = rows[open_]
            c = self.tree.access(r)
            rows[open_] = self.first[c] + self.tree.rank(c, r)
            steps[open_] += 1
        return out


def phrase_table(items: list[tuple[object, str | None]], window: int) -> dict[tuple[bytes, ...], list]:
    """Windows of the items' words, with the ids of the items that hold them."""
    table: dict[tuple[bytes, ...], set] = defaultdict(set)
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            table[tuple(w[i : i + window])].add(item)
    return {k: list(v) for k, v in table.items()}


def scan(table: dict[tuple[bytes, ...], list], window: int):
    """Function over Arrow batches with column TEXT: adds word counts, merged spans of hit words [start, end) and item ids."""
    alphabet = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for k in table for w in k))}
    keys, shortest = list(table), min(map(len, table), default=1)
    phrases = np.zeros((len(keys), window), np.int32)
    for i, k in enumerate(keys):
        phrases[i, window - len(k) :] = [alphabet[w] for w in k]
    sizes = np.array([len(k) for k in keys], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = alphabet.get
        for block in arrow_blocks(batches, TEXT):
            coded = [np.array([get(w, 0) for w in words_of(t)], np.int32) for t in block[TEXT].to_pylist()]
            counts = np.array([len(x) for x in coded], np.int64)
            # A zero after each document keeps runs apart.
            flat = np.concatenate([y for x in coded for y in (x, np.zeros(1, np.int32))] or [np.zeros(0, np.int32)])
            known = np.concatenate([[0], (flat > 0).astype(np.int8), [0]])
            edge = np.diff(known)
            starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            long = ends - starts >= shortest
            starts, lengths = starts[long], (ends - starts)[long]
            hit, found = np.zeros(len(flat) + 1, np.int32), defaultdict(set)
            offsets = np.cumsum(counts + 1) - (counts + 1)
            if len(starts) and len(keys):
                source = ragged(starts, lengths)
                index = FMIndex(flat[source].astype(np.int64), lengths, len(alphabet))
                lo, hi = index.search(phrases)
                at = index.locate(ragged(lo, hi - lo))
                phrase = np.repeat(np.arange(len(keys)), hi - lo)
                # Places in the index count one mark after each run.
                marks = np.cumsum(lengths + 1) - (lengths + 1)
                run_of = np.searchsorted(marks, at, side="right") - 1
                place = starts[run_of] + at - marks[run_of]
                np.add.at(hit, place, 1)
                np.add.at(hit, place + sizes[phrase], -1)
                doc = np.searchsorted(offsets, place, side="right") - 1
                pairs = np.unique(doc * len(keys) + phrase)
                for d, p in zip((pairs // len(keys)).tolist(), (pairs % len(keys)).tolist(), strict=True):
                    found[d].update(table[keys[p]])
            covered = np.concatenate([[0], (np.cumsum(hit[:-1]) > 0).astype(np.int8), [0]])
            edge = np.diff(covered)
            span_starts, span_ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            owner = np.searchsorted(offsets, span_starts, side="right") - 1
            spans: dict[int, list] = defaultdict(list)
            for d, a, b in zip(owner.tolist(), span_starts.tolist(), span_ends.tolist(), strict=True):
                spans[d].append({"start": a - int(offsets[d]), "end": b - int(offsets[d])})
            new = {
                "n_words": counts,
                "word_spans": [merge([*s, *spans[i]]) if s else spans[i] for i, s in enumerate(block["word_spans"].to_pylist())],
                "item_ids": [sorted({*o, *(str(x) for x in found[i] if x is not None)}) for i, o in enumerate(block["item_ids"].to_pylist())],
            }
            for name, values in new.items():
                at = block.schema.get_field_index(name)
                block = block.set_column(at, block.schema.field(at), pa.chunked_array([pa.array(values, block.schema.field(at).type)]))
            yield from block.combine_chunks().to_batches()

    return run


def merge(spans: list) -> list[dict]:
    """Overlapping or touching spans as one."""
    out: list[dict] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], b)
        else:
            out.append({"start": a, "end": b})
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, phrase_block: int = PHRASE_BLOCK) -> DataFrame:
    """docs with n_words, word_spans (merged hit words, [start, end) by word) and item_ids (sorted as strings), which take
    the place of columns of docs with these names."""
    items = pick(benchmark, item=item_id, text=item_text)
    own = {f"c{i}": c for i, c in enumerate(docs.columns) if c not in FOUND}  # numbered on the way: no name can clash
    fresh = {TEXT: docs[f"`{text}`"].cast("string"), "n_words": F.lit(0).cast("long"), "word_spans": F.array().cast("array<struct<start:long,end:long>>"), "item_ids": F.array().cast("array<string>")}
    out = docs.select(*(docs[f"`{c}`"].alias(k) for k, c in own.items()), *(x.alias(k) for k, x in fresh.items()))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in out.schema])

    def apply(df: DataFrame, held: list) -> DataFrame:
        return df.mapInArrow(scan(phrase_table(held, window), window), schema)

    held, size, passes = [], 0, 0
    for row in items.toLocalIterator():  # by partitions; no more than one block of phrases is held
        held.append((row["item"], row["text"]))
        size += max(1, len(words_of(row["text"])) - window + 1)
        if size >= phrase_block:
            out, held, size, passes = apply(out, held), [], 0, passes + 1
    if held or not passes:
        out = apply(out, held)
    return out.select(*(F.col(k).alias(c) for k, c in own.items()), *FOUND)


def remove_spans(text: str | None, spans: list) -> str | None:
    """The text without the hit words, each span from its first word's start to its last word's end."""
    if not isinstance(text, str) or not len(spans):
        return text
    raw = text.encode("utf-8", "surrogatepass")
    flags = np.frombuffer(raw.translate(TABLE), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for s in spans:
        out.append(raw[at : starts[s["start"]]])
        at = ends[s["end"] - 1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs with the benchmark passages cut out of `text`; all rows stay, and other columns as they are."""
    cut = F.pandas_udf(lambda t, s: pd.Series([remove_spans(a, b) for a, b in zip(t, s, strict=True)], dtype=object), "string")
    found = contamination(docs.select(*(docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns))), benchmark, text=f"c{docs.columns.index(text)}")
    i = docs.columns.index(text)
    cleaned = F.when(F.size("word_spans") > 0, cut(F.col(f"c{i}"), F.col("word_spans"))).otherwise(F.col(f"c{i}"))
    return found.select(*((cleaned if c == text else F.col(f"c{k}")).alias(c) for k, c in enumerate(docs.columns)))


def digest(found: DataFrame) -> DataFrame:
    hits = F.aggregate("word_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", hits.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (hits > 0).alias("contaminated"),
    )


def sha(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
