"""Removal of long repeated substrings by a sparse suffix order and a common-prefix-aware distributed merge sort.

Strings of `length` bytes that stand twice are removed. Strings of `passage` bytes that stand twice are told as well, but
stay: repeated passages may be shorter than what is removed.

A string of `passage` bytes that stands twice has the same anchor at the same offset in both places: the least hash of
the 16-byte strings that start in its first half; and each string of `length` bytes begins with one of `passage` bytes.
So only suffixes at anchors are sorted, not all.

1. Documents are written as blocks of bytes. Each block sends the hashes of the core (the bytes after an anchor that all
   its strings hold) to the bucket of the hash, and learns which occur elsewhere; no other anchor's strings can repeat.
2. For the rest, a block sorts the suffixes (bytes from the anchor on, then the bytes before it backward) and writes them
   front-coded: common prefix with the one before, and what is left. Equal ones are one entry that counts twice.
3. Runs are cut at splitters, exchanged, and merged by loser trees that keep the common prefix of every loser with the
   last winner, so no byte known to be equal is compared again. The merged common prefixes give groups of equal cores.
4. Within a group, strings at equal offsets from the anchor are put together by hashes and then compared byte by byte;
   should two hashes meet, they are told apart by their bytes. Groups that a splitter cuts, and groups over GROUP entries,
   send cryptographic digests (128 bits) of their different strings through one more shuffle.
5. Blocks mark the bytes of all repeated strings and cut them out.

Nulls count as empty texts. Repeated rows are documents of their own (so a long one loses all its bytes, as both copies
occur elsewhere); ids may be any long. Documents shorter than `length` bytes stay whole. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import block_number, blocks, even_keys, id_and_text, id_list, looked_up, pack, pack_lists, partitions, ragged, sampled, stored, unpack, unpack_lists

LENGTH, PASSAGE, GRAM, BLOCK = 400, 256, 16, 4 << 20
GROUP, SPLIT_BLOCKS, SPLIT_KEYS = 1500, 2048, 32
C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
P1, P2, B1, B2 = (1 << 31) - 1, (1 << 31) - 19, 911382323, 972663749

BLOCKS = "block long, ids array<string>, lengths array<int>, data binary"
HASHES = "block long, bucket int, hashes binary"
RUN = "block long, run binary, sample array<binary>, whole binary"
PIECE = "part int, key int, block long, run binary"
FOUND = "block long, level int, start long, stop long, weight int, key binary"
#: Fields of an entry in a run: bytes from the anchor on, number of its strings, how often it counts, its first place.
FIELDS = ("right", "count", "weight", "first")


def to_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for n, pdf in enumerate(blocks(batches, limit=BLOCK)):
        texts = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in pdf["text"]]
        data = zstandard.ZstdCompressor(level=6).compress(b"".join(texts))
        yield pd.DataFrame({"block": [block_number(n)], "ids": [id_list(pdf["doc_id"])], "lengths": [[len(t) for t in texts]], "data": [data]})


def unzip(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def eights(data: bytes) -> np.ndarray:
    """The 8 bytes from each place on as one number; bytes after the end count as zero."""
    n = -(-len(data) // 8)
    padded, out = data + bytes(16), np.empty((n, 8), np.uint64)
    for o in range(8):
        out[:, o] = np.frombuffer(padded, "<u8", n, o)
    return out.ravel()[: len(data)]


def mixed(x: np.ndarray, c: np.uint64) -> np.ndarray:
    x = x * c
    return (x ^ (x >> np.uint64(29))) * C3


def least_places(data: bytes, window: int) -> np.ndarray:
    """Place of the least hash of GRAM bytes within the first `window` places from each place on; ties: the leftmost."""
    u = eights(data)
    h = mixed(u[:-8], C1) ^ mixed(u[8:], C2)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while 2 * span <= window:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < window:
        low = np.minimum(low[: len(low) - (window - span)], low[window - span :])
    return low.astype(np.uint32)


def anchors(data: bytes, lengths: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first, last): each anchor, and the first and last start of the strings of `length` that it anchors."""
    place, whole, chunk = np.zeros(len(data), np.uint32), np.zeros(len(data) + 1, np.int8), 1 << 20
    for a in range(0, max(0, len(data) - length + 1), chunk):
        part = least_places(data[a : a + chunk + length], window)[: min(chunk, len(data) - length + 1 - a)]
        place[a : a + len(part)] = part + np.uint32(a)
    offsets, room = np.cumsum(lengths) - lengths, np.maximum(lengths - length + 1, 0)
    np.add.at(whole, offsets[room > 0], 1)  # starts of strings that lie within a document
    np.add.at(whole, (offsets + room)[room > 0], -1)
    starts = np.flatnonzero(np.cumsum(whole[:-1], dtype=np.int8))
    own = place[starts].astype(np.int64)
    if not len(starts):
        return own, starts, starts
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    return own[new], starts[new], np.concatenate([starts[new[1:] - 1], starts[-1:]])


def core_hashes(data: bytes, place: np.ndarray, core: int) -> np.ndarray:
    """Hashes of the bytes after each anchor that every string with this anchor holds."""
    raw, out = np.frombuffer(data, np.uint8), np.zeros(len(place), np.uint64)
    for j in range(0, core - 7, 8):
        eight = np.ascontiguousarray(raw[place[:, None] + np.arange(j, j + 8)]).view("<u8").ravel() if len(place) else out
        out = mixed(out ^ eight, C1) + C2
    return out


def front_coded(keys: list[bytes], meta: dict[str, np.ndarray]) -> bytes:
    """A sorted run: each key without its common prefix with the one before."""
    shared, rests, before = np.zeros(len(keys), np.uint32), [], b""
    for i, k in enumerate(keys):
        shared[i] = n = common(before, k, 0)
        rests.append(k[n:])
        before = k
    out = pack_lists(np.fromiter(map(len, rests), np.uint32, len(rests)), zstandard.ZstdCompressor(level=3).compress(b"".join(rests)))
    for a in (shared, meta["right"], meta["count"], meta["weight"], np.diff(meta["first"], prepend=0).view(np.uint64) & 0xFFFFFFFF):
        out = pack_lists(a, out)
    return out


def decoded(run: bytes) -> tuple[list[bytes], list[int], dict[str, np.ndarray]]:
    """Keys of a run, each one's common prefix with the one before, and the other fields."""
    first, run = unpack_lists(run)
    weight, run = unpack_lists(run)
    count, run = unpack_lists(run)
    right, run = unpack_lists(run)
    shared, run = unpack_lists(run)
    lengths, body = unpack_lists(run)
    raw, keys, at, before = unzip(body), [], 0, b""
    shared = shared.tolist()
    for n, m in zip(shared, lengths.tolist()):
        before = before[:n] + raw[at : at + m]
        at += m
        keys.append(before)
    return keys, shared, {"right": right, "count": count, "weight": weight, "first": np.cumsum(first.view(np.int32).astype(np.int64))}


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of a and b, of which `known` bytes are known to be equal."""
    n, step = min(len(a), len(b)), 16
    while known < n:
        x, y = a[known : known + step], b[known : known + step]
        if x != y:
            m = min(len(x), len(y))
            x, y = x[:m], y[:m]
            if x == y:
                return known + m
            d = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
            return known + m - (d.bit_length() + 7) // 8
        known += len(x)
        step = 64
    return n


class LoserTree:
    """Merges sorted runs. Every loser keeps its common prefix with the key that beat it, which is also the one with the
    last winner on its way; keys are compared only where those are equal, and only from there on."""

    def __init__(self, runs: list[tuple[list[bytes], list[int]]]):
        self.keys, self.shared = [r[0] for r in runs], [r[1] for r in runs]
        k = 1
        while k < len(runs):
            k *= 2
        self.size = k
        self.at = [0] * k
        self.keys += [[]] * (k - len(runs))
        self.shared += [[]] * (k - len(runs))
        self.loser, self.prefix = [-1] * k, [0] * k
        winner = [-1] * (2 * k)
        for i in range(k):
            winner[k + i] = i
        for node in range(k - 1, 0, -1):
            a, b, n = self.order(winner[2 * node], winner[2 * node + 1], 0)
            winner[node], self.loser[node], self.prefix[node] = a, b, n
        self.top, self.top_prefix = winner[1] if k > 1 else 0, 0

    def order(self, a: int, b: int, known: int) -> tuple[int, int, int]:
        """(winner, loser, common prefix of loser and winner) of two runs' next keys that both share `known` bytes with the last winner."""
        ka, kb = self.keys[a], self.keys[b]
        if self.at[a] >= len(ka):
            return b, a, -1
        if self.at[b] >= len(kb):
            return a, b, -1
        x, y = ka[self.at[a]], kb[self.at[b]]
        n = common(x, y, known)
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            return a, b, n
        return b, a, n

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        """(run, place in it, common prefix with the key before)."""
        loser, prefix, keys, at, shared, size = self.loser, self.prefix, self.keys, self.at, self.shared, self.size
        top, known = self.top, self.top_prefix
        while at[top] < len(keys[top]):
            yield top, at[top], known
            at[top] += 1
            run = top
            known = shared[run][at[run]] if at[run] < len(keys[run]) else -1
            node = (run + size) // 2
            while node:
                other, p = loser[node], prefix[node]
                if p > known:  # the loser shares more with the last winner: it is smaller
                    loser[node], prefix[node] = run, known
                    run, known = other, p
                elif p == known and p >= 0:
                    won, lost, n = self.order(run, other, p)
                    loser[node], prefix[node] = lost, n
                    run = won  # the winner's own prefix with the last winner stays `known`
                node //= 2
            top = run


class Hasher:
    """Hashes of many strings of a byte string: running sums first, from which strings of any length follow."""

    def __init__(self, size: int = 1 << 21):
        self.tables = []
        for p, b in ((P1, B1), (P2, B2)):
            power, inverse, inv = np.empty(size, np.uint64), np.empty(size, np.uint64), pow(b, -1, p)
            power[0] = inverse[0] = 1
            n = 1
            while n < size:
                m = min(n, size - n)
                power[n : n + m] = power[:m] * np.uint64(pow(b, n, p)) % np.uint64(p)
                inverse[n : n + m] = inverse[:m] * np.uint64(pow(inv, n, p)) % np.uint64(p)
                n += m
            self.tables.append((np.uint64(p), power.astype(np.uint32), inverse.astype(np.uint32)))
        self.room = size

    def sums(self, data: np.ndarray) -> list[np.ndarray]:
        return [np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)] % p)]) for p, power, _ in self.tables]

    def strings(self, sums: list[np.ndarray], starts: np.ndarray, length: int) -> np.ndarray:
        h1, h2 = ((x[starts + length] - x[starts]) % p * inverse[starts] % p for x, (p, _, inverse) in zip(sums, self.tables))
        return (h1 << np.uint64(31)) ^ h2


def equal_strings(data: bytes, starts: np.ndarray, entry: np.ndarray, length: int, where: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of each class, class of each string): strings with equal `where` and equal bytes. Hashes propose the classes;
    bytes decide, a whole run of neighbours at once."""
    _, lead, own = np.unique(hashes * C1 ^ mixed(where.astype(np.uint64), C2), return_index=True, return_inverse=True)
    first = lead[own]
    at = np.flatnonzero(first != np.arange(len(starts)))
    if len(at):
        a, b = starts[at], starts[first[at]]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(a) != 1) | (np.diff(b) != 1) | (np.diff(entry[at]) != 0) | (np.diff(entry[first[at]]) != 0)]))
        stop = np.concatenate([new[1:], [len(at)]]) - 1
        size = a[stop] - a[new] + length
        fine = np.array_equal(where[at], where[first[at]]) and all(data[i : i + n] == data[j : j + n] for i, j, n in zip(a[new].tolist(), b[new].tolist(), size.tolist()))
        if not fine:
            seen: dict[tuple[int, bytes], int] = {}
            own = np.array([seen.setdefault((w, data[i : i + length]), len(seen)) for w, i in zip(where.tolist(), starts.tolist())], np.int64)
            _, lead = np.unique(own, return_index=True)
    return lead, own


def hash_rows(length: int, window: int, keys: list[int]):
    """Core hashes of each block by bucket. Those that a block has twice go under its negative: they count twice there,
    and the block needs no answer."""
    core, buckets, names = length - window, len(keys), np.array(keys, np.int32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, lengths, zipped in pdf[["block", "lengths", "data"]].itertuples(index=False):
                data = unzip(zipped)
                place, _, _ = anchors(data, np.asarray(lengths, np.int64), length, window)
                hashes, n = np.unique(core_hashes(data, place, core), return_counts=True)
                for sender, h in ((block, hashes[n == 1]), (-1 - block, hashes[n > 1])):
                    bucket = (h >> np.uint64(32)) % np.uint64(buckets)
                    order = np.argsort(bucket, kind="stable")
                    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
                    used = np.flatnonzero(np.diff(edges))
                    yield pd.DataFrame({"block": sender, "bucket": names[used], "hashes": [h[order[edges[b] : edges[b + 1]]].tobytes() for b in used]})

    return run


def met_elsewhere(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each block's hashes in a bucket, those that another block, or the same block twice, has as well."""
    held = [(b, k, np.frombuffer(h, np.uint64)) for pdf in batches for b, k, h in pdf[["block", "bucket", "hashes"]].itertuples(index=False)]
    if held:
        h, n = np.unique(np.concatenate([h for b, _, h in held for _ in range(1 + (b < 0))]), return_counts=True)
        many = h[n > 1]
        out = [(b, k, h[np.isin(h, many, assume_unique=True)].tobytes()) for b, k, h in held if b >= 0]
        yield pd.DataFrame(out, columns=["block", "bucket", "hashes"])


def sorted_run(length: int, passage: int):
    window = passage // 2
    core = passage - window

    def run(rows: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        out = []
        for block, lengths, zipped in rows[["block", "lengths", "data"]].itertuples(index=False):
            data, lengths = unzip(zipped), np.asarray(lengths, np.int64)
            place, first, last = anchors(data, lengths, passage, window)
            ends = np.cumsum(lengths)
            stop = np.minimum(last + length, ends[np.searchsorted(ends, first, side="right")]) if len(first) else last
            h = core_hashes(data, place, core)
            values, n = np.unique(h, return_counts=True)
            many = np.concatenate([values[n > 1], *(np.frombuffer(x, np.uint64) for x in others["hashes"])])
            at = np.flatnonzero(np.isin(h, many))
            entries: dict[bytes, list[int]] = {}
            for i, a, f, z, e in zip(at.tolist(), place[at].tolist(), first[at].tolist(), last[at].tolist(), stop[at].tolist()):
                # The key orders by what follows the anchor; its length and the number of strings keep unlike cuts apart.
                entries.setdefault(data[a:e] + data[f:a][::-1] + (e - a).to_bytes(2, "little") + (z - f).to_bytes(2, "little"), []).append(i)
            keys = sorted(entries)
            lead = np.array([entries[k][0] for k in keys], np.int64)
            meta = {"right": (stop - place)[lead], "count": (last - first + 1)[lead], "weight": np.array([min(2, len(entries[k])) for k in keys], np.int64), "first": first[lead]}
            twice = np.array(sorted(i for x in entries.values() if len(x) > 1 for i in x), np.int64)
            whole = pack_lists(last[twice] - first[twice], pack_lists(stop[twice] - first[twice], pack(first[twice])))
            step = max(1, len(keys) // SPLIT_KEYS)
            out.append((block, front_coded(keys, meta), keys[step // 2 :: step], whole))
        return pd.DataFrame(out, columns=["block", "run", "sample", "whole"])

    return run


def cut_points(keys: list[bytes], core: int) -> list[bytes]:
    """Splitters of sorted keys. A lone one is cut to its core, which no group of equal cores straddles; of several with
    one core, those after the first cut the group that is so large."""
    return sorted({k if i and keys[i - 1][:core] == k[:core] else k[:core] for i, k in enumerate(keys)})


def cut_run(splitters: list[bytes], names: list[int]):
    import bisect

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, data in pdf[["block", "run"]].itertuples(index=False):
                keys, _, meta = decoded(data)
                edges = [0, *(bisect.bisect_left(keys, s) for s in splitters), len(keys)]
                for part, (a, b) in enumerate(zip(edges, edges[1:])):
                    if b > a:
                        yield pd.DataFrame({"part": [part], "key": [names[part]], "block": [block], "run": [front_coded(keys[a:b], {k: v[a:b] for k, v in meta.items()})]})

    return run


def merged(length: int, passage: int, splitters: list[bytes]):
    core = passage - passage // 2

    def spans(level: int, size: int, block: np.ndarray, first: np.ndarray, entry: np.ndarray, number: np.ndarray) -> pd.DataFrame:
        """Runs of repeated strings of an entry as byte spans of its block."""
        new = np.flatnonzero(np.concatenate([[True], (entry[1:] != entry[:-1]) | (number[1:] != number[:-1] + 1)]))
        stop = np.concatenate([new[1:], [len(entry)]]) - 1
        e = entry[new]
        return pd.DataFrame({"block": block[e], "level": level, "start": first[e] + number[new], "stop": first[e] + number[stop] + size, "weight": 0, "key": None})

    def resolved(hasher: Hasher, keys: list[bytes], group: np.ndarray, block: np.ndarray, field: dict[str, np.ndarray], shut: bool) -> Iterator[pd.DataFrame]:
        """Repeated strings of some entries, of both lengths; unless all of their groups are here, what others must know."""
        texts = [k[r:-4][::-1] + k[:r] for k, r in zip(keys, field["right"].tolist())]
        data, sizes = b"".join(texts), np.fromiter(map(len, texts), np.int64, len(texts))
        base, sums = np.cumsum(sizes) - sizes, hasher.sums(np.frombuffer(data, np.uint8))
        for level, size in enumerate((length, passage) if passage < length else (length,)):
            count = np.clip(sizes - size + 1, 0, field["count"])
            entry, number = np.repeat(np.arange(len(texts)), count), ragged(np.zeros(len(texts), np.int64), count)
            if not len(entry):
                continue
            starts = base[entry] + number
            where = group[entry] * 1024 + (sizes - field["right"])[entry] - number
            lead, own = equal_strings(data, starts, entry, size, where, hasher.strings(sums, starts, size))
            twice = np.bincount(own, field["weight"][entry])[own] > 1
            if twice.any():
                yield spans(level, size, block, field["first"], entry[twice], number[twice])
            if not shut:  # strings met once ask the other parts; of those met twice, one tells them
                start, known = field["first"][entry[lead]] + number[lead], twice[lead]
                key = [blake2b(data[i : i + size], digest_size=16).digest() for i in starts[lead].tolist()]
                yield pd.DataFrame({"block": np.where(known, -1, block[entry[lead]]), "level": level, "start": start, "stop": start + size, "weight": 1 + known, "key": key})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        pieces: dict[int, list] = {}
        for pdf in batches:
            for part, block, data in pdf.itertuples(index=False):
                pieces.setdefault(part, []).append((block, data))
        for part in sorted(pieces):
            runs = [(b, *decoded(d)) for b, d in pieces.pop(part)]
            edge = [s for s in (splitters[part - 1] if part else None, splitters[part] if part < len(splitters) else None) if s is not None]
            keys, owner, place, lcps = [], [], [], []
            for r, i, n in LoserTree([(k, s) for _, k, s, _ in runs]):
                keys.append(runs[r][1][i])
                owner.append(r)
                place.append(i)
                lcps.append(n)
            owner, place, lcps = (np.array(x, np.int64) for x in (owner, place, lcps))
            if not len(owner):
                continue
            base = np.cumsum([0] + [len(x[1]) for x in runs])[:-1]
            field = {f: np.concatenate([x[3][f] for x in runs]).astype(np.int64)[base[owner] + place] for f in FIELDS}
            block = np.array([x[0] for x in runs], np.int64)[owner]
            del runs
            begin = np.flatnonzero(np.concatenate([[True], lcps[1:] < core]))
            size = np.diff(np.append(begin, len(keys)))
            group = np.repeat(np.arange(len(begin)), size)
            weight = np.add.reduceat(field["weight"], begin)
            open_ = np.array([any(len(s) > core and keys[b][:core] == s[:core] for s in edge) for b in begin]) | (size > GROUP)
            for own, shut in batched(begin, size, (weight > 1) & ~open_, open_, hasher.room // (length + passage) - 1):
                yield from resolved(hasher, [keys[j] for j in own], group[own], block[own], {f: x[own] for f, x in field.items()}, shut)

    return run


def batched(begin: np.ndarray, size: np.ndarray, shut: np.ndarray, open_: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, bool]]:
    """Entries of whole groups that are settled here, then those of open groups, at most `limit` at once."""
    groups = np.flatnonzero(shut)
    batch = np.cumsum(size[groups]) // max(1, limit - GROUP)
    for g in np.split(groups, np.flatnonzero(np.diff(batch)) + 1):
        if len(g):
            yield ragged(begin[g], size[g]), True
    rows = ragged(begin[open_], size[open_])
    for i in range(0, len(rows), limit):
        yield rows[i : i + limit], False


def removed(length: int, passage: int):
    """Of each document: its size, removed spans, bytes in repeated passages, and what is kept."""

    def run(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, ids, lengths, zipped, whole in rows[["block", "ids", "lengths", "data", "whole"]].itertuples(index=False):
            data, lengths = unzip(zipped), np.asarray(lengths, np.int64)
            marks = np.zeros((2, len(data) + 1), np.int32)
            if whole is not None:
                extra, start = unpack_lists(whole)
                size, start = unpack_lists(start)
                start = unpack(start).astype(np.int64)
                for level, n in enumerate((size.astype(np.int64), extra.astype(np.int64) + passage)):
                    fits = np.ones(len(start), bool) if level else size >= length
                    np.add.at(marks[level], start[fits], 1)
                    np.add.at(marks[level], (start + n)[fits], -1)
            for level, start, stop in found[["level", "start", "stop"]].itertuples(index=False):
                marks[level, start] += 1
                marks[level, stop] -= 1
            (gone, told), raw, at = np.cumsum(marks[:, :-1], 1) > 0, np.frombuffer(data, np.uint8), 0
            for i, n in zip(ids, lengths.tolist()):
                cut = gone[at : at + n]
                n_removed = int(cut.sum())
                edge = np.flatnonzero(np.diff(np.concatenate([[0], cut.view(np.int8), [0]]))) if n_removed else np.zeros(0, np.int64)
                out.append((i, n, n_removed, edge.tolist(), raw[at : at + n][~cut].tobytes() if n_removed else data[at : at + n], int((told[at : at + n] | cut).sum())))
                at += n
        return pd.DataFrame({"doc_id": id_list(r[0] for r in out), "n_bytes": [r[1] for r in out], "n_removed": [r[2] for r in out], "edges": [r[3] for r in out], "kept": [r[4] for r in out], "n_repeated": [r[5] for r in out]})

    return run


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, passage: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, edges, kept, n_repeated): edges alternates starts and ends of removed spans; kept is the
    rest; n_repeated counts the bytes of strings of `passage` bytes (no longer than `length`) that stand twice."""
    spark = docs.sparkSession
    passage = min(PASSAGE, length) if passage is None else passage
    window = passage // 2
    if passage > length or passage - window < 8 or window + GRAM > passage or window > 1024:
        raise ValueError("passage must leave room for the anchor window and the core, and be no longer than length")
    n = partitions(spark)
    keys = even_keys(spark, n)
    table = stored(id_and_text(docs, doc_id, text).mapInPandas(to_blocks, BLOCKS), "suffix-blocks")
    known = table.mapInPandas(hash_rows(passage, window, keys), HASHES).repartition(n, "bucket").mapInPandas(met_elsewhere, HASHES)
    runs = stored(table.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(sorted_run(length, passage), RUN), "suffix-runs")
    sample = sampled(runs.select("block", "sample"), SPLIT_BLOCKS, "block")
    seen = sorted(bytes(k) for r in sample.collect() for k in r["sample"])
    splitters = cut_points([seen[len(seen) * i // n] for i in range(1, n)] if seen else [], passage - window)
    pieces = runs.select("block", "run").mapInPandas(cut_run(splitters, keys), PIECE).repartition(n, "key").drop("key")
    found = stored(pieces.mapInPandas(merged(length, passage, splitters), FOUND), "suffix-found")
    open_ = found.filter("weight > 0")
    counts = open_.groupBy("level", "key").agg(F.sum("weight").alias("n"), F.count("*").alias("rows")).filter("n > 1")
    twice = stored(counts.select(F.struct("level", "key").alias("string"), "rows"), "suffix-twice")
    asking = open_.filter("block >= 0").withColumn("string", F.struct("level", "key"))
    answered = looked_up(asking, twice, "string", "rows", open_.count())
    columns = ["block", "level", "start", "stop"]
    spans = found.filter("weight = 0").select(columns).unionByName(answered.select(columns))
    marked = table.join(runs.select("block", "whole"), "block", "left")
    out = marked.groupBy("block").cogroup(spans.groupBy("block")).applyInPandas(removed(length, passage), "doc_id string, n_bytes long, n_removed long, edges array<int>, kept binary, n_repeated long")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", (F.size("edges") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_repeated")
