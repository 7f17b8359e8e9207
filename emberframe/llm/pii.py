"""Personal data by fixed patterns and by a character-level bidirectional LSTM with CRF transitions.

The patterns give the base spans. The network, trained in numpy from labelled spans, adds spans that the patterns turn
down or miss: card-like numbers with a wrong check digit, phone numbers without a plus, unusual separators. It reads
windows of WINDOW characters that start every STRIDE characters; each character takes the tag of the window whose middle
is nearest, so spans that windows cut are put together over the whole text. A span needs a digit or an @, therefore
windows without either can't hold one and are skipped; no other text is.

The network learns from the format-level spans of about SAMPLE texts that hold a digit or @, chosen by hash (never over
twice as many), of each at most WINDOWS_PER_TEXT windows, chosen by hash over the whole text, and from made-up ones, which
alone remain when the table is empty. Nulls count as empty texts and have no spans. Repeated
rows are scanned each. Only id and text are read by `find`; `redacted` keeps all rows and all other columns.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberframe.llm.common import pick, sampled

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, SAMPLE, WINDOWS_PER_TEXT, HIDDEN, WIDTH, EPOCHS, BATCH = 96, 48, 400, 40, 16, 8, 6, 64
MAY_HOLD = re.compile("[0-9@]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Runs of digits with single dots between them; four of them in a row are one match of the pattern for addresses.
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))


def luhn(digits: str) -> bool:
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def digits_of(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern local@domain finds them from left to right, in time linear in the text."""
    at = 0
    for m in DOMAIN.finditer(text):
        a = m.start()
        while a > at and text[a - 1] in LOCAL:
            a -= 1
        if a < m.start():
            yield a, m.end()
            at = m.end()


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern digits.digits.digits.digits finds them from left to right, parts at most 255, in time linear in the text."""
    for m in DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p) < 4 and int(p) <= 255 or len(q := p.lstrip("0")) < 4 and int(q or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def base_spans(text: str, check_digit: bool = True) -> list[tuple[str, int, int]]:
    if not MAY_HOLD.search(text):
        return []
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", a, b) for a, b in addresses(text)]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(d := digits_of(m[0])) <= 19 and (not check_digit or luhn(d))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]


# Characters by class: digits, lower and upper case and other letters are one class each, other ASCII signs their own.
CLASSES = np.full(129, 3, np.int64)
for _c in range(128):
    CLASSES[_c] = 0 if chr(_c).isdigit() else 1 if chr(_c).islower() else 2 if chr(_c).isupper() else 4 + _c % 32 + 32 * (_c // 64) if _c >= 32 else 4
CLASSES = np.unique(CLASSES, return_inverse=True)[1]
PAD = int(CLASSES.max()) + 1
TAGS = 1 + 2 * len(KINDS)


def classes(text: str) -> np.ndarray:
    return CLASSES[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 128)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


class Tagger:
    """Bidirectional LSTM over character classes with a linear-chain CRF on top. Arrays are time first."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        h, w = HIDDEN, WIDTH
        self.p = {"embed": r.normal(0, 0.5, (PAD + 1, w)), "out": r.normal(0, 0.2, (2 * h, TAGS)), "bias": np.zeros(TAGS), "trans": r.normal(0, 0.1, (TAGS, TAGS)), "start": np.zeros(TAGS)}
        for d in "fb":
            self.p |= {f"w{d}": r.normal(0, 0.25, (w + h, 4 * h)), f"c{d}": np.concatenate([np.ones(h), np.zeros(3 * h)])}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def lstm(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states over x (time, batch, width); `keep` collects what the way back needs."""
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        c, out = h, np.empty((*x.shape[:2], HIDDEN), np.float32)
        w, bias = self.p[f"w{d}"], self.p[f"c{d}"]
        for t in range(len(x)):
            xh = np.hstack([x[t], h])
            z = xh @ w + bias
            s = sigmoid(z[:, : 3 * HIDDEN])
            f, i, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            before, c = c, f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep is not None:
                keep.append((xh, f, i, o, g, before, tc))
        return out

    def lstm_back(self, grad: np.ndarray, d: str, kept: list, into: dict) -> np.ndarray:
        w = self.p[f"w{d}"]
        dw, db = np.zeros_like(w), np.zeros_like(self.p[f"c{d}"])
        dh, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
        dx = np.empty((*grad.shape[:2], WIDTH), np.float32)
        for t in range(len(grad) - 1, -1, -1):
            xh, f, i, o, g, before, tc = kept[t]
            dh = dh + grad[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.hstack([dc * before * f * (1 - f), dc * g * i * (1 - i), dh * tc * o * (1 - o), dc * i * (1 - g * g)])
            dw += xh.T @ dz
            db += dz.sum(0)
            dxh = dz @ w.T
            dx[t], dh, dc = dxh[:, :WIDTH], dxh[:, WIDTH:], dc * f
        into[f"w{d}"], into[f"c{d}"] = dw, db
        return dx

    def emissions(self, x: np.ndarray) -> np.ndarray:
        e = self.p["embed"][x]
        both = np.concatenate([self.lstm(e, "f"), self.lstm(e[::-1], "b")[::-1]], 2)
        return both @ self.p["out"] + self.p["bias"]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of tags y (time, batch) and its gradients."""
        p, (n_time, n) = self.p, x.shape
        e, kf, kb = p["embed"][x], [], []
        both = np.concatenate([self.lstm(e, "f", kf), self.lstm(e[::-1], "b", kb)[::-1]], 2)
        em = both @ p["out"] + p["bias"]
        alpha, beta = np.empty_like(em), np.zeros_like(em)
        alpha[0] = p["start"] + em[0]
        for t in range(1, n_time):
            alpha[t] = logsumexp(alpha[t - 1][:, :, None] + p["trans"], 1) + em[t]
        for t in range(n_time - 2, -1, -1):
            beta[t] = logsumexp(p["trans"] + (em[t + 1] + beta[t + 1])[:, None, :], 2)
        z = logsumexp(alpha[-1], 1)
        every = np.arange(n)
        gold = p["start"][y[0]] + em[0, every, y[0]] + sum(p["trans"][y[t - 1], y[t]] + em[t, every, y[t]] for t in range(1, n_time))
        d_em = np.exp(alpha + beta - z[None, :, None])
        g = {"start": d_em[0].sum(0)}
        np.add.at(g["start"], y[0], -1)
        pair = alpha[:-1][:, :, :, None] + p["trans"] + (em[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None]
        g["trans"] = np.exp(pair).sum((0, 1))
        np.add.at(g["trans"], (y[:-1].ravel(), y[1:].ravel()), -1)
        d_em[np.arange(n_time)[:, None], every[None, :], y] -= 1
        d_em = (d_em / n).astype(np.float32)
        g = {k: v / n for k, v in g.items()}
        g["out"], g["bias"] = np.tensordot(both, d_em, ((0, 1), (0, 1))), d_em.sum((0, 1))
        d_both = d_em @ p["out"].T
        dx = self.lstm_back(d_both[:, :, :HIDDEN], "f", kf, g) + self.lstm_back(d_both[::-1, :, HIDDEN:], "b", kb, g)[::-1]
        g["embed"] = np.zeros_like(p["embed"])
        np.add.at(g["embed"], x.ravel(), dx.reshape(-1, WIDTH))
        return float((z - gold).mean()), g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 7) -> float:
        """Adam over windows x and tags y (rows are windows)."""
        r, step, loss = np.random.default_rng(seed), 0, 0.0
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            order, total = r.permutation(len(x)), 0.0
            for i in range(0, len(x), BATCH):
                at = order[i : i + BATCH]
                loss, g = self.gradients(x[at].T, y[at].T)
                total += loss * len(at)
                step += 1
                size = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
                for k in self.p:
                    a = g[k] * min(1.0, 5.0 / (size + 1e-9))
                    m[k], v[k] = 0.9 * m[k] + 0.1 * a, 0.99 * v[k] + 0.01 * a * a
                    self.p[k] = (self.p[k] - rate * 0.8**epoch * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            loss = total / max(1, len(x))
        return loss

    def tag(self, x: np.ndarray) -> np.ndarray:
        """Best tag sequence of each window (rows)."""
        em, p = self.emissions(x.T), self.p
        best, back = p["start"] + em[0], []
        for t in range(1, len(em)):
            s = best[:, :, None] + p["trans"]
            back.append(s.argmax(1))
            best = s.max(1) + em[t]
        out = [best.argmax(1)]
        for b in reversed(back):
            out.append(b[np.arange(len(b)), out[-1]])
        return np.stack(out[::-1], 1)


def tags_of(n: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for kind, a, b in sorted(spans, key=lambda s: -KINDS.index(s[0])):
        k = KINDS.index(kind)
        out[a:b] = 2 + 2 * k
        out[a] = 1 + 2 * k
    return out


def window_starts(text: str) -> np.ndarray:
    """Starts of the windows that hold a digit or an @."""
    at = np.fromiter((m.start() for m in MAY_HOLD.finditer(text)), np.int64)
    last = at // STRIDE
    every = np.concatenate([last - i for i in range(WINDOW // STRIDE)]) if len(at) else at
    return np.unique(every[every >= 0]) * STRIDE


def cut(x: np.ndarray, starts: np.ndarray, fill: int) -> np.ndarray:
    padded = np.concatenate([x, np.full(WINDOW, fill, x.dtype)])
    return padded[starts[:, None] + np.arange(WINDOW)]


def made_up(n: int = 500, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Labelled texts from forms of each kind, in filler words; some hold look-alikes that are none."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda k=7: "".join(r.choice("etaoinshrdlué") for _ in range(r.randint(2, k)))
    forms = {
        "email": lambda: f"{word()}{r.choice(['', '.', '_', '-', '.' + num(2)])}{word()}@{word()}{r.choice(['', num(1), '-' + word()])}.{word(4)}{r.choice(['', '.com', '.org'])}".replace("é", "e"),
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": lambda: r.choice([num(16), num(15), " ".join(num(4) for _ in range(4)), "-".join(num(4) for _ in range(4)), ".".join(num(4) for _ in range(4))]),
        "phone": lambda: r.choice([f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(3)} {num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}"]),
    }
    none = [lambda: f'token = "{"".join(r.choice("0123456789abcdef") for _ in range(40))}"', lambda: f"version {num(1)}.{num(1)}", lambda: num(r.randint(1, 8)), lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: f"{num(1)}.{num(2)}.{num(1)}", lambda: "@" + word(), lambda: f"{num(2)}%"]
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(2, 5)):
            text += " ".join(word() for _ in range(r.randint(1, 8))) + r.choice([" ", " ", "\n", "|", "*** ", ", "])
            if r.random() < 0.65:
                kind = r.choice(KINDS)
                s = forms[kind]()
                if kind == "email":
                    text += " " if text[-1] in LOCAL else ""
                spans.append((kind, len(text), len(text) + len(s)))
                text += s + r.choice([" ", " ", ", ", "\n", "!! ", "### "])
            else:
                text += r.choice(none)() + " "
        out.append((text, spans))
    return out


def mixed(places: np.ndarray) -> np.ndarray:
    x = (places.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def training_windows(text: str, spans: list[tuple[str, int, int]], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes and tags of windows of a text that hold a digit or an @: all, or of more than `most` those whose places
    come first by hash, from anywhere in the text."""
    starts = window_starts(text)
    if len(starts) > most:
        starts = np.sort(starts[np.argsort(mixed(starts), kind="stable")[:most]])
    return cut(classes(text), starts, PAD), cut(tags_of(len(text), spans), starts, 0)


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, windows: int = WINDOWS_PER_TEXT) -> Tagger:
    """The network, from about `sample` texts of the table (at most twice as many) and at most `windows` windows of each,
    which bounds what reaches the driver."""
    rows = sampled(pick(docs, doc_id=doc_id, text=text).filter(F.col("text").rlike("[0-9@]")), sample, "doc_id", "text")

    @F.pandas_udf("binary")
    def windows_of(texts: pd.Series) -> pd.Series:
        return pd.Series([np.hstack(training_windows(t, base_spans(t, check_digit=False), windows)).astype(np.uint8).tobytes() for t in texts])

    own = [np.frombuffer(x, np.uint8).reshape(-1, 2 * WINDOW).astype(np.int64) for x in sorted(r["w"] for r in rows.select(windows_of("text").alias("w")).collect())]
    xs, ys = [x[:, :WINDOW] for x in own], [x[:, WINDOW:] for x in own]
    for made, spans in made_up():
        x, y = training_windows(made, spans, windows)
        xs.append(x)
        ys.append(y)
    tagger = Tagger()
    tagger.train(np.concatenate(xs), np.concatenate(ys))
    return tagger


def plausible(kind: str, s: str) -> bool:
    n = len(digits_of(s))
    if kind == "email":
        return bool(re.search(r"[^\W_]\W?@\W?[^\W_]", s)) and "." in s
    return {"ip": 4 <= n <= 12 and s.count(".") == 3, "card": 13 <= n <= 19, "phone": 7 <= n <= 15}[kind]


def added_spans(text: str, tags: np.ndarray, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of a whole text's tags that are plausible and touch no base span."""
    kind = np.where(tags > 0, (tags + 1) // 2, 0)
    places = sorted((x, y) for _, x, y in base)
    starts, ends = [x for x, _ in places], list(accumulate((y for _, y in places), max))
    begin = np.flatnonzero((kind > 0) & ((np.concatenate([[0], kind[:-1]]) != kind) | (tags % 2 == 1)))
    out = []
    for a in begin.tolist():
        b = a + 1
        while b < len(kind) and kind[b] == kind[a] and tags[b] % 2 == 0:
            b += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        name = KINDS[kind[a] - 1]
        i = bisect_left(starts, b)  # base spans before i start before b; `ends` holds the furthest end so far
        if plausible(name, text[a:b]) and not (i and ends[i - 1] > a):
            out.append((name, a, b))
    return out


def spans_of(texts: list, tagger: Tagger) -> list[list[dict]]:
    """All spans of each text, base ones first found by the patterns."""
    out: list[list[dict]] = []
    work: list[tuple[int, str, np.ndarray]] = []
    for i, t in enumerate(texts):
        text = t if isinstance(t, str) else ""
        out.append([{"kind": k, "start": a, "end": b, "base": True} for k, a, b in base_spans(text)])
        if len(starts := window_starts(text)):
            work.append((i, text, starts))
    while work:
        group, size = [], 0
        while work and size < 4096:
            group.append(work.pop())
            size += len(group[-1][2])
        tags = [tagger.tag(x[j : j + 1024]) for x in [np.concatenate([cut(classes(t), s, PAD) for _, t, s in group])] for j in range(0, len(x), 1024)]
        tags = np.concatenate(tags)
        at = 0
        for i, text, starts in group:
            whole, near = np.zeros(len(text) + WINDOW, np.int64), np.full(len(text) + WINDOW, WINDOW, np.int64)
            far = np.abs(2 * np.arange(WINDOW) - WINDOW + 1)
            for s, y in zip(starts.tolist(), tags[at : at + len(starts)]):
                better = far < near[s : s + WINDOW]
                whole[s : s + WINDOW][better] = y[better]
                near[s : s + WINDOW][better] = far[better]
            at += len(starts)
            base = [(d["kind"], d["start"], d["end"]) for d in out[i]]
            out[i] += [{"kind": k, "start": a, "end": b, "base": False} for k, a, b in added_spans(text, whole[: len(text)], base)]
    for spans in out:
        spans.sort(key=lambda d: (KINDS.index(d["kind"]), d["start"]))
    return out


def find(docs: DataFrame, tagger: Tagger, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans): all spans of each text, by kind and start; `base` marks those of the patterns."""
    held = docs.sparkSession.sparkContext.broadcast(tagger)

    @F.pandas_udf(SPANS)
    def scan(texts: pd.Series) -> pd.Series:
        return pd.Series(spans_of(list(texts), held.value), dtype=object)

    return pick(docs, doc_id=doc_id, text=text).select("doc_id", scan("text").alias("spans"))


def redacted(docs: DataFrame, tagger: Tagger, text: str = "text") -> DataFrame:
    """docs with every span of `text` replaced by its kind in angle brackets."""
    held = docs.sparkSession.sparkContext.broadcast(tagger)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([replace(t, s) for t, s in zip(texts, spans_of(list(texts), held.value))], dtype=object)

    return docs.withColumn(text, clean(F.col(f"`{text}`")))


def replace(text: str | None, spans: list[dict]) -> str | None:
    if not isinstance(text, str) or not spans:
        return text
    out, at, last = [], 0, -1
    for d in sorted(spans, key=lambda d: (d["start"], -d["end"])):
        if d["start"] >= last:
            out += [text[at : d["start"]], f"<{d['kind']}>"]
        last = at = max(last, d["end"])
    return "".join([*out, text[at:]])


def digest(found: DataFrame) -> DataFrame:
    def joined(base: bool) -> Column:
        own = F.filter("spans", lambda s: s["base"]) if base else F.col("spans")
        return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(True).cast("binary"), 256).alias("base_sha256"), joined(False).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
