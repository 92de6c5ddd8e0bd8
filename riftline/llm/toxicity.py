"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word is a run of letters and digits in lower case. Its input is a word vector and the sum of the vectors of its
four-character pieces (with marks for its ends), both from tables addressed by hashes. Two gated recurrent layers read
a window of ``WINDOW`` words, forwards and backwards; attention weighs their states into one, from which the window's
logit follows. A document's logit is the largest of all its windows, which overlap by half and cover it whole, and a
logistic curve fitted to documents turns it into the score.

Learning uses a bounded sample: for each class ``SAMPLE`` labelled documents at most, of ``SAMPLE_CHARS`` characters at
most, drawn by a hash of the key. Only documents are labelled, so that each round trains on the window of each document
that the present network (at first, word counts of both classes) finds most toxic, and on another one of each clean
document. Scoring reads every window of every text.

Defined cases: a null text, or one without words, scores 0. Null labels, and labels of keys that no document has, teach
nothing; a key labelled twice is toxic if one label is. Without sampled documents of both classes every score is 0.
Documents with equal texts get equal scores. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riftline.llm.langid import held_out

WINDOW, STRIDE, HIDDEN, WORD_BITS, PIECE_BITS, WIDTH = 32, 16, 10, 15, 15, 6
SAMPLE, SAMPLE_CHARS, ROUNDS, STEPS, RATE, BATCH, SEED = 2000, 20_000, 8, 16, 0.01, 256, 3
THRESHOLD = 0.3
#: Characters and windows that go through the network at a time.
PART, LANES = 2_000_000, 4096
MIX = np.uint64(0x9E3779B97F4A7C15)


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: whether it is a letter or digit, and its lower-case form where that is one character."""
    points = [chr(p) for p in range(0x110000)]
    part = np.fromiter((c.isalnum() for c in points), dtype=bool, count=len(points))
    lower = np.arange(0x110000, dtype=np.uint32)
    for p in np.flatnonzero(part):
        if len(c := chr(p).lower()) == 1:
            lower[p] = ord(c)
    return part, lower


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h * MIX) >> np.uint64(64 - bits)).astype(np.int32)


@dataclass
class Words:
    """Words of texts: the number of each in ``word``, a piece of code of each different one, and where texts begin."""

    id: np.ndarray
    word: np.ndarray
    pieces: np.ndarray
    owner: np.ndarray
    begin: np.ndarray


class Reader:
    """Cuts texts into words with hashed buckets."""

    def __init__(self) -> None:
        self.part, self.lower = _letters()

    def read(self, texts: list[str]) -> Words:
        """Texts are joined by blanks and handled as one array of code points."""
        points = np.frombuffer(" ".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        points = self.lower[np.minimum(points, 0x10FFFF)]
        inside = self.part[points]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        first, last = edge[::2], edge[1::2]
        ends = np.cumsum([len(t) + 1 for t in texts])
        begin = np.concatenate([[0], np.searchsorted(first, ends)]).astype(np.int64)
        if not len(first):
            empty = np.zeros(0, dtype=np.int32)
            return Words(empty, empty, empty, empty, begin)
        # a polynomial of the code points names a word; unequal words with the same 64 bits would share their vectors
        at = np.arange(len(points), dtype=np.int64)
        power = np.empty(int((last - first).max()) + 1, dtype=np.uint64)
        power[0] = 1
        with np.errstate(over="ignore"):
            power[1:] = np.cumprod(np.full(len(power) - 1, 0x100000001B3, dtype=np.uint64))
            since = at - np.repeat(np.concatenate([[0], first]), np.diff(np.concatenate([[0], first, [len(points)]])))
            value = np.where(inside, (points.astype(np.uint64) + np.uint64(1)) * power[np.where(inside, since, 0)], np.uint64(0))
            name = np.add.reduceat(value, first)
        code, where, ids = np.unique(name, return_index=True, return_inverse=True)
        lo, hi = first[where], last[where]
        # pieces: four characters beginning one before each character of a word but its last (at least one piece)
        many = np.maximum(hi - lo - 1, 1)
        owner = np.repeat(np.arange(len(code), dtype=np.int32), many)
        start = np.repeat(lo, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) - 1
        h = np.zeros(len(start), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(4):
                place = start + k
                held = (place >= lo[owner]) & (place < hi[owner])
                c = np.where(held, points[np.clip(place, 0, len(points) - 1)], 0).astype(np.uint64)
                h = h * np.uint64(0x110001) + c
            return Words(ids.astype(np.int32), _bucket(code, WORD_BITS), _bucket(h, PIECE_BITS), owner, begin)


def windows(begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text of each window; the last of a text ends where the text does."""
    n = np.diff(begin)
    count = np.where(n > WINDOW, 1 + -(-(n - WINDOW) // STRIDE), (n > 0).astype(np.int64))
    of = np.repeat(np.arange(len(n)), count)
    place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    start = begin[of] + np.minimum(place * STRIDE, np.maximum(n[of] - WINDOW, 0))
    return start, np.minimum(n[of], WINDOW), of


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    """Weights by name: tables (words, pieces), gates of both directions, attention and output; and the final curve."""

    w: dict[str, np.ndarray] = field(default_factory=dict)
    curve: tuple[float, float] = (1.0, 0.0)

    @classmethod
    def new(cls, seed: int = SEED) -> Network:
        r, h, d = np.random.default_rng(seed), HIDDEN, 2 * WIDTH
        small = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        w = {"words": (0.05 * r.standard_normal((1 << WORD_BITS, WIDTH))).astype(np.float32), "pieces": (0.05 * r.standard_normal((1 << PIECE_BITS, WIDTH))).astype(np.float32)}
        for side in "fb":
            w |= {f"x{side}": small(d, 3 * h), f"h{side}": small(h, 3 * h), f"c{side}": np.zeros(3 * h, dtype=np.float32)}
        return cls(w | {"aw": small(2 * h, h), "ab": np.zeros(h, dtype=np.float32), "av": small(h), "o": small(2 * h), "ob": np.full(1, -1.0, dtype=np.float32)})

    def inputs(self, words: Words) -> np.ndarray:
        """Vector of each different word."""
        starts = np.flatnonzero(np.diff(words.owner, prepend=-1))
        return np.concatenate([self.w["words"][words.word], np.add.reduceat(self.w["pieces"][words.pieces], starts, axis=0)], axis=1)

    def forward(self, gates: dict[str, np.ndarray], ids: np.ndarray, mask: np.ndarray | None, keep: bool = False):
        """Logits of windows. gates: the inputs' share of the gates of each different word. ids: [word of window, window]."""
        w, h, (steps, n) = self.w, HIDDEN, ids.shape
        states, kept = np.empty((steps, n, 2 * h), dtype=np.float32), {}
        for s, side in enumerate("fb"):
            g, u = gates[side], w[f"h{side}"]
            now, own = np.zeros((n, h), dtype=np.float32), slice(s * h, s * h + h)
            for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
                x, y = g[ids[t]], now @ u
                zr = _sigmoid(x[:, : 2 * h] + y[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                c = np.tanh(x[:, 2 * h :] + r * y[:, 2 * h :])
                new = c + z * (now - c)
                if mask is not None:
                    new = np.where(mask[t][:, None], new, now)
                if keep:
                    kept[side, t] = (now, z, r, c, y[:, 2 * h :])
                states[t, :, own] = now = new
        e = np.tanh(states.reshape(-1, 2 * h) @ w["aw"] + w["ab"])
        a = (e @ w["av"]).reshape(steps, n)
        if mask is not None:
            a = np.where(mask, a, -1e9)
        a = np.exp(a - a.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", a, states)
        logit = pooled @ w["o"] + w["ob"][0]
        return (logit, states, e.reshape(steps, n, h), a, pooled, kept) if keep else logit

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {side: (x @ self.w[f"x{side}"] + self.w[f"c{side}"]).astype(np.float32) for side in "fb"}

    def backward(self, x: np.ndarray, ids: np.ndarray, mask: np.ndarray | None, wanted: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of windows with labels ``wanted``, and gradients; that of "x" is of the different words' vectors."""
        w, h, (steps, n) = self.w, HIDDEN, ids.shape
        logit, states, e, a, pooled, kept = self.forward(self.gates(x), ids, mask, keep=True)
        loss = float(np.mean(np.logaddexp(0, logit) - wanted * logit))
        d = ((_sigmoid(logit) - wanted) / n).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in w.items() if k not in ("words", "pieces")}
        g["o"], g["ob"] = pooled.T @ d, np.array([d.sum()], dtype=np.float32)
        dp = d[:, None] * w["o"]
        ds = a[:, :, None] * dp
        da = np.einsum("tnh,nh->tn", states, dp)
        da = a * (da - (a * da).sum(axis=0))
        de = da[:, :, None] * w["av"] * (1 - e * e)
        g["av"] = np.einsum("tn,tnh->h", da, e)
        flat = de.reshape(-1, h)
        g["aw"], g["ab"] = states.reshape(-1, 2 * h).T @ flat, flat.sum(axis=0)
        ds += (flat @ w["aw"].T).reshape(steps, n, 2 * h)
        dx = np.zeros_like(x)
        for s, side in enumerate("fb"):
            u, wx, carry = w[f"h{side}"], w[f"x{side}"], np.zeros((n, h), dtype=np.float32)
            for t in range(steps - 1, -1, -1) if side == "f" else range(steps):
                before, z, r, c, y = kept[side, t]
                dn = ds[t, :, s * h : s * h + h] + carry
                live = dn if mask is None else dn * mask[t][:, None]
                dc = live * (1 - z) * (1 - c * c)
                dz = live * (before - c) * z * (1 - z)
                dr = dc * y * r * (1 - r)
                dg = np.concatenate([dz, dr, dc], axis=1)
                dy = np.concatenate([dz, dr, dc * r], axis=1)
                carry = dn - live + live * z + dy @ u.T
                g[f"h{side}"] += before.T @ dy
                g[f"x{side}"] += x[ids[t]].T @ dg
                g[f"c{side}"] += dg.sum(axis=0)
                np.add.at(dx, ids[t], dg @ wx.T)
        return loss, g | {"x": dx}

    def logits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Logit and text of each window."""
        start, size, of = windows(words.begin)
        out = np.zeros(len(start), dtype=np.float32)
        if len(start):
            gates = self.gates(self.inputs(words))
            whole = np.flatnonzero(size == WINDOW)
            for k in range(0, len(whole), LANES):
                at = whole[k : k + LANES]
                out[at] = self.forward(gates, words.id[start[at] + np.arange(WINDOW)[:, None]], None)
            short = np.flatnonzero(size < WINDOW)
            for k in range(0, len(short), LANES):
                at = short[k : k + LANES]
                out[at] = self.forward(gates, *_padded(words, start[at], size[at]))
        return out, of

    def predict(self, reader: Reader, texts: list[str]) -> np.ndarray:
        """Score of each text; long texts go through in parts that overlap by a window, cut between words."""
        top = np.full(len(texts), -np.inf)
        parts: list[str] = []
        owners: list[int] = []

        def flush() -> None:
            logit, of = self.logits(reader.read(parts))
            np.maximum.at(top, np.array(owners, dtype=np.int64)[of], logit)
            parts.clear()
            owners.clear()

        chars = 0
        for k, text in enumerate(texts):
            for part in _parts(text):
                parts.append(part)
                owners.append(k)
                chars += len(part)
                if chars >= PART:
                    flush()
                    chars = 0
        if parts:
            flush()
        return np.where(np.isfinite(top), _sigmoid(self.curve[0] * np.where(np.isfinite(top), top, 0) + self.curve[1]), 0.0)


def _parts(text: str) -> Iterator[str]:
    """Pieces of at most about ``PART`` characters; each begins ``WINDOW`` words before the end of the one before."""
    at = 0
    while len(text) - at > PART:
        end, seen = at + PART, 0
        cut = end
        while end < len(text) and text[end - 1].isalnum() and text[end].isalnum():
            end += 1  # a word is never cut
        cut = end
        while cut > at + PART // 2 and seen < WINDOW:
            cut -= 1
            seen += text[cut].isalnum() and not text[cut - 1].isalnum()
        yield text[at:end]
        at = cut if seen == WINDOW else end
    yield text[at:]


def _padded(words: Words, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.arange(int(size.max()))[:, None]
    return words.id[start + np.minimum(place, size - 1)], place < size


def _counts(words: Words, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket of words and of pieces: how much more often toxic documents hold it, as a damped logarithm."""
    doc = np.repeat(np.arange(len(labels)), np.diff(words.begin))
    many = np.bincount(words.owner, minlength=len(words.word))
    first = np.cumsum(many) - many
    out = []
    for bits, (d, b) in ((WORD_BITS, (doc, words.word[words.id])), (PIECE_BITS, (np.repeat(doc, many[words.id]), words.pieces[np.repeat(first[words.id], many[words.id]) + np.arange(int(many[words.id].sum())) - np.repeat(np.cumsum(many[words.id]) - many[words.id], many[words.id])]))):
        held = np.unique(d.astype(np.int64) << bits | b)
        toxic = labels[held >> bits] == 1
        ones, zeros = (np.bincount((held & ((1 << bits) - 1))[rows], minlength=1 << bits) for rows in (toxic, ~toxic))
        lift = np.log((ones + 0.5) / ((labels == 1).sum() + 1)) - np.log((zeros + 0.5) / ((labels == 0).sum() + 1))
        out.append((lift * ones / (ones + 5.0)).clip(-2, 4))
    return out[0], out[1]


def train(reader: Reader, texts: list[str], labels: np.ndarray, *, rounds: int = ROUNDS, seed: int = SEED) -> Network:
    """Learn from whole texts with labels 0 and 1."""
    net, r = Network.new(seed), np.random.default_rng(seed)
    words = reader.read(texts)
    start, size, of = windows(words.begin)
    by_word, by_piece = _counts(words, labels)
    net.w["words"][:, 0], net.w["pieces"][:, 0] = 0.5 * by_word, 0.25 * by_piece
    # a gate that lets the first entries pass, so that training begins with the counts
    lift = net.inputs(words)[:, [0, WIDTH]].max(axis=1)[words.id]
    running = np.concatenate([[0.0], np.cumsum(np.maximum(lift, 0))])
    logit = (running[start + size] - running[start]).astype(np.float32)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.w.items()}
    step = 0
    for turn in range(rounds):
        if turn:
            logit, _ = net.logits(words)
        order = np.lexsort((-logit, of))
        top = order[np.flatnonzero(np.diff(of[order], prepend=-1))]
        other = r.permutation(len(of))
        other = other[np.unique(of[other], return_index=True)[1]]
        chosen = np.concatenate([top, other[labels[of[other]] == 0]])
        chosen = r.permutation(chosen)
        some_at_a_time = min(BATCH, -(-len(chosen) // STEPS))  # small samples are learned in as many steps
        for k in range(0, len(chosen), some_at_a_time):
            at = chosen[k : k + some_at_a_time]
            ids, mask = _padded(words, start[at], size[at])
            used, local = np.unique(ids, return_inverse=True)
            some = _some(words, used)
            _, g = net.backward(net.inputs(some), local.reshape(ids.shape).astype(np.int32), None if mask.all() else mask, labels[of[at]].astype(np.float32))
            dx = g.pop("x")
            g["words"], g["pieces"] = np.zeros_like(net.w["words"]), np.zeros_like(net.w["pieces"])
            np.add.at(g["words"], some.word, dx[:, :WIDTH])
            np.add.at(g["pieces"], some.pieces, dx[some.owner, WIDTH:])
            step += 1
            for name, grad in g.items():
                m, v = moments[name]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                net.w[name] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    logit, _ = net.logits(words)
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, of, logit)
    net.curve = _logistic(best[np.isfinite(best)], labels[np.isfinite(best)])
    return net


def _some(words: Words, used: np.ndarray) -> Words:
    """The different words ``used`` alone."""
    many = np.bincount(words.owner, minlength=len(words.word))
    first = np.cumsum(many) - many
    n = many[used]
    at = np.repeat(first[used], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return Words(used, words.word[used], words.pieces[at], np.repeat(np.arange(len(used), dtype=np.int32), n), words.begin)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (at least a tenth) and intercept of a logistic curve, both held to (1, 0) by a light prior."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * x + b)
        v = np.maximum(p * (1 - p), 1e-9)
        grad = np.array([((p - y) * x).sum() + (a - 1), (p - y).sum() + b])
        hess = np.array([[(v * x * x).sum() + 1, (v * x).sum()], [(v * x).sum(), v.sum() + 1]])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(hess, grad), -2, 2)
    return max(0.1, float(a)), float(b)


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, *, most: int = SAMPLE, chars: int = SAMPLE_CHARS) -> tuple[list[str], np.ndarray]:
    """At most ``most`` texts of each class, of at most ``chars`` characters each."""
    marks = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h")).where(F.length("t") <= chars)
    # keys are ranked first; only the texts of those drawn move
    order = [F.xxhash64("k"), F.col("h")]
    place = F.row_number().over(Window.partitionBy("y").orderBy(*order))
    drawn = texts.select("k", "h").join(marks, "k").distinct().withColumn("place", place).where(F.col("place") <= most).select("k", "h", "y")
    once = texts.join(F.broadcast(drawn), ["k", "h"]).dropDuplicates(["k", "h"])
    rows = once.orderBy("y", *order).select("t", "y").collect()
    return [r["t"] for r in rows], np.array([r["y"] for r in rows], dtype=np.int64)


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> Network | None:
    """None if the sample lacks words of either class."""
    texts, y = sample(docs, labels, key, text, label)
    worded = np.array([any(c.isalnum() for c in t) for t in texts], dtype=bool)
    if len(set(y[worded].tolist())) < 2:
        return None
    return train(Reader(), [t for t, w in zip(texts, worded, strict=True) if w], y[worded])


def score(net: Network | None, text: Column, docs: DataFrame) -> Column:
    """Score, 0 to 1, of a text column of ``docs``."""
    if net is None:
        return F.lit(0.0)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader()
        for batch in batches:
            yield pd.Series(shared.value.predict(reader, [t or "" for t in batch]))

    return of(text)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    kept = ~held_out(F.col("doc_id"))
    net = fit(docs.where(kept), labels.where(kept), "doc_id", "text", "toxic")
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(net, F.col("text"), docs).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
