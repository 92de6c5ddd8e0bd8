"""Language identification by cross-parsing.

For each language a suffix automaton of labelled text recognises every substring of it. A document is parsed
greedily into the longest phrases that the automaton of a language knows, and the language whose code needs the
fewest bits a symbol wins. Automata are flat transition tables, and a worker parses thousands of blocks of text
in step.

The code is the same for all languages and could be decoded, so that a sample is never cheap for being small: one
bit tells a phrase from a single symbol; a phrase is its place in the sample (the logarithm of the sample's
length) and its length (1 + 2 log2); a single symbol is one of the alphabet of all samples together, and a letter
that no sample has is one of all code points besides. Phrases that are cheaper as single symbols are coded so.

Learning uses a bounded sample: at most ``sample_chars`` characters a language, drawn by a hash of the key,
each row giving a quarter of that at most. Prediction reads every whole text; a phrase ends at the borders of
blocks of ``BLOCK`` symbols, which adds one phrase a block at most.

Defined cases: a null text, or one without letters, is ``und`` with score 0; so is everything if no row can be
learned from. Ties go to the language that sorts first. Equal texts get equal results. Rows with a null
language are never learned from. An empty table gives an empty result. An input column that is called like
one of the results is replaced; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riftline.llm.common import taken

SAMPLE_CHARS, BLOCK, LANES, PART = 60_000, 1024, 2048, 2_000_000
UNKNOWN = "und"
#: Symbols: 0 is any run of other characters than letters, 1 a letter that no sample has.
GAP, UNSEEN, MOST_SYMBOLS = 0, 1, 160


def held_out(key: Column) -> Column:
    """Rows kept apart for measuring: a quarter, by the checksum of the key."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 4 == 2


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: whether it is a letter, and its lower-case form where that is one character."""
    points = [chr(p) for p in range(0x110000)]
    is_letter = np.fromiter((c.isalpha() for c in points), dtype=bool, count=len(points))
    lower = np.arange(0x110000, dtype=np.uint32)
    for p in np.flatnonzero(is_letter):
        if len(c := chr(p).lower()) == 1:
            lower[p] = ord(c)
    return is_letter, lower


def automaton(text: np.ndarray, symbols: int) -> np.ndarray:
    """Transition table [state, symbol] of the suffix automaton of ``text``; 0 means none, the root is 0."""
    size = 2 * len(text) + 2
    step = np.zeros((size, symbols), dtype=np.int32)
    link, length = [-1] + [0] * (size - 1), [0] * size
    edges: list[dict[int, int]] = [{}]
    last = 0
    for c in text.tolist():
        new = len(edges)
        edges.append({})
        length[new] = length[last] + 1
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] != length[p] + 1:
                clone = len(edges)
                edges.append(dict(edges[q]))
                length[clone], link[clone] = length[p] + 1, link[q]
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = clone
                    p = link[p]
                link[q] = clone
                q = clone
            link[new] = q
        last = new
    for state, out in enumerate(edges):
        step[state, list(out)] = list(out.values())
    return step[: len(edges)].copy()


@dataclass
class Model:
    """Languages in order, one table and one text length for each, and the symbol of every code point."""

    langs: list[str]
    tables: list[np.ndarray]
    lengths: list[int]
    symbol: np.ndarray

    def literal(self) -> float:
        """Bits of a known symbol by itself: what text costs that holds no phrase of the language."""
        return 1 + float(np.log2(self.tables[0].shape[1]))

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all texts in one array, where each text begins in it, and the letters of each text."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        s = self.symbol[points]
        keep = s != GAP
        letters = np.bincount(owner[keep], minlength=len(texts))
        keep[1:] |= (s[:-1] != GAP) & (owner[1:] == owner[:-1])  # the first character of a gap stays
        return s[keep], np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=len(texts)))]), letters

    def bits(self, blocks: np.ndarray, sizes: np.ndarray, table: np.ndarray, length: int) -> np.ndarray:
        """Bits of each block (a column of ``blocks``) by the automaton of a sample of ``length`` symbols; sizes fall."""
        flat, root, width = table.ravel(), table[0], table.shape[1]
        single = np.full(width, 1 + np.log2(width))
        single[UNSEEN] += np.log2(0x110000)
        long = np.arange(1, BLOCK + 1)
        price = np.concatenate([[0.0], np.minimum(2 + np.log2(max(length, 1)) + 2 * np.log2(long), long * single[GAP])])
        state, begun, found = np.zeros(len(sizes), dtype=np.int32), np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes))
        for t in range(int(sizes[0]) if len(sizes) else 0):
            k = int(np.searchsorted(-sizes, -t, side="left"))
            c, s = blocks[t, :k], state[:k]
            after = flat[s * width + c]
            ended = np.flatnonzero(after == 0)
            first = root[c[ended]]
            found[ended] += price[t - begun[ended]] + np.where(first == 0, single[c[ended]], 0.0)
            begun[ended] = t + (first == 0)
            after[ended] = first
            state[:k] = after
        return found + price[sizes - begun]

    def costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a symbol for each text and language, and the letters of each text.

        Texts go through in parts of at most ``PART`` characters, about as many at a time: memory is bounded
        whatever the batch and the longest text are.
        """
        total, n, letters = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        parts: list[str] = []
        owners: list[int] = []

        def flush() -> None:
            bits, symbols, found = self._parse(parts)
            np.add.at(total, owners, bits)
            np.add.at(n, owners, symbols)
            np.add.at(letters, owners, found)
            parts.clear()
            owners.clear()

        chars = 0
        for k, text in enumerate(texts):
            for at in range(0, len(text), PART):
                parts.append(text[at : at + PART])
                owners.append(k)
                chars += len(parts[-1])
                if chars >= PART:
                    flush()
                    chars = 0
        flush()
        return total / np.maximum(n, 1)[:, None], letters

    def _parse(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits for each text and language, symbols and letters of each text."""
        s, begin, letters = self.symbols(texts)
        n = np.diff(begin)
        count = -(-n // BLOCK)
        owner = np.repeat(np.arange(len(texts)), count)
        at = begin[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * BLOCK
        sizes = np.minimum(BLOCK, begin[owner + 1] - at)
        order = np.argsort(-sizes, kind="stable")
        total = np.zeros((len(texts), len(self.langs)))
        for k in range(0, len(order), LANES):
            these = order[k : k + LANES]
            grid = np.minimum(at[these][None, :] + np.arange(int(sizes[these[0]]))[:, None], len(s) - 1)
            blocks = s[grid]
            for lang, table in enumerate(self.tables):
                total[:, lang] += np.bincount(owner[these], self.bits(blocks, sizes[these], table, self.lengths[lang]), minlength=len(texts))
        return total, n, letters

    def predict(self, texts: list[str]) -> pd.DataFrame:
        """Language, the share by which the runner-up costs more, and the bits a symbol of the winner."""
        if not self.langs or not texts:
            return pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": 0.0, "bits": 0.0})
        cost, letters = self.costs(texts)
        rank = np.argsort(cost, axis=1, kind="stable")
        rows = np.arange(len(texts))
        best = cost[rows, rank[:, 0]]
        score = 1 - best / np.maximum(cost[rows, rank[:, 1]], 1e-9) if len(self.langs) > 1 else np.ones(len(texts))
        known = letters > 0
        return pd.DataFrame({"lang_pred": np.where(known, np.array(self.langs, dtype=object)[rank[:, 0]], UNKNOWN), "score": np.where(known, np.clip(score, 0, 1), 0.0), "bits": np.where(known, best, 0.0)})


def fit(labelled: DataFrame, key: str, text: str, lang: str, *, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Learn from a bounded sample of labelled rows: sample_chars characters a language at most."""
    most = sample_chars // 4
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), (F.abs(F.xxhash64(F.col(key)) % 1_000_003) / 1_000_003).alias("u"))
    sizes = rows.groupBy("lang").agg(F.sum(F.least(F.length("text"), F.lit(most))).alias("n")).collect()
    if not sizes:
        return Model([], [], [], np.zeros(0x110000, dtype=np.uint8))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, 2.0 * sample_chars / max(1, r["n"]) + 8.0 * most / max(1, r["n"])))])
    order = Window.partitionBy("lang").orderBy("u", F.xxhash64("text"))
    drawn = (
        rows.where(F.col("u") <= share[F.col("lang")])
        .select("lang", "u", F.substring("text", 1, most).alias("text"))
        .withColumn("before", F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .where(F.col("before") < sample_chars)
    )
    texts: dict[str, list[str]] = {}
    for r in drawn.orderBy("lang", "before").collect():
        texts.setdefault(r["lang"], []).append(r["text"])
    is_letter, lower = _letters()
    points = {k: np.frombuffer(" ".join(v)[:sample_chars].encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for k, v in texts.items()}
    seen, times = np.unique(np.concatenate([lower[p[is_letter[p]]] for p in points.values()]), return_counts=True)
    number = np.where(is_letter, UNSEEN, GAP).astype(np.uint8)
    rank = np.argsort(-times, kind="stable")
    number_of = np.empty(len(seen), dtype=np.uint8)
    number_of[rank] = 2 + np.where(np.arange(len(seen)) < MOST_SYMBOLS, np.arange(len(seen)), seen[rank] % MOST_SYMBOLS)
    letters = np.flatnonzero(is_letter)
    where = np.searchsorted(seen, lower[letters])
    hit = seen[np.minimum(where, len(seen) - 1)] == lower[letters] if len(seen) else np.zeros(len(letters), dtype=bool)
    number[letters[hit]] = number_of[where[hit]]
    width = int(number.max()) + 1
    model = Model(sorted(points), [], [], number)
    for k in model.langs:
        s, _, _ = model.symbols([points[k].tobytes().decode("utf-32-le", "surrogatepass")])
        model.tables.append(automaton(s, width))
        model.lengths.append(len(s))
    return model


def identify(docs: DataFrame, text: str, model: Model, *, names: tuple[str, str, str] = ("lang_pred", "score", "bits")) -> DataFrame:
    """Add lang_pred, score (0 to 1) and bits (a symbol, of the winner) to every row, by these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("a string, b double, c double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in taken(batches):
            known = shared.value
            yield known.predict([t or "" for t in batch]).set_axis(["a", "b", "c"], axis=1)

    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names])
    parts = [F.col("__of")[x].alias(name) for x, name in zip("abc", names, strict=True)]
    return kept.withColumn("__of", of(F.col(text))).select(*[F.col(f"`{c}`") for c in kept.columns], *parts)


def query(docs: DataFrame) -> DataFrame:
    model = fit(docs.where(~held_out(F.col("doc_id"))), "doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), "text", model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits")
