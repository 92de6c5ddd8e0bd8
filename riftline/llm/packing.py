"""Best-fit packing of token sequences by exact-complement hashing.

Documents become token pieces of at most ``capacity`` ids; pieces are combined into sequences that are as
full as possible. Spark tokenises, counts lengths, ranks the pieces of each length and assigns places. The
plan in between works on the histogram of lengths alone (``capacity`` numbers, whatever the corpus): sums of
one, two and three available lengths are looked up for the exact complement of every gap, combinations are
consumed as often as the counts allow, and what is left goes best-fit, longest first.

Defined cases: a null text counts as empty, which is one piece holding the end id alone; equal rows are
packed once each; an empty table gives an empty result; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riftline.llm.common import held, materialise, number_within, strings, taken

CAPACITY, END_ID = 4096, 1
#: Characters of one round of look-ups, and words remembered by a Python worker (about 100 MB).
ROUND_CHARS, MEMO_WORDS = 1_000_000, 400_000
#: Fixed value: what a byte is called in the vocabulary, where it is no printable character of Latin-1; ASCII words are as they are.
BYTE_LEVEL = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}


class WordTokenizer:
    """Ids as the tokenizer file gives them, with each distinct word encoded once.

    The tokenizer never joins anything across white space and encodes every word of its splitting
    pattern by itself, so the ids of a text are those of its words. Texts with characters outside the
    plain Latin range, where normalisation could depend on neighbours, go through the file's own pipeline.
    """

    #: Fixed value: the splitting pattern of the tokenizer file.
    WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    UNUSUAL = re.compile(r"[^\t\n\r\x20-\x7e\xa1-ɏ]|<\|")
    SPACE = re.compile(r"[ \t\n\r]")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.memo: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        """Remember the ids of white-space separated words: those of the parts that the pattern finds."""
        new = [w for w in words if w not in self.memo]  # a difference of sets would walk over the whole memo
        if len(self.memo) + len(new) > MEMO_WORDS:  # the words of this round have the frequent ones among them
            self.memo = {w: self.memo[w] for w in words & self.memo.keys()}
        single, split = [], []
        for w in new:  # most words are letters, or letters and one other character at the end
            if w.isalpha():
                single.append(w)
            else:
                split.append((w, (w[:-1], w[-1]) if w[:-1].isalpha() else self.WORDS.findall(w)))
        parts = [*single, *({p for _, found in split for p in found if p not in self.memo} - set(single))]
        tokens = self.whole.model.tokenize
        for p in parts:
            self.memo[p] = array("I", [t.id for t in tokens(p if p.isascii() else p.encode().decode("latin-1").translate(BYTE_LEVEL))]).tobytes()
        for w, found in split:
            self.memo[w] = b"".join(map(self.memo.__getitem__, found))

    def _cut(self, text: str) -> Iterator[str]:
        """Parts of about ROUND_CHARS that end before white space."""
        at = 0
        while len(text) - at > ROUND_CHARS and (m := self.SPACE.search(text, at + ROUND_CHARS)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def _round(self, parts: list[tuple[int, str]], out: list[list[bytes]]) -> None:
        split = []
        for k, part in parts:
            if self.UNUSUAL.search(part):
                out[k].append(array("I", self.whole.encode(part, add_special_tokens=False).ids).tobytes())
            else:
                split.append((k, part.lower().split()))
        self._learn(set().union(*(words for _, words in split)))
        for k, words in split:
            out[k].append(b"".join(map(self.memo.__getitem__, words)))

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[list[bytes]] = []
        parts: list[tuple[int, str]] = []
        chars = 0
        for text in texts:
            for part in self._cut(text) if "<|" not in text else [text]:
                parts.append((len(out), part))
                chars += len(part)
            out.append([])
            if chars >= ROUND_CHARS:
                self._round(parts, out)
                yield from map(b"".join, out)
                out, parts, chars = [], [], 0
        self._round(parts, out)
        yield from map(b"".join, out)


def worker_tokenizer(path: str) -> WordTokenizer:
    """One for all tasks of a Python worker, so that its memo lives on."""
    return held(("tokenizer", path), lambda: WordTokenizer(path))


def tokenise(docs: DataFrame, key: str, text: str, *, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32 (and the ids as bytes, if asked): one row a piece."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_tokenizer(tokenizer_path)
        for batch in taken(batches, keep=True):
            names = batch.column(0)
            source, rows = [], {"piece": [], "start": [], "length": [], "ids_crc32": []} | ({"ids": []} if keep_ids else {})
            for i, ids in enumerate(tokenizer.encode(t or "" for t in strings(batch.column(1)))):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    source.append(i)
                    rows["piece"].append(piece)
                    rows["start"].append(at // 4)
                    rows["length"].append(len(part) // 4)
                    rows["ids_crc32"].append(zlib.crc32(part))
                    if keep_ids:
                        rows["ids"].append(part)
            columns = [names.take(pa.array(source, pa.int64()))]
            columns += [pa.array(v, pa.int32() if k == "piece" else pa.binary() if k == "ids" else pa.int64()) for k, v in rows.items()]
            yield pa.RecordBatch.from_arrays(columns, names=[key, *rows])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


class Plan:
    """Patterns of lengths and how often each is used, from a histogram."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.patterns: list[tuple[tuple[int, ...], int]] = []
        self._exact()
        self._best_fit()

    def _use(self, lengths: tuple[int, ...]) -> None:
        """Consume the combination as often as the counts allow."""
        need = Counter(lengths)
        if (n := min(int(self.left[x]) // k for x, k in need.items())) > 0:
            for x, k in need.items():
                self.left[x] -= n * k
            self.patterns.append((lengths, n))

    def _pairs(self, total: int, most: int) -> np.ndarray:
        """Larger halves b <= most of the available pairs (b, total - b)."""
        b = np.arange((total + 1) // 2, min(total - 1, most) + 1)
        return b[(self.left[b] > 0) & (self.left[total - b] > 0)][::-1]

    def _exact(self) -> None:
        cap = self.capacity
        self._use((cap,))
        for a in range(cap - 1, (cap - 1) // 2, -1):  # one length fills the gap
            self._use((a, cap - a))
        for a in range(cap - 2, 0, -1):  # two lengths do
            if self.left[a]:
                for b in self._pairs(cap - a, a):
                    self._use((a, int(b), int(cap - a - b)))
        there = np.flatnonzero(self.left)
        mask = sum(1 << int(x) for x in there)
        sums = 0
        for x in there:
            sums |= mask << int(x)
        reach = np.array([sums >> s & 1 for s in range(cap + 1)], dtype=bool)
        for a in range(cap - 3, 0, -1):  # three lengths do
            if not self.left[a]:
                continue
            b = np.arange(1, min(a, cap - a - 2) + 1)
            for second in b[(self.left[b] > 0) & reach[cap - a - b]][::-1]:
                for third in self._pairs(cap - a - int(second), int(second)):
                    self._use((a, int(second), int(third), int(cap - a - second - third)))
                if not self.left[a]:
                    break

    def _best_fit(self) -> None:
        """Longest first, each into the open sequence whose gap is the least that holds it."""
        open_by_gap: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(self.capacity + 1)]
        used = np.zeros(self.capacity + 1, dtype=bool)

        def add(lengths: tuple[int, ...], n: int) -> None:
            if n:
                gap = self.capacity - sum(lengths)
                open_by_gap[gap].append((lengths, n))
                used[gap] = True

        for length in range(self.capacity, 0, -1):
            n, self.left[length] = int(self.left[length]), 0
            while n:
                gaps = np.flatnonzero(used[length:])
                gap = int(gaps[0]) + length if gaps.size else self.capacity
                lengths, bins = open_by_gap[gap].pop() if gaps.size else ((), n)
                if gaps.size:
                    used[gap] = bool(open_by_gap[gap])
                copies = gap // length
                filled, rest = min(bins, n // copies), 0
                add(lengths + (length,) * copies, filled)
                n -= filled * copies
                if n and filled < bins:
                    rest, n = n, 0
                    add(lengths + (length,) * rest, 1)
                if gaps.size:
                    add(lengths, bins - filled - bool(rest))
        for gap in range(self.capacity + 1):
            self.patterns += open_by_gap[gap]

    def runs(self) -> dict[str, np.ndarray]:
        """By length and rank: where a run of pieces of one length goes."""
        rows, given, sequence = [], Counter(), 0
        for lengths, n in self.patterns:
            offset = 0
            for length, copies in Counter(lengths).items():
                rows.append((length, given[length], copies, sequence, offset))
                given[length] += n * copies
                offset += length * copies
            sequence += n
        rows.sort()
        table = np.array(rows, dtype=np.int64).reshape(-1, 5)
        return dict(zip(("length", "first", "copies", "sequence", "offset"), table.T, strict=True))


def place(pieces: DataFrame, *, capacity: int = CAPACITY, order: list[str]) -> DataFrame:
    """Add sequence_id and offset to pieces that have a ``length``; ``pieces`` must be materialised.

    The driver gets the histogram of lengths: ``capacity`` rows at most.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = Plan(histogram, capacity).runs()
    key = runs["length"] << 44 | runs["first"]

    @F.pandas_udf("sequence_id long, offset long")
    def of(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, r = length.to_numpy(dtype=np.int64), rank.to_numpy(dtype=np.int64)
        k = np.searchsorted(key, size << 44 | r, side="right") - 1
        i = r - runs["first"][k]
        return pd.DataFrame({"sequence_id": runs["sequence"][k] + i // runs["copies"][k], "offset": runs["offset"][k] + i % runs["copies"][k] * size})

    ranked = number_within(pieces, "length", order, "_rank").withColumn("_at", of("length", "_rank"))
    return ranked.select("*", "_at.sequence_id", "_at.offset").drop("_at", "_rank")


def pack(docs: DataFrame, key: str, text: str, *, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place in the packed sequences."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    pieces = materialise(tokenise(docs, key, text, tokenizer_path=tokenizer_path, capacity=capacity, end_id=end_id, keep_ids=keep_ids))
    return place(pieces, capacity=capacity, order=[key, "piece", "ids_crc32"])


def query(docs: DataFrame) -> DataFrame:
    return pack(docs, "doc_id", "text").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
