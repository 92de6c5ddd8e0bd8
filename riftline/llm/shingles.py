"""Words, shingles and MinHash signatures of many lines at once, with numpy.

Words are runs of other than ASCII white space, A-Z in lower case. A line of fewer words than a shingle has one, all of
its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from xxhash import xxh64_intdigest

from riftline.llm.common import taken

SHINGLE, SKETCH, SEED = 5, 4, 42
#: Characters of text in memory at a time, apart from a longer single text.
PART = 2_000_000

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_REST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * _PRIME
    return x ^ x >> np.uint64(29)


def words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of a text begin and end, and their 64-bit hashes, eight bytes of all words at a time."""
    data = np.frombuffer(raw, dtype=np.uint8)
    gap = np.concatenate([[True], _SPACE[data], [True]])
    begin, stop = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    eight = np.ndarray((len(raw) + 1,), dtype="<u8", buffer=raw.translate(LOWER) + bytes(8), strides=(1,))
    size = stop - begin
    h = mix(size.astype(np.uint64) + np.uint64(SEED))
    at, k = np.arange(len(begin)), 0
    while len(at):
        part = eight[begin[at] + k] & _REST[np.minimum(size[at] - k, 8)]
        h[at] = mix(h[at] * _PRIME + part)
        k += 8
        at = at[size[at] > k]
    return begin, stop, h


def chain(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, in order."""
    out = h[: max(0, len(h) - n + 1)].copy()
    for k in range(1, n):
        out = mix(out) + h[k : len(out) + k]
    return mix(out)


def odd_sketch(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run [first, last) the parities of its distinct values in 64 * SKETCH bits, and their number."""
    n = last - first
    owner = np.repeat(np.arange(len(first)), n)
    values = values[np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    owner, values = owner[new], values[new]
    bits = np.bincount(owner * (64 * SKETCH) + (mix(values) >> np.uint64(56)).astype(np.int64), minlength=len(first) * 64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64).reshape(len(first), SKETCH), np.bincount(owner, minlength=len(first)).astype(np.int32)


def runs(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the shingles of lines of one word and more, and where each line's begin and end among them."""
    begin, stop, h = words(b"\n".join(lines))
    last = np.searchsorted(begin, np.cumsum([len(x) + 1 for x in lines]))
    first = np.concatenate([[0], last[:-1]])
    short = np.flatnonzero(last - first < SHINGLE)
    every = chain(h, SHINGLE)
    whole = np.array([xxh64_intdigest(h[a:b].tobytes(), SEED) for a, b in zip(first[short].tolist(), last[short].tolist(), strict=True)], dtype=np.uint64)
    low, high = first.copy(), last - SHINGLE + 1
    low[short] = len(every) + np.arange(len(short))
    high[short] = low[short] + 1
    return np.concatenate([every, whole]), low, high


def bands_of(values: np.ndarray, low: np.ndarray, high: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """[line, bands], for the shingles [low, high) of each line."""
    spans = np.stack([low, high], axis=1).ravel()
    odd = np.random.default_rng(SEED).integers(1, 1 << 62, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    band = np.zeros((len(low), bands), dtype=np.uint64)
    for k, factor in enumerate(odd):
        least = np.minimum.reduceat(np.append(mix(values * factor), np.uint64(0)), spans)[::2]
        band[:, k // rows] = mix(band[:, k // rows] + least) + np.uint64(k // rows)
    return band.view(np.int64)


def signatures(lines: list[bytes], bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """[line, bands and sketch], and the number of distinct shingles, of lines of one word and more."""
    values, low, high = runs(lines)
    sketch, size = odd_sketch(values, low, high)
    return np.concatenate([bands_of(values, low, high, bands, rows), sketch], axis=1), size


def _by_content(batch: pa.RecordBatch) -> Iterator[dict[int, bytes]]:
    """Bodies with a word by content, a content once a batch, some ``PART`` characters at a time."""
    found: dict[int, bytes] = {}
    chars, left = 0, batch.num_rows
    for content, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        left -= 1
        raw = (body or "").encode()
        if content not in found and raw.strip(b"\t\n\x0b\x0c\r "):
            found[content] = raw
            chars += len(raw)
        if found and (chars >= PART or not left):
            yield found
            found, chars = {}, 0


def signed(bands: int, rows: int):
    """For ``mapInArrow`` over (content, body): content, bands (with the sketch at the end), size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in taken(batches):
            for found in _by_content(batch):
                values, size = signatures(list(found.values()), bands, rows)
                offsets = np.arange(len(found) + 1, dtype=np.int32) * (bands + SKETCH)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel())), pa.array(size)], names=["content", "bands", "size"])

    return run


def banded(bands: int, rows: int):
    """For ``mapInArrow`` over (content, body): content, bands (nothing else, so that no sketch is made)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in taken(batches):
            for found in _by_content(batch):
                values = bands_of(*runs(list(found.values())), bands, rows)
                offsets = np.arange(len(found) + 1, dtype=np.int32) * bands
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))], names=["content", "bands"])

    return run


def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow`` over (content, body): content, s (hashes of the distinct shingles)."""
    for batch in taken(batches):
        for found in _by_content(batch):
            values, low, high = runs(list(found.values()))
            sets = [np.unique(values[a:b]).view(np.int64) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], names=["content", "s"])
