"""Near-duplicate documents by SimHash, found with Golay-code fuzzy keys.

A fingerprint has 64 bits, each the majority vote of the word shingles' hashes. Fingerprints that differ in at
most four bits are linked, and linked documents form a group. The search is exact:

* The 64 bits are three segments A, B, C of 22, 21 and 21 bits, each of three parts. If two fingerprints differ
  in at most four bits, either a segment is equal, and so is one of any five parts of the others: a key is the
  segment and such a part. Or each segment has an error. Then A or B has exactly one, and one of the other two
  segments has exactly one as well, so that two of its parts are equal.
* The perfect Golay code (23, 12, 7) has a codeword within three bits of every word. A word takes the codewords
  nearest to itself and to each word one bit away as keys (one to six of them): of two words one bit apart, the
  one that the second decodes to is among the keys of both. So a key is such a codeword's twelve bits for A or
  for B, along with two parts of another segment. A fingerprint has about 77 keys, of 26 to 30 bits each.

Equal fingerprints are one row from the start. In each bucket of a key every row is compared with a few pivots first,
the least rows in several orders; components of these links are found. Where rows of a bucket are in different
components, up to ``SMALL`` rows are compared pair by pair. Those of larger buckets give all points at most two bits
away, 2,081 of a fingerprint whatever its buckets: of two fingerprints within four bits some point is the same, and all
that share a point are within four bits, so that components which meet in a point are linked with no comparison. No
point has more than 2,081 fingerprints, so the work grows with the rows of a group, not with their square.

Defined cases: a null text, or one without words, has fingerprint zero, which links like any other; fewer words
than a shingle make one shingle; documents with a null key join groups, but a group's name is the smallest key
that is not null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from riftline.llm.common import forget, materialise
from riftline.llm.components import components

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: Rows of a bucket that are compared pair by pair, at most; those of larger ones are compared by the points around them.
SMALL = 64
#: A pivot of a bucket is its least row after such a word is added bit by bit.
ORDERS = (0, 0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F)
#: Segments as (lowest bit, bits), and the parts of each.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PARTS = (((0, 8), (8, 7), (15, 7)), ((22, 7), (29, 7), (36, 7)), ((43, 7), (50, 7), (57, 7)))
#: Fixed value: the generator polynomial of the binary Golay code, x^11+x^9+x^7+x^6+x^5+x+1.
GENERATOR, LENGTH, CHECK = 0b101011100011, 23, 11

_UPPER_TO_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the word shingles of a whole text."""
    words = (text or "").encode().translate(_UPPER_TO_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        begins = np.concatenate([[0], ends[:-1]])[: len(words) - shingle + 1].tolist()
        hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begins, (ends[shingle - 1 :] - 1).tolist(), strict=True)), dtype=np.uint64, count=len(begins))
    votes = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * votes > len(hashes)).astype(np.uint8), bitorder="little").view(np.int64)[0])


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return of(text)


def _remainder(word: int) -> int:
    """Of the polynomial division by the generator: the syndrome."""
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK)
    return word


@lru_cache(1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """The syndrome of each single bit, and the error pattern of at most three bits of each syndrome."""
    single = [_remainder(1 << k) for k in range(LENGTH)]
    leader = np.zeros(1 << CHECK, dtype=np.int64)
    for n in (1, 2, 3):
        for bits in combinations(range(LENGTH), n):
            at = 0
            for b in bits:
                at ^= single[b]
            leader[at] = sum(1 << b for b in bits)
    return np.array(single, dtype=np.int64), leader


def golay_keys(words: np.ndarray, bits: int) -> np.ndarray:
    """[word, bits + 1]: data bits of the nearest codeword, and of that of each word one bit away; -1 repeats one."""
    single, leader = _golay()
    syndrome = np.zeros(len(words), dtype=np.int64)
    for k in range(bits):
        syndrome ^= np.where(words >> k & 1, single[k], 0)
    flips = np.concatenate([[0], 1 << np.arange(bits)])
    changed = np.concatenate([[0], single[:bits]])
    found = (words[:, None] ^ flips ^ leader[syndrome[:, None] ^ changed]) >> CHECK
    found.sort(axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and the row that each belongs to; two prints at most four bits apart share a key."""
    p = prints.view(np.uint64)
    bits_of = lambda low, bits: (p >> np.uint64(low) & np.uint64((1 << bits) - 1)).astype(np.int64)
    rows = np.arange(len(p))
    parts = [[bits_of(*x) for x in three] for three in PARTS]
    keys, owners = [], []

    def add(value: np.ndarray, row: np.ndarray) -> None:
        keys.append(np.int64(len(keys)) << 48 | value)
        owners.append(row)

    for s in range(3):
        whole = bits_of(*SEGMENTS[s]) << 16
        for part in [x for o in range(3) if o != s for x in parts[o]][:5]:
            add(whole | part, rows)
    for s in (0, 1):
        near = golay_keys(bits_of(*SEGMENTS[s]), SEGMENTS[s][1])
        row, column = np.nonzero(near >= 0)
        code = near[row, column] << 16
        for o in range(3):
            for a, b in combinations(parts[o], 2) if o != s else ():
                add(code | (a << 7 | b)[row], row)
    return np.concatenate(keys), np.concatenate(owners)


def _pairs(batches: Iterator[pa.RecordBatch], *, distance: int) -> Iterator[pa.RecordBatch]:
    """a, b: of the prints of each (small) bucket those of different roots within ``distance``."""
    for batch in batches:
        for prints, roots in zip(batch.column(0), batch.column(1), strict=True):
            p, r = (x.values.to_numpy(zero_copy_only=False) for x in (prints, roots))
            apart = np.bitwise_count((p[:, None] ^ p).view(np.uint64))
            a, b = np.nonzero(np.triu((apart <= distance) & (r[:, None] != r)))
            yield pa.RecordBatch.from_arrays([pa.array(p[a]), pa.array(p[b])], names=["a", "b"])


def _points(batches: Iterator[pa.RecordBatch], *, distance: int) -> Iterator[pa.RecordBatch]:
    """point, bit, root: all words at most half of ``distance`` from each print; prints share one only if within ``distance``.

    With an odd distance the words may differ in one bit more, which is taken out; else ``bit`` is -1.
    """
    one = np.array([1 << k if k < 63 else -1 << 63 for k in range(64)], dtype=np.int64)
    flips = np.concatenate([np.zeros(1, np.int64), one, [a ^ b for a, b in combinations(one, 2)]])[: (1, 65, 2081)[distance // 2]]
    for batch in batches:
        p, r = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        for k in range(0, len(p), 500):
            near = (p[k : k + 500, None] ^ flips)[:, :, None]
            near, bit = (near & ~one, np.arange(64)) if distance % 2 else (near, np.array([-1]))
            each = near.shape[1] * near.shape[2]
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel()), pa.array(np.resize(bit, near.size).astype(np.int32)), pa.array(np.repeat(r[k : k + 500], each))], names=["point", "bit", "root"])


def edges(prints: DataFrame, *, distance: int = DISTANCE) -> DataFrame:
    """a, b: links that connect the distinct prints as all pairs within ``distance`` bits would."""
    if distance > DISTANCE:
        raise ValueError("the keys find differences of at most four bits")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(0).to_numpy(zero_copy_only=False)
            for k in range(0, len(p), 20_000):
                part = np.ascontiguousarray(p[k : k + 20_000])
                key, row = fuzzy_keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], names=["key", "print"])

    # The aggregation and the join read one shuffle.
    keyed = prints.select("print").mapInArrow(explode, "key long, print long").repartition("key")
    least = [F.min(F.col("print").bitwiseXOR(F.lit(order))).bitwiseXOR(F.lit(order)) for order in ORDERS]
    buckets = keyed.groupBy("key").agg(F.array(*least).alias("pivots"), F.count(F.lit(1)).alias("n")).where("n > 1")
    close = lambda p: (p != F.col("print")) & (F.bit_count(p.bitwiseXOR(F.col("print"))) <= distance)
    shared = materialise(keyed.join(buckets, "key").select("key", "print", "n", F.array_distinct(F.filter("pivots", close)).alias("near")))
    star = materialise(shared.select("print", F.explode("near").alias("pivot")).distinct())
    first = materialise(components(star, "print", "pivot").withColumnsRenamed({"node": "print", "component": "root"}))
    # In a bucket of two the pivots have met the other row; in larger ones, rows of different roots are left to compare.
    rooted = materialise(shared.where("n > 2").join(first, "print", "left").select("key", "n", "print", F.coalesce("root", "print").alias("root")))
    several = F.min("root") != F.max("root")
    small = rooted.where(F.col("n") <= SMALL).groupBy("key").agg(F.collect_list("print").alias("prints"), F.collect_list("root").alias("roots"), several.alias("several"))
    pairs = small.where("several").select("prints", "roots").mapInArrow(partial(_pairs, distance=distance), "a long, b long").distinct()
    large = rooted.where(F.col("n") > SMALL)
    mixed = materialise(large.groupBy("key").agg(several.alias("several")).where("several").select("key"))
    around = materialise(large.join(mixed, "key", "left_semi").select("print", "root").distinct()).mapInArrow(partial(_points, distance=distance), "point long, bit int, root long")
    met = around.groupBy("point", "bit").agg(F.collect_set("root").alias("roots")).where(F.size("roots") > 1).select(F.array_min("roots").alias("a"), F.explode("roots").alias("b"))
    out = materialise(star.select(F.col("print").alias("a"), F.col("pivot").alias("b")).unionByName(pairs).unionByName(met.where("a != b").distinct()))
    forget(shared, rooted)
    return out


def link(prints: DataFrame, *, distance: int = DISTANCE) -> DataFrame:
    """print, root: for each distinct print that links with another, the least print that it reaches."""
    return components(edges(prints, distance=distance), "a", "b").withColumnsRenamed({"node": "print", "component": "root"})


def candidates(contents: DataFrame, name: str, text: str, *, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """a, b: pairs of names that connect all contents whose fingerprints are linked; equal rows count once.

    Names of one fingerprint are paired with the least of them, linked fingerprints by their least names.
    """
    printed = materialise(contents.select(F.col(name).alias("name"), fingerprints(F.col(text), shingle).alias("print")).distinct())
    classes = materialise(printed.groupBy("print").agg(F.min("name").alias("least")))
    same = printed.join(classes, "print").where("name != least").select(F.col("name").alias("a"), F.col("least").alias("b"))
    of = lambda end: classes.select(F.col("print").alias(end), F.col("least").alias(f"{end}_name"))
    linked = edges(classes, distance=distance).join(of("a"), "a").join(of("b"), "b").select(F.col("a_name").alias("a"), F.col("b_name").alias("b"))
    return same.unionByName(linked)


def group(docs: DataFrame, key: str, text: str, *, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """key, print, component (the smallest key of the group): one row for each row of ``docs``."""
    printed = materialise(docs.select(F.col(key).alias("key"), fingerprints(F.col(text), shingle).alias("print")))
    classes = materialise(printed.groupBy("print").agg(F.min("key").alias("least")))
    roots = materialise(link(classes, distance=distance))
    rooted = classes.join(roots, "print", "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = materialise(rooted.join(names, "root").select("print", "component"))
    return printed.join(named, "print").select("key", "print", "component")


def query(docs: DataFrame) -> DataFrame:
    found = group(docs, "doc_id", "text")
    return found.select(F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
