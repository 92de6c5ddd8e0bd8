"""Passages that repeat across documents, by paragraph MinHash banding.

Two kinds of paragraph are compared:

* Lines of any length get a MinHash signature of their word shingles in ``BANDS`` bands of ``ROWS`` rows. At a
  similarity of 0.8 all but 8 pairs in 10,000 meet in some band; what meets is verified by exact Jaccard similarity, and
  clusters are components (``banding``).
* Grams find passages that stand in the middle of other lines: of each ``WINDOW`` runs of ``GRAM`` words that begin at
  neighbouring words, those of the least hash. Whatever ``GRAM + WINDOW - 1`` = 25 words two documents share, they share
  one of these, and a longer common run is covered by them but for at most ``WINDOW - 1`` words at each end. A gram's one
  band is the hash of its words, of 96 bits; equal ones stand for equal words.
* The ends are then found to the word: where the words beside a gram that repeats are in no repeat, they are compared
  with those at its other occurrences, by hashes of the next one, two and more words. Contexts that are equal in full
  count once, so that the work does not grow with the square of a group of copies.

A paragraph repeats if another document has one of its cluster. The occurrence with the smallest key and start stays,
the others are to be removed. Repeats that overlap or touch form a passage. One of fewer than ``least`` words (25 unless
given; smaller values take smaller grams and windows) is left alone, since short stock phrases are in any text, unless
it is its whole document.

Defined cases: a null or empty text has no passages; repeats inside one document only are no clusters; documents that
share a key but not the text count as different, rows equal in both as one; an empty table gives an empty result; other
columns are ignored. Of equal texts the first document alone is worked through, since all of each other one is a passage.
Every run of ``least`` words or more that two documents share lies in a passage of both. In texts that repeat themselves,
a sixth of the equal grams stand for all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from riftline.llm.banding import SIMILARITY, clusters
from riftline.llm.common import TEXTS, forget, if_few, materialise, row_keyed, sweep, taken
from riftline.llm.shingles import PART, mix, words

GRAM, WINDOW, LEAST, BANDS, ROWS = 14, 12, 25, 7, 2
#: Odd factors of the hash of a run of words and of its check, and their inverses modulo 2^64.
_FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_INVERSES = tuple(pow(f, -1, 1 << 64) for f in _FACTORS)


def sizes(least: int) -> tuple[int, int]:
    """Words of a gram, and grams of a window, that find every common run of ``least`` words."""
    gram = max(1, min(GRAM, least))
    return gram, max(1, min(WINDOW, least - gram + 1))


def _slide(x: np.ndarray, size: int, of: np.ufunc) -> np.ndarray:
    """The least or the largest of each ``size`` neighbours."""
    done = 1
    while done < size:
        step = min(done, size - done)
        x = of(x[:-step], x[step:])
        done += step
    return x


def _powers(n: int, factor: int) -> np.ndarray:
    out = np.full(n + 1, factor, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Runs:
    """Hashes of runs of words [first, last), whatever stands around them."""

    def __init__(self, h: np.ndarray, k: int = 0) -> None:
        self.sums = np.append(np.uint64(0), np.cumsum(h * _powers(len(h) - 1, _FACTORS[k])))
        self.back = _powers(len(h), _INVERSES[k])

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return mix((self.sums[last] - self.sums[first]) * self.back[first] + (last - first).astype(np.uint64))


class Texts:
    """Texts as one, a line feed between them: the words of all, ``base`` of the first of each and of an end."""

    def __init__(self, texts: list[bytes]) -> None:
        self.raw = b"\n".join(texts)
        self.begin, self.stop, self.h = words(self.raw)
        self.head = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        self.base = np.searchsorted(self.begin, self.head)

    def places(self, owner: np.ndarray, w0: np.ndarray, w1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points [start, end) of words [w0, w1) of the texts ``owner``."""
        point = np.append(0, np.cumsum(np.frombuffer(self.raw, dtype=np.uint8) & 0xC0 != 0x80))  # code points before each byte
        zero = point[self.head[owner]]
        return point[self.begin[self.base[owner] + w0]] - zero, point[self.stop[self.base[owner] + w1 - 1]] - zero


def _each(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists of these sizes one after another: whose each member is, and its number there."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def chosen(g: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which grams stand for their neighbours, by their hashes: the least of any window of them; ``counts`` grams a text.

    Of equal ones, ``window`` // 2 grams apart at most, the first of each ``window`` // 2 and the last: some gram of the
    same words is left in each window.
    """
    owner, _ = _each(counts)
    few = (counts <= window)[owner]
    kept = few & (g == np.minimum.reduceat(g, np.cumsum(counts) - counts)[owner])
    if not few.all():
        inside = owner[: len(g) - window + 1] == owner[window - 1 :]
        edge = np.zeros(window - 1, dtype=g.dtype)
        least = np.where(inside, _slide(g, window, np.minimum), np.uint64(0))
        kept |= ~few & (g == _slide(np.concatenate([edge, least, edge]), window, np.maximum))
    at = np.flatnonzero(kept)
    part = max(1, window // 2)
    near = np.concatenate([[False], (np.diff(at) <= part) & (g[at[1:]] == g[at[:-1]]) & (owner[at[1:]] == owner[at[:-1]])])
    if not near.any():
        return at
    start = np.maximum.accumulate(np.where(near, 0, at))
    block = (at - start) // part
    first = ~near | np.concatenate([[True], block[1:] != block[:-1]])
    return at[first | ~np.append(near[1:], False)]


def _listed(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def _structs(counts: np.ndarray, **columns: np.ndarray) -> pa.ListArray:
    return _listed(pa.StructArray.from_arrays([pa.array(c) for c in columns.values()], names=list(columns)), counts)


def _parts(column: pa.Array) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Rows and their texts, without null and empty ones, some ``PART`` bytes at a time."""
    rows: list[int] = []
    texts: list[bytes] = []
    size = 0
    for k in range(0, len(column), TEXTS):
        for j, t in enumerate(column.slice(k, TEXTS).cast(pa.binary()).to_pylist(), k):
            if t:
                rows.append(j)
                texts.append(t)
                size += len(t)
            if size >= PART:
                yield np.array(rows), texts
                rows, texts, size = [], [], 0
    if rows:
        yield np.array(rows), texts


def units(keyed: DataFrame, text: str, *, least: int = LEAST) -> DataFrame:
    """_rk, words, grams, lines: a row for each text with a word."""
    gram, window = sizes(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in taken(batches):
            for rows, texts in _parts(batch.column(1)):
                of = Texts(texts)
                filled = np.flatnonzero(np.diff(of.base))
                if not len(filled):
                    continue
                base, n = of.base[filled], np.diff(of.base)[filled]
                counts = np.maximum(1, n - gram + 1)
                owner, w0 = _each(counts)
                first = base[owner] + w0
                last = np.minimum(first + gram, (base + n)[owner])
                content = Runs(of.h).of(first, last)
                at = chosen(content, counts, window)
                check = (Runs(of.h, 1).of(first[at], last[at]) >> np.uint64(33)).astype(np.int32)
                grams = _structs(np.bincount(owner[at], minlength=len(filled)), content=content[at].view(np.int64), check=check, w0=w0[at].astype(np.int32))
                feet = np.append(np.flatnonzero(np.frombuffer(of.raw, dtype=np.uint8) == 10), len(of.raw))
                heads = np.concatenate([[0], feet[:-1] + 1])
                l0, l1 = np.searchsorted(of.begin, heads), np.searchsorted(of.begin, feet)
                has = np.flatnonzero(l1 > l0)
                l0, l1 = l0[has], l1[has]
                hashed = np.array([xxh64_intdigest(of.raw[a:b], 42) for a, b in zip(heads[has].tolist(), feet[has].tolist(), strict=True)], dtype=np.uint64)
                whose = np.searchsorted(base, l0, "right") - 1
                lines = _structs(np.bincount(whose, minlength=len(filled)), content=hashed.view(np.int64), w0=(l0 - base[whose]).astype(np.int32), w1=(l1 - base[whose]).astype(np.int32))
                name = batch.column(0).take(pa.array(rows[filled]))
                yield pa.RecordBatch.from_arrays([name, pa.array(n.astype(np.int32)), grams, lines], names=["_rk", "words", "grams", "lines"])

    listed = "grams array<struct<content:long,check:int,w0:int>>, lines array<struct<content:long,w0:int,w1:int>>"
    return keyed.select("_rk", text).mapInArrow(run, f"_rk {keyed.schema['_rk'].dataType.simpleString()}, words int, {listed}")


def numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """_rk, doc, head, last: documents numbered in the order of their keys, with the first and the last of equal text."""
    keys = materialise(row_keyed(docs.select(key, text), key, text).select("_rk").distinct())
    order = [F.col("_rk.k").asc_nulls_first(), F.col("_rk.h")]
    numbers = materialise(keys.orderBy(*order).select("_rk", F.monotonically_increasing_id().alias("doc")))
    copies = materialise(numbers.groupBy(F.col("_rk.h").alias("h")).agg(F.min("doc").alias("head"), F.max("doc").alias("last")).where("head != last"))
    joined = numbers.join(if_few(copies), F.col("_rk.h") == F.col("h"), "left")
    out = materialise(joined.select("_rk", "doc", F.coalesce("head", "doc").alias("head"), F.coalesce("last", "doc").alias("last")))
    forget(keys, numbers, copies)
    return out


def members(docs: DataFrame, numbers: DataFrame, key: str, text: str, *, similarity: float = SIMILARITY, least: int = LEAST) -> DataFrame:
    """doc, words, u (line, content, w0, w1, low): the repeats of each text that has some, of equal texts those of the first.

    content: the cluster; low: the first document of it.
    """
    gram = sizes(least)[0]
    heads = numbers.where("doc = head").select("_rk", "doc", "last")
    lines = docs.select(F.explode(F.split(F.col(text), "\n")).alias("body")).select(F.xxhash64("body").alias("content"), "body")
    roots = clusters(lines, BANDS, ROWS, similarity=similarity)
    sweep(docs.sparkSession)
    # However many documents there are, no text is shuffled to meet its number.
    keyed = row_keyed(docs.select(key, text), key, text)
    found = materialise(units(keyed, text, least=least).join(if_few(heads), "_rk").drop("_rk"))
    grams = found.select("doc", "last", "words", F.explode("grams").alias("u")).select("doc", "last", "words", "u.*")
    rows = found.select("doc", "last", "words", F.explode("lines").alias("u")).select("doc", "last", "words", "u.*")
    ends = [F.min("doc").alias("low"), F.max("last").alias("high")]
    # Most paragraphs are alone; only those that repeat or have a root go on. Minima are aggregated before they are shuffled.
    again = materialise(grams.groupBy("content", "check").agg(*ends).where("low != high").select("content", "check", "low"))
    plain = rows.groupBy("content").agg(*ends).join(if_few(roots), "content", "left")
    named = materialise(plain.where("root IS NOT NULL OR low != high"))
    rooted = materialise(named.where("root IS NOT NULL").groupBy("root").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low != high").select("root", "low"))
    alike = named.drop("low", "high").join(if_few(rooted), "root").select("content", F.col("root").alias("cluster"), "low")
    lined = materialise(named.where("root IS NULL").select("content", F.col("content").alias("cluster"), "low").unionByName(alike))
    sweep(docs.sparkSession)
    ours = ["doc", "words", "w0", "w1", "low"]
    inner = grams.drop("last").join(again.hint("shuffle_hash"), ["content", "check"]).withColumn("w1", F.least(F.col("w0") + gram, "words")).select(F.lit(False).alias("line"), "content", *ours)
    whole = rows.drop("last").join(lined.hint("shuffle_hash"), "content").select(F.lit(True).alias("line"), F.col("cluster").alias("content"), *ours)
    out = materialise(inner.unionByName(whole).groupBy("doc", "words").agg(F.collect_list(F.struct("line", "content", "w0", "w1", "low")).alias("u")))
    forget(found, again, named, rooted, lined)
    sweep(docs.sparkSession)
    return out


def repeats(docs: DataFrame, key: str, text: str, *, similarity: float = SIMILARITY, least: int = LEAST) -> DataFrame:
    """_rk, words (of the document), line, content, w0, w1, keeper (_rk), removed: every repeat of every document."""
    numbers = numbered(docs, key, text)
    found = _asking(members(docs, numbers, key, text, similarity=similarity, least=least), least=least, every=True)
    flat = found.select(F.col("doc").alias("head"), "words", F.explode("u").alias("u")).select("head", "words", "u.*")
    keepers = numbers.select(F.col("doc").alias("low"), F.struct("_rk").alias("keeper"))
    gone = (F.col("removed") | (F.col("doc") != F.col("head"))).alias("removed")
    return flat.join(numbers, "head").join(keepers, "low").select("_rk", "words", "line", "content", "w0", "w1", "keeper", gone)


def _chained(group: np.ndarray, w0: np.ndarray, w1: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by group, w0, w1 and ``more``, and where in it those begin that neither overlap nor touch what is before."""
    order = np.lexsort((*more[::-1], w1, w0, group))
    shift = group[order].astype(np.int64) << 32
    reach = np.maximum.accumulate(w1[order] + shift)
    return order, np.flatnonzero(np.append(True, (w0[order] + shift)[1:] > reach[:-1]))


def _extent(order: np.ndarray, start: np.ndarray, w0: np.ndarray, w1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each member the ends of its chain."""
    low, high = np.empty_like(w0), np.empty_like(w1)
    counts = np.diff(np.append(start, len(order)))
    low[order] = np.repeat(np.minimum.reduceat(w0[order], start), counts)
    high[order] = np.repeat(np.maximum.reduceat(w1[order], start), counts)
    return low, high


def _flat(lists: pa.ListArray, *names: str) -> tuple[np.ndarray, ...]:
    """Whose each member is, and its fields."""
    values = lists.flatten()
    counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return (np.repeat(np.arange(len(lists)), counts), *(values.field(c).to_numpy(zero_copy_only=False) for c in names))


def _asking(found: DataFrame, *, least: int = LEAST, every: bool = False) -> DataFrame:
    """doc, words, u: the repeats, once each, with what they need and whether they are to be removed.

    need: grams beside which words within ``most`` are in no repeat. Lines that cannot be in a passage, as they are short
    and meet nothing else, even if grams grow by all that they need, are left out unless ``every`` repeat is asked for.
    """
    most = sizes(least)[1] - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in taken(batches):
            owner, line, content, w0, w1, low = _flat(batch.column("u"), "line", "content", "w0", "w1", "low")
            order = np.lexsort((w1, w0, content, line, owner))
            owner, line, content, w0, w1, low = (x[order] for x in (owner, line, content, w0, w1, low))
            same = np.append(False, (owner[1:] == owner[:-1]) & (line[1:] == line[:-1]) & (content[1:] == content[:-1]))
            once = ~(same & np.append(False, (w0[1:] == w0[:-1]) & (w1[1:] == w1[:-1])))
            doc = batch.column("doc").to_numpy(zero_copy_only=False)
            removed = same | (low != doc[owner])
            owner, line, content, w0, w1, low, removed = (x[once] for x in (owner, line, content, w0, w1, low, removed))
            end = batch.column("words").to_numpy(zero_copy_only=False)[owner]
            at, to = _extent(*_chained(owner, w0, w1), w0, w1)
            left, right = ~line & (at > 0) & (w0 - most < at), ~line & (to < end) & (w1 + most > to)
            a, b = np.where(left, np.maximum(w0 - most, 0), w0), np.where(right, np.minimum(w1 + most, end), w1)
            order, start = _chained(owner, a, b)
            at, to = _extent(order, start, a, b)
            inner = np.empty(len(order), dtype=bool)
            inner[order] = np.repeat(np.logical_or.reduceat(~line[order], start), np.diff(np.append(start, len(order))))
            kept = every | inner | (to - at >= least) | (to - at == end)
            counts = np.bincount(owner[kept], minlength=batch.num_rows)
            rows = np.flatnonzero(counts)
            fields = {"line": line, "content": content, "w0": w0, "w1": w1, "low": low, "removed": removed, "need_left": left, "need_right": right}
            listed = _structs(counts[rows], **{c: x[kept] for c, x in fields.items()})
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows)) for c in ("doc", "words")), listed], names=["doc", "words", "u"])

    u = "array<struct<line:boolean,content:long,w0:int,w1:int,low:long,removed:boolean,need_left:boolean,need_right:boolean>>"
    return found.mapInArrow(run, f"doc long, words int, u {u}")


def _contexts(asked: DataFrame, most: int) -> DataFrame:
    """more (hashes of a gram with 0, 1, ... ``most`` words more on one side), doc, last, left, needs (w0 of the grams of the
    text that need it): of the sides that ``asked`` (doc, last, text, u) asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in taken(batches):
            for rows, texts in _parts(batch.column("text")):
                of = Texts(texts)
                runs, k = Runs(of.h), np.arange(most + 1)
                fields = ("content", "w0", "w1", "ask_left", "ask_right", "need_left", "need_right")
                owner, content, w0, w1, ask_left, ask_right, need_left, need_right = _flat(batch.column("u").take(pa.array(rows)), *fields)
                asks = np.concatenate([np.flatnonzero(ask_left), len(w0) + np.flatnonzero(ask_right)])
                if not len(asks):
                    continue
                of_left = asks < len(w0)
                gram = asks % len(w0)
                need = np.where(of_left, need_left[gram], need_right[gram])
                owner, first, last, start = owner[gram], of.base[owner[gram]], of.base[owner[gram] + 1], w0[gram]
                to = first + np.where(of_left, w0[gram], w1[gram])
                edge = to[:, None] + np.where(of_left, -1, 1)[:, None] * k
                counts = ((edge >= first[:, None]) & (edge <= last[:, None])).sum(axis=1)
                edge = np.clip(edge, first[:, None], last[:, None])
                own = mix(content[gram].view(np.uint64) * np.uint64(3) + np.where(of_left, np.uint64(1), np.uint64(2)))
                more = mix(runs.of(np.minimum(edge, to[:, None]), np.maximum(edge, to[:, None])) + own[:, None])
                # Repeated grams of one text with equal contexts count once.
                full = more[np.arange(len(more)), counts - 1]
                order = np.lexsort((start, full, more[:, 0], owner))
                new = np.append(True, (np.diff(owner[order]) != 0) | (full[order][1:] != full[order][:-1]) | (more[order, 0][1:] != more[order, 0][:-1]))
                group, once = np.cumsum(new) - 1, order[new]
                wanted = need[order]
                listed = _listed(pa.array(start[order][wanted].astype(np.int32)), np.bincount(group[wanted], minlength=len(once)))
                hashes = _listed(pa.array(more[once][k < counts[once][:, None]].view(np.int64)), counts[once])
                names = [batch.column(c).take(pa.array(rows[owner[once]])) for c in ("doc", "last")]
                yield pa.RecordBatch.from_arrays([hashes, *names, pa.array(of_left[once]), listed], names=["more", "doc", "last", "left", "needs"])

    return asked.select("doc", "last", "text", "u").mapInArrow(run, "more array<bigint>, doc long, last long, left boolean, needs array<int>")


def _growth(asked: DataFrame, most: int) -> DataFrame:
    """doc, grown (w0, left, n): words by which grams grow on a side, where these are fewer than ``most`` and the text has."""
    seen = materialise(_contexts(asked, most))
    whole = materialise(seen.groupBy("more").agg(F.min("doc").alias("low"), F.max("last").alias("high")))
    # Only where some context is in one document alone can it share a part of another one.
    part = materialise(whole.where("low = high").select(F.col("more")[0].alias("gram")).distinct())
    here = whole.join(if_few(part), F.col("more")[0] == F.col("gram"), "left_semi")
    steps = here.select(F.element_at("more", -1).alias("full"), (F.col("low") == F.col("high")).alias("alone"), "low", "high", F.posexplode("more").alias("n", "step"))
    shared = materialise(steps.groupBy("step").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low != high").select("step"))
    lengths = materialise(steps.where("alone").select("full", "n", "step").join(if_few(shared), "step", "left_semi").groupBy("full").agg(F.max("n").alias("n")))
    needs = seen.where(F.size("needs") > 0).select("doc", "left", F.element_at("more", -1).alias("full"), F.explode("needs").alias("w0"))
    out = materialise(needs.join(if_few(lengths), "full").groupBy("doc").agg(F.collect_list(F.struct("w0", "left", "n")).alias("grown")))
    forget(seen, whole, part, shared, lengths)
    return out


def _spans(asked: DataFrame, *, least: int = LEAST) -> DataFrame:
    """doc, start, end, words, low, removed, whole: passages of ``asked`` (doc, last, text, words, u, grown).

    Grams are repeats with the words beside them, too, as far as these repeat. Spans of repeats to keep and to remove are
    told apart after those of fewer than ``least`` words, but for whole documents, have gone. whole: what holds for each
    further document of the same text.
    """
    most = sizes(least)[1] - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in taken(batches):
            for rows, texts in _parts(batch.column("text")):
                of, at = Texts(texts), pa.array(rows)
                total = np.diff(of.base)
                owner, line, w0, w1, low, removed, left, right = _flat(batch.column("u").take(at), "line", "w0", "w1", "low", "removed", "need_left", "need_right")
                less = np.where(left, np.minimum(most, w0), 0)
                more = np.where(right, np.minimum(most, total[owner] - w1), 0)
                whose, grown, of_left, n = _flat(batch.column("grown").take(at), "w0", "left", "n")
                grams = np.flatnonzero(~line)
                key = (owner[grams].astype(np.int64) << 32) + w0[grams]
                order = np.argsort(key)
                hit = grams[order][np.searchsorted(key[order], (whose.astype(np.int64) << 32) + grown)] if len(whose) else grams[:0]
                less[hit[of_left.astype(bool)]] = n[of_left.astype(bool)]
                more[hit[~of_left.astype(bool)]] = n[~of_left.astype(bool)]
                own = np.concatenate([np.arange(len(w0)), np.flatnonzero(less), np.flatnonzero(more)])
                by = np.repeat([0, 1, 2], [len(w0), np.count_nonzero(less), np.count_nonzero(more)])
                owner, low, removed = owner[own], low[own], removed[own]
                w0, w1 = w0[own] - np.where(by == 1, less[own], 0), w1[own] + np.where(by == 2, more[own], 0)
                a, b = _extent(*_chained(owner, w0, w1), w0, w1)
                kept = (b - a >= least) | (b - a == total[owner])
                owner, low, removed, w0, w1 = (x[kept] for x in (owner, low, removed, w0, w1))
                if not len(owner):
                    continue
                order, start = _chained(2 * owner + removed, w0, w1, low)
                a, b = np.minimum.reduceat(w0[order], start), np.maximum.reduceat(w1[order], start)
                whose, keeper, gone = owner[order][start], low[order][start], removed[order][start]
                # All of a text that others equal is a passage; it begins with its first repeat.
                names = [batch.column(c).take(at).to_numpy(zero_copy_only=False) for c in ("doc", "last")]
                order, _ = _chained(owner, w0, w1, low)
                head = np.flatnonzero(np.append(True, np.diff(owner[order]) != 0))
                head = head[(names[0] != names[1])[owner[order][head]]]
                copied = owner[order][head]
                whose, keeper = np.concatenate([whose, copied]), np.concatenate([keeper, low[order][head]])
                gone, whole = np.append(gone, np.ones(len(copied), bool)).astype(bool), np.repeat([False, True], [len(gone), len(copied)])
                a, b = np.append(a, np.zeros(len(copied), a.dtype)), np.append(b, total[copied])
                first, last = of.places(whose, a, b)
                columns = [names[0][whose], *(x.astype(np.int32) for x in (first, last, b - a)), keeper, gone, whole]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["doc", "start", "end", "words", "low", "removed", "whole"])

    return asked.select("doc", "last", "text", "words", "u", "grown").mapInArrow(run, "doc long, start int, end int, words int, low long, removed boolean, whole boolean")


def passages(docs: DataFrame, key: str, text: str, *, similarity: float = SIMILARITY, least: int = LEAST) -> DataFrame:
    """_rk, start, end, words, keeper (_rk of the first repeat in it), removed: repeats that overlap or touch as one span each."""
    most = sizes(least)[1] - 1
    numbers = numbered(docs, key, text)
    found = members(docs, numbers, key, text, similarity=similarity, least=least)
    asking = materialise(_asking(found, least=least))
    texts = row_keyed(docs.select(key, text), key, text).select("_rk", F.col(text).alias("text"))
    few = if_few(numbers)

    def of(rows: DataFrame) -> DataFrame:
        named = rows.join(few.select("_rk", "doc", "last"), "doc")
        return texts.join(if_few(materialise(named.select("_rk"))), "_rk", "left_semi").join(named, "_rk")

    flat = asking.select("doc", F.explode("u").alias("u")).select("doc", "u.content", "u.w0", "u.w1", "u.line", "u.need_left", "u.need_right").where("NOT line")
    asks = materialise(flat.where("need_left OR need_right").groupBy("content").agg(F.max("need_left").alias("ask_left"), F.max("need_right").alias("ask_right")))
    fields = ["content", "w0", "w1", "need_left", "need_right", "ask_left", "ask_right"]
    asked = materialise(flat.join(if_few(asks), "content").groupBy("doc").agg(F.collect_list(F.struct(*fields)).alias("u")))
    grown = _growth(of(asked), most)
    spans = materialise(_spans(of(asking.join(grown, "doc", "left")), least=least).distinct())
    ours = F.col("whole") == (F.col("n.doc") != F.col("n.head"))
    one = spans.withColumnRenamed("doc", "head").join(numbers.alias("n"), "head").where(ours).select("n._rk", "start", "end", "words", "low", "removed")
    keepers = numbers.select(F.col("doc").alias("low"), F.col("_rk").alias("keeper"))
    out = materialise(one.join(keepers, "low").select("_rk", "start", "end", "words", "keeper", "removed"))
    forget(found, asking, asks, asked, grown, spans)
    return out


def query(docs: DataFrame, *, least: int = LEAST) -> DataFrame:
    found = passages(docs, "doc_id", "text", least=least)
    return found.select(F.col("_rk.k").alias("doc_id"), "start", "end", "words", F.col("keeper.k").alias("kept_doc_id"), "removed")
