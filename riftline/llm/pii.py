"""Personal data: fixed patterns, and identifiers that bootstrapped contexts discover.

Four fixed patterns give the base spans. They are also the seeds of a bootstrap over the graph of lexical
contexts and identifiers: a context is one or two words right before an identifier, or the word right after it.
A context's confidence for a kind is the share of all its places in the corpus where a known identifier of that
kind stands; contexts that are confident and have seen enough different identifiers score the identifier-like
strings that the fixed patterns leave out, and those that pass join the known ones for the next round. A round can
only add to what the one before has found, and rounds go on until one adds nothing. Spark counts, joins and scores;
each text is read once by the patterns and once to count contexts. The words of a context lie within ``REACH``
characters of the identifier, whole; longer ones are no contexts.

Defined cases: a null text is an empty one; documents that share a key but not the text are kept apart, rows
equal in both get equal results; spans count code points, end exclusive; spans of several kinds may overlap; an
empty table gives an empty result; other columns are ignored (``redact`` keeps them).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from riftline.llm.common import materialise, row_keyed, strings, taken
from riftline.llm.decontaminate import lowered, split_words

#: The kinds in their order.
KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
LEAST_IDENTIFIERS, LEAST_CONTEXT, LEAST_IDENTIFIER = 3, 0.5, 0.6
#: Characters on each side of an identifier in which the words of its contexts must lie.
REACH = 80

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AT = re.compile(r" ?[\[(](?:at|AT)[\])] ?")
_NUMBER = re.compile(r"(?<![^\W_])[0-9](?:[ ().\-/]{0,2}+[0-9])++")
_FOUR = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_DIGIT = re.compile(r"[0-9]")
_WORDS = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

SPANS = "array<struct<start:int,kind:int,end:int>>"
PLACES = "array<struct<start:int,kind:int,end:int,known:boolean,name:bigint,contexts:array<string>>>"
_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_PLACE = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("known", pa.bool_()), ("name", pa.int64()), ("contexts", pa.list_(pa.string()))])


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _addresses(text: str, sign: re.Pattern | str) -> Iterator[tuple[int, int]]:
    """Local part, sign, domain: from each sign back over the local part, which cannot hold another sign."""
    last = 0
    for m in re.finditer(sign, text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start() and (d := _DOMAIN.match(text, m.end())):
            yield start, d.end()
            last = d.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all matches of the fixed patterns, in order."""
    found = [(a, EMAIL, b) for a, b in _addresses(text, "@")] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                found.append((m.start(), IP, m.end()))
        for m in _CARD.finditer(text):
            if 14 <= m.end() - m.start() <= 37 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                found.append((m.start(), CARD, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                    found.append((m.start(), PHONE, m.end()))
    return sorted(found)


def _spelt_at(text: str) -> bool:
    return "at)" in text or "at]" in text or "AT)" in text or "AT]" in text


def _unseen(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """Identifier-like strings beside the base spans, with each kind that they could be."""
    spans = [(a, b) for a, _, b in base]
    letter = lambda k: 0 <= k < len(text) and text[k].isalnum()
    free = lambda a, b: not (letter(a - 1) or letter(b) or any(x < b and a < y for x, y in spans))
    if _spelt_at(text):
        yield from ((a, EMAIL, b) for a, b in _addresses(text, _AT) if free(a, b))
    for m in _NUMBER.finditer(text):
        if m.end() - m.start() < 7 or m.end() - m.start() > 60 or not free(*m.span()):
            continue
        n = sum(map(str.isdigit, m[0]))
        if _FOUR.fullmatch(m[0]):
            yield m.start(), IP, m.end()
            continue
        if 7 <= n <= 15:
            yield m.start(), PHONE, m.end()
        if 14 <= n <= 19:
            yield m.start(), CARD, m.end()


def _near(gap: str) -> bool:
    """Only a few separators, on the same line, stand between the word and the identifier."""
    return len(gap) <= 3 and "\n" not in gap


def contexts(text: str, start: int, end: int) -> list[str]:
    """The contexts of a place: l:word, ll:two words, r:word; lower case."""
    before, after = text[max(0, start - REACH) : start], text[end : end + REACH]
    found = []
    words = list(_WORDS.finditer(before))
    if words and _near(before[words[-1].end() :]) and (words[-1].start() > 0 or start <= REACH):
        found.append("l:" + words[-1][0].translate(_LOWER))
        if len(words) > 1 and _near(before[words[-2].end() : words[-1].start()]) and (words[-2].start() > 0 or start <= REACH):
            found.append(f"ll:{words[-2][0].translate(_LOWER)} {words[-1][0].translate(_LOWER)}")
    if (m := _WORDS.search(after)) and _near(after[: m.start()]) and m.end() < REACH:
        found.append("r:" + m[0].translate(_LOWER))
    return found


def scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    """_rk, base (spans) and places (known and unseen identifiers with their contexts) of every row."""
    keyed = row_keyed(docs.select(key, text), key, text).select("_rk", F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in taken(batches):
            bases, places = [], []
            for text in strings(batch.column(1)):
                base = base_spans(text or "")
                bases.append([{"start": a, "kind": k, "end": b} for a, k, b in base])
                both = [(a, k, b, True) for a, k, b in base] + ([(a, k, b, False) for a, k, b in _unseen(text, base)] if text and (len(base) or _DIGIT.search(text) or _spelt_at(text)) else [])
                places.append([{"start": a, "kind": k, "end": b, "known": known, "name": xxh64_intdigest(text[a:b]) - (1 << 63), "contexts": contexts(text, a, b)} for a, k, b, known in both])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bases, pa.list_(_SPAN)), pa.array(places, pa.list_(_PLACE))], names=["_rk", "base", "places"])

    return keyed.mapInArrow(run, f"_rk {keyed.schema['_rk'].dataType.simpleString()}, base {SPANS}, places {PLACES}")


def context_totals(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """context, total: all places in the corpus where a context of ``wanted`` stands."""
    words = F.transform(split_words(F.col(text)), lowered)
    single = docs.select(F.explode(split_words(F.col(text))).alias("w")).select(lowered(F.col("w")).alias("word"))
    ones = wanted.where("context NOT LIKE 'll:%'").select("context", F.substring_index("context", ":", -1).alias("word"))
    by_word = single.join(ones.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("total"))
    pairs = docs.select(words.alias("w")).select(F.explode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))).alias("b"))).alias("p"))
    twos = wanted.where("context LIKE 'll:%'").select("context")
    by_pair = pairs.select(F.concat(F.lit("ll:"), F.col("p.a"), F.lit(" "), F.col("p.b")).alias("context")).join(twos, "context", "left_semi").groupBy("context").agg(F.count(F.lit(1)).alias("total"))
    return ones.join(by_word, "word").select("context", "total").unionByName(by_pair)


def discover(scanned: DataFrame, docs: DataFrame, text: str, *, least_identifiers: int = LEAST_IDENTIFIERS, least_context: float = LEAST_CONTEXT, least_identifier: float = LEAST_IDENTIFIER) -> DataFrame:
    """name, kind, score: identifiers beside the base spans that confident contexts give away."""
    place = scanned.select(F.explode("places").alias("p")).select("p.name", "p.kind", "p.known", F.explode("p.contexts").alias("context"))
    edges = materialise(place.groupBy("context", "name", "kind", "known").agg(F.count(F.lit(1)).alias("n")))
    # A context can matter only if enough different identifiers, one of them unseen, stand in it.
    open_ = edges.groupBy("context", "kind").agg(F.count(F.lit(1)).alias("names"), F.max((~F.col("known")).cast("int")).alias("unseen")).where(F.col("names") > least_identifiers)
    wanted = materialise(open_.where("unseen = 1").select("context").distinct())
    edges = materialise(edges.join(wanted, "context", "left_semi").join(context_totals(docs, text, wanted), "context"))
    seeds = edges.where("known").select("name", "kind", F.lit(1.0).alias("score")).distinct()
    accepted, before, now = materialise(seeds), -1, 0
    while now != before:
        known = edges.join(accepted, ["name", "kind"])
        graded = known.groupBy("context", "kind").agg((F.sum("n") / F.max("total")).alias("share"), F.count_distinct("name").alias("names"))
        good = graded.where((F.col("names") >= least_identifiers) & (F.col("share") >= least_context)).select("context", "kind", F.least("share", F.lit(0.999)).alias("share"))
        scored = edges.where("NOT known").join(good, ["context", "kind"]).groupBy("name", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("share"))))).alias("score"))
        found = scored.where(F.col("score") >= least_identifier)
        accepted = materialise(seeds.unionByName(found))
        before, now = now, accepted.count()
    return materialise(accepted.join(seeds.select("name", "kind"), ["name", "kind"], "left_anti"))


def discovered(docs: DataFrame, key: str, text: str, scanned: DataFrame) -> DataFrame:
    """_rk, found (spans that contexts give away): a row for each row of ``docs`` that has such."""
    names = discover(scanned, docs, text)
    unseen = scanned.select("_rk", F.explode("places").alias("p")).where("NOT p.known").select("_rk", "p.start", "p.kind", "p.end", "p.name")
    return materialise(unseen.join(names, ["name", "kind"]).groupBy("_rk").agg(F.collect_set(F.struct("start", "kind", "end")).alias("found")))


def find(docs: DataFrame, key: str, text: str) -> DataFrame:
    """_rk, base, spans (base and discovered, sorted): one row for each row of ``docs``."""
    scanned = materialise(scan(docs, key, text))
    spans = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("found", F.array().cast(SPANS)))))
    return scanned.join(discovered(docs, key, text, scanned), "_rk", "left").select("_rk", "base", spans.alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` with each span of its text replaced by the kind in brackets; overlapping spans become one.

    Base spans are found in the text once more where it stands, so that only discovered ones are joined to it.
    """

    @F.pandas_udf("string")
    def cut(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, more in zip(texts, found, strict=True):
            spans = sorted({*base_spans(t), *((s["start"], s["kind"], s["end"]) for s in more)}) if t is not None else ()
            if spans:
                parts, at = [], 0
                for start, kind, end in spans:
                    if start >= at:
                        parts += [t[at:start], f"[{KINDS[kind].upper()}]"]
                    at = max(at, end)
                t = "".join(parts) + t[at:]
            out.append(t)
        return pd.Series(out, dtype=object)

    found = discovered(docs, key, text, materialise(scan(docs, key, text).select("_rk", "places")))
    joined = row_keyed(docs, key, text).join(found, "_rk", "left")
    return joined.withColumn(text, cut(F.col(text), F.coalesce("found", F.array().cast(SPANS)))).select(*docs.columns)


def query(docs: DataFrame) -> DataFrame:
    found = find(docs, "doc_id", "text")
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(F.col("_rk.k").alias("doc_id"), *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
