"""Scalar expressions on paths, code and verdicts; all of them built-in Spark functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riftline.functions.patterns import WHITE, to_java
from riftline.functions.rules import LANGUAGES, MANIFESTS

TIERS = ("green", "yellow", "orange")

#: What marks a credential as a known key, as a reference, or as a placeholder.
KNOWN_KEY = r"AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{40,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_\-]{35}|sk_live_[0-9a-zA-Z]{16,}|-----BEGIN"
REFERENCE = r"(?i)\$\{|process\.env|import\.meta\.env|os\.environ|getenv"
PLACEHOLDER = r"(?:change[_-]?me|change[_-]?this|password|passwd|pwd|secret|token|apikey|api[_-]?key|example(?:key)?|sample|test(?:ing)?|dummy|fake|placeholder|redacted|none|null|undefined|todo|foo(?:bar)?|xxx+|your[_-].*|my[_-].*|<.*>|\.{3,}|\*{3,})"
QUOTED = r"""["']([^"'\n]{6,})["']"""
#: Paths of tests and of migrations.
TEST_DIR = r"(?i)(?:^|/)(?:tests?|__tests__|__mocks__|specs?|fixtures?|testdata|e2e|mocks?)/"
TEST_FILE = r"(?i)(?:[._-](?:test|spec)\.[a-z0-9]+|_(?:test|spec)\.[a-z0-9]+|^test_[^/]*\.[a-z0-9]+|Tests?\.(?:java|kt|cs|scala|swift))\z"
MIGRATION = r"(?i)(?:^|[/\\])migrations?[/\\]|(?i)\.migration\.[a-z]+\z"


def is_pinned(rows: DataFrame) -> Column:
    """The column ``pinned`` of ``rows``, false where it is null or not there."""
    return F.coalesce("pinned", F.lit(False)) if "pinned" in rows.columns else F.lit(False)


def trim_white(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, rf"\A[{WHITE}]+|[{WHITE}]+\z", "")


def code_hash(code: Column) -> Column:
    return F.substring(F.sha1(trim_white(code)), 1, 16)


def finding_key(rule: Column, code: Column) -> Column:
    return F.concat_ws(":", rule, code_hash(code))


def fingerprint(file: Column, rule: Column, code: Column) -> Column:
    return F.sha1(F.concat_ws("\u0001", file.cast("string"), rule, trim_white(code)))


def basename(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def language(path: Column) -> Column:
    base = F.lower(basename(path))
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.when(base == "dockerfile", "dockerfile").otherwise(F.coalesce(known[F.regexp_extract(base, r"[^.](\.[^.]+)\z", 1)], F.lit("unknown")))


def is_test_path(path: Column) -> Column:
    norm = F.replace(path, F.lit("\\"), F.lit("/"))
    return norm.rlike(TEST_DIR) | (basename(path) == "conftest.py") | basename(path).rlike(TEST_FILE)


def is_migration(path: Column) -> Column:
    return path.rlike(MIGRATION)


def is_manifest(path: Column) -> Column:
    return F.lower(basename(path)).isin(*MANIFESTS)


def tier_rank(tier: Column) -> Column:
    return F.when(tier == "orange", 2).when(tier == "yellow", 1).otherwise(0)


def tier_name(rank: Column) -> Column:
    return F.when(rank == 2, "orange").when(rank == 1, "yellow").otherwise("green")


def entropy(c: Column) -> Column:
    """Bits a character; 0 for the empty string."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    size = F.size(chars).cast("double")

    def share(x: Column) -> Column:
        return F.size(F.filter(chars, lambda y: y == x)) / size

    return -F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, x: acc + share(x) * F.log2(share(x)))


def is_secret(match: Column) -> Column:
    """Whether a credential match is real: no reference, placeholder or short constant of low entropy."""
    quoted = F.regexp_extract(match, QUOTED, 1)
    value = trim_white(F.when(quoted != "", quoted).otherwise(match))
    weak = (F.length(value) < 12) & (entropy(value) < 3)
    return match.rlike(KNOWN_KEY) | ~(match.rlike(REFERENCE) | value.rlike(rf"(?i)\A{PLACEHOLDER}\z") | weak)


def bare_symbol(symbol: Column) -> Column:
    """The last name of a qualified one."""
    last = F.element_at(F.split(symbol, r"[.#]|::"), -1)
    return F.when(last == "", symbol).otherwise(last)


def first_sentence(c: Column) -> Column:
    found = F.regexp_extract(c, r"\A([\s\S]*?[.!?])(?:\s|\z)", 1)
    return F.when(found == "", c).otherwise(found)


def shorten(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def escape_annotation(c: Column) -> Column:
    for a, b in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), (",", "%2C"), (":", "%3A")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def reply_code(c: Column) -> Column:
    """Code of a reply: its fenced blocks, or all of it, without reasoning traces."""
    plain = F.regexp_replace(c, r"(?s)<think>.*?</think>", "")
    blocks = F.regexp_extract_all(plain, F.lit(r"(?s)```[A-Za-z0-9_+-]*\n(.*?)```"), F.lit(1))
    return F.when(F.size(blocks) > 0, F.array_join(blocks, "\n")).otherwise(plain)


def capped_tier(severity: Column, cap: str) -> Column:
    """Tier of a severity word (error, info, any other), no higher than ``cap``."""
    wanted = F.when(severity == "error", 2).when(severity == "info", 0).otherwise(1)
    return tier_name(F.least(wanted, F.lit(TIERS.index(cap))))


def json_list(text: Column, element: str = "map<string,string>") -> Column:
    """The JSON array from the first [ to the last ] of a text; empty where there is none or it cannot be read."""
    start, end = F.locate("[", text), F.length(text) - F.locate("]", F.reverse(text)) + 1
    body = F.when((start > 0) & text.contains("]") & (end > start), F.substring(text, start, end - start + 1))
    return F.coalesce(F.from_json(body, f"array<{element}>"), F.array().cast(f"array<{element}>"))


def verdict_class(text: Column) -> Column:
    """confirmed-risk, likely-safe or needs-human: of the verdict line, or the first of these words that is anywhere."""
    named = F.lower(F.regexp_extract(text, r"(?i)(?:\*\*Verdict:\*\*|Verdict:)\s*\*?\*?\s*(confirmed-risk|likely-safe|needs-human)", 1))
    low = F.lower(text)
    anywhere = F.when(low.contains("confirmed-risk"), "confirmed-risk").when(low.contains("likely-safe"), "likely-safe").otherwise("needs-human")
    return F.when(F.coalesce(named, F.lit("")) != "", named).otherwise(anywhere)


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, within 0 and 1; (0, 0) for n = 0."""
    m = F.greatest(n, F.lit(1)).cast("double")
    p = hits / m
    middle, spread = p + z * z / (2 * m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    low, high = (middle - spread) / (1 + z * z / m), (middle + spread) / (1 + z * z / m)
    return F.when(n <= 0, 0.0).otherwise(F.greatest(low, F.lit(0.0))), F.when(n <= 0, 0.0).otherwise(F.least(high, F.lit(1.0)))


__all__ = [k for k in dir() if not k.startswith("_") and k != "to_java"]


#: Pieces of JSON: strings, brackets that open and that close, and anything else. A quote that nothing closes is a piece, too.
_PIECES = r"""\"(?:[^\"\\]|\\[\s\S])*+\"|[\[{]|[\]}]|[^\"\[\]{}]+|\""""

#: A text that is one JSON value without brackets.
_SCALAR = r"""\A(?:true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*\")\z"""


def loose_json(text: Column) -> Column:
    """The JSON value in a text that may have other text around it, as text: the whole, else the first object or list that opens.

    Such a value ends where its brackets are even, so that one pass finds the only place where it can. Null if there is none.
    """
    whole = trim_white(text)
    pieces = F.regexp_extract_all(F.regexp_extract(whole, r"(?s)[\[{].*", 0), F.lit(_PIECES), F.lit(0))
    step = lambda s, p: F.when(s["depth"] == 0, s).otherwise(
        F.struct(F.concat(s["done"], F.array(p)).alias("done"), (s["depth"] + F.when(p.isin("{", "["), 1).when(p.isin("}", "]"), -1).otherwise(0)).alias("depth"))
    )
    start = F.struct(F.array(F.get(pieces, F.lit(0))).alias("done"), F.lit(1).alias("depth"))
    inner = F.aggregate(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), start, step, lambda s: F.when(s["depth"] == 0, F.array_join(s["done"], "")))
    inner = F.when(F.size(pieces) > 0, inner)
    return F.when(whole.rlike(_SCALAR), whole).when(F.try_parse_json(inner).isNotNull(), inner)
