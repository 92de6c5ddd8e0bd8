"""Steps that need a file as a whole: comment masking and line diffs, as Arrow batches of files.

A file is one row, so its state never leaves the row and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Per language family, line comments, block comments, and strings (open, carries over lines, has escapes).
_QUOTES = (('"', False, True), ("'", False, True))
_C = (("//",), (("/*", "*/"),), _QUOTES)
_HASH = (("#",), (), _QUOTES)
_MARKUP = ((), (("<!--", "-->"),), _QUOTES)
FAMILIES = {
    **dict.fromkeys(("javascript", "typescript"), (("//",), (("/*", "*/"),), (("`", True, False), *_QUOTES))),
    **dict.fromkeys(("java", "c", "cpp", "csharp", "rust", "swift", "kotlin", "scala", "php", "dart"), _C),
    "go": (("//",), (("/*", "*/"),), (("`", True, False), _QUOTES[0])),
    "python": (("#",), (), (('"""', True, False), ("'''", True, False), *_QUOTES)),
    "ruby": (("#",), (("=begin", "=end"),), _QUOTES),
    **dict.fromkeys(("shell", "bash", "yaml", "toml", "dockerfile", "perl", "r"), _HASH),
    "sql": (("--",), (("/*", "*/"),), (_QUOTES[1],)),
    **dict.fromkeys(("html", "xml", "vue", "markdown"), _MARKUP),
}

#: Line pairs beyond which a quick diff is given up and all lines count as changed.
MOST_CELLS = 4_000_000


@lru_cache(None)
def _marks(language: str) -> re.Pattern:
    """What may open at a place of the text, whole: strings (kept), then comments (group c). Marks that carry run over lines."""
    line_marks, blocks, strings = FAMILIES[language]
    q = re.escape
    kept = [rf"{q(m)}[\s\S]*?(?:{q(m)}|\Z)" if carries else rf"{q(m)}(?:\\[^\n]|[^{q(m)}\\\n])*(?:{q(m)}|\\?)" for m, carries, _ in strings]
    gone = [rf"{q(a)}[\s\S]*?(?:{q(b)}|\Z)" for a, b in blocks] + [rf"{q(m)}[^\n]*" for m in line_marks]
    return re.compile("|".join([*kept, f"(?P<c>{'|'.join(gone)})"]))


def mask_text(text: str | None, language: str | None) -> str | None:
    """Comments as spaces, tabs and line breaks kept; strings stay; unknown languages stay."""
    if text is None or language not in FAMILIES:
        return text
    return _marks(language).sub(lambda m: re.sub(r"[^\t\n]", " ", m[0]) if m["c"] is not None else m[0], text)


def mask(text: Column, language: Column) -> Column:
    @F.pandas_udf("string")
    def of(texts: pd.Series, languages: pd.Series) -> pd.Series:
        return pd.Series([mask_text(t, g) for t, g in zip(texts, languages, strict=True)], dtype=object)

    return of(text, language)


def _ends(a: list[int], b: list[int]) -> Iterator[tuple[int, int]]:
    """For i from 0 on, (row i, row i + 1): bit j of row i tells whether the ends from (i, j) have a longer common part than those from (i, j + 1).

    A row is one long number, so that a step works on all places of a line at once. Every so many rows one is kept, and
    the rows between are made again on the way back: memory is the root of the number of rows, time twice theirs.
    """
    at: dict[int, int] = {}
    top = len(b) - 1
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << (top - j)  # the last place is the lowest bit
    every, full = max(1, isqrt(len(a))), (1 << len(b)) - 1

    def up(row: int, x: int) -> int:
        # the bit-vector step of Hyyro (2004), on the complement of the increments
        open_ = full ^ row
        met = open_ & at.get(x, 0)
        return full ^ (((open_ + met) | (open_ - met)) & full)

    kept, row = {len(a): 0}, 0
    for i in range(len(a) - 1, -1, -1):
        row = up(row, a[i])
        if i % every == 0:
            kept[i] = row
    now = kept[0]
    for low in range(0, len(a), every):
        high = min(low + every, len(a))
        block = [kept[high]]
        for i in range(high - 1, low, -1):
            block.append(up(block[-1], a[i]))
        for row in reversed(block):
            yield now, row
            now = row


def changed_lines(old: str | None, new: str, most_cells: int | None = MOST_CELLS) -> list[int] | None:
    """Lines of ``new`` (from 1) outside the longest common subsequence; null without an old version.

    Where several subsequences are longest, a line of the old side is given up before one of the new side. Beyond
    ``most_cells`` pairs of lines all lines count as changed; None sets no bound.
    """
    if old is None:
        return None
    a, b = old.split("\n"), new.split("\n")
    if most_cells is not None and len(a) * len(b) > most_cells:
        return list(range(1, len(b) + 1))
    number: dict[str, int] = {}
    a, b = ([number.setdefault(x, len(number)) for x in side] for side in (a, b))
    changed, j, top = [], 0, len(b) - 1
    for i, (row, below) in enumerate(_ends(a, b)):
        left = lambda r: (r & ((1 << (len(b) - j)) - 1)).bit_count()  # noqa: B023, E731  common part of the ends from (., j)
        here, there = left(row), left(below)
        while j < len(b) and a[i] != b[j] and here > there:  # only the old line keeps what is common
            changed.append(j + 1)
            here -= row >> (top - j) & 1
            there -= below >> (top - j) & 1
            j += 1
        if j == len(b):
            break
        j += a[i] == b[j]
    return changed + list(range(j + 1, len(b) + 1))


def line_diff(versions: DataFrame, old: str, new: str, most_cells: int | None = MOST_CELLS) -> DataFrame:
    """Add changed (array of lines, null without an old version)."""

    @F.pandas_udf("array<int>")
    def of(olds: pd.Series, news: pd.Series) -> pd.Series:
        return pd.Series([changed_lines(o, n, most_cells) for o, n in zip(olds, news, strict=True)], dtype=object)

    return versions.withColumn("changed", of(F.col(old), F.col(new)))
