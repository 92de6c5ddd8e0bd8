"""Regular expressions with ASCII word borders on a Unicode-aware engine."""

from __future__ import annotations

import re

#: What counts as white space in the pattern language of the rules.
WHITE = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_BORDER = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def to_java(pattern: str, ignore_case: bool = False) -> str:
    """``pattern`` for Spark: ASCII ``\\b``, Unicode ``\\s``, ``$`` at the very end only."""
    out, inside, k = [], False, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            two = pattern[k : k + 2]
            out.append({r"\b": two if inside else _BORDER, r"\s": WHITE if inside else f"[{WHITE}]", r"\S": f"[^{WHITE}]" if not inside else two}.get(two, two))
            k += 2
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "]" and inside:
            inside = False
        out.append(r"\z" if c == "$" and not inside else c)
        k += 1
    return ("(?i)" if ignore_case else "") + "".join(out)


def glob_to_regex(glob: str) -> str:
    """``**`` crosses folders, ``*`` does not, ``?`` is any character; anchored on both sides."""
    out, k = [], 0
    while k < len(glob):
        if glob.startswith("**/", k):
            out.append("(?:.*/)?")
            k += 3
        elif glob.startswith("**", k):
            out.append(".*")
            k += 2
        else:
            out.append({"*": "[^/]*", "?": "."}.get(glob[k], re.escape(glob[k])))
            k += 1
    return r"\A" + "".join(out) + r"\z"
