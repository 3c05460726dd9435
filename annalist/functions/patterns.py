"""Patterns that users write: a small, linear-time subset of regular expressions; and globs."""

from __future__ import annotations

import re
from collections.abc import Iterable

_ATOM = re.compile(r"\\[dws]|\\[^\w]|\[\^?\]?(?:\\.|[^\]\\])*\]|\.|[^\\\[\](){}*+?^$|.]", re.A | re.S)
_COUNT = re.compile(r"[*+?]|\{\d+(?:,\d*)?\}", re.A)
#: Digits, word characters and blanks are those of ASCII.
_CLASSES = {"\\d": "[0-9]", "\\w": "[A-Za-z0-9_]", "\\s": "[ \\t\\r\\n\\f\\x0B]"}


def java_regex(pattern: str) -> str:
    """``pattern`` as a regular expression for Spark; ``ValueError`` if it isn't in the subset.

    Literals, ``.``, classes, ``\\d \\w \\s``, escapes of punctuation, ``* + ? {n} {n,} {n,m}``, ``^`` at the
    start, ``$`` at the end, and one group that isn't repeated.
    """
    at, out, groups, open_ = 0, [], 0, False
    if pattern.startswith("^"):
        out.append("^")
        at = 1
    while at < len(pattern):
        c = pattern[at]
        if c == "$" and at == len(pattern) - 1:
            out.append("$")
            break
        if c == "(" and not groups:
            groups, open_ = 1, True
            out.append("(")
            at += 1
            continue
        if c == ")" and open_:
            open_ = False
            out.append(")")
            at += 1
            continue
        m = _ATOM.match(pattern, at)
        if not m:
            raise ValueError(f"pattern {pattern!r}: can't use {pattern[at:]!r}")
        out.append(_CLASSES.get(m[0], m[0]))
        at = m.end()
        if n := _COUNT.match(pattern, at):
            out.append(n[0])
            at = n.end()
    if open_:
        raise ValueError(f"pattern {pattern!r}: the group isn't closed")
    return "".join(out)


def glob_regex(glob: str) -> str:
    """A path glob as an anchored regular expression: ``**`` crosses folders, ``*`` and ``?`` don't."""
    out = []
    for part in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", glob):
        out.append({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or re.escape(part))
    return "^" + "".join(out) + "$"


def excluded(path, globs: Iterable[str]):  # noqa: ANN001, ANN201
    """Whether a path column matches a glob: by name, as a whole, or, for ``dir/*``, in any folder of that name."""
    from pyspark.sql import functions as F

    out = F.lit(False)
    for g in globs:
        out |= path.rlike(glob_regex(g))
        if "/" not in g:
            out |= F.element_at(F.split(path, "/"), -1).rlike(glob_regex(g))
        elif g.endswith("/*"):
            out |= path.rlike("(^|/)" + glob_regex(g[:-2])[1:-1] + "/")
    return out
