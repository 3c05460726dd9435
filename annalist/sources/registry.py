"""Which source reads a path: every source scores the first lines, and the best score wins."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from . import text
from .jsonl import TIME

Detect = Callable[[str, list[str]], int]


def _json(line: str) -> dict | None:
    try:
        value = json.loads(line)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def _jsonl(path: str, lines: list[str]) -> int:
    named = path.endswith((".jsonl", ".ndjson", ".jsonl.gz"))
    if not lines:
        return 20 if named else 0
    first = _json(lines[0])
    if first is None:
        return 0
    return 60 if named and any(k in first for k in TIME) else 40


def _csv(path: str, lines: list[str]) -> int:
    sep = {".csv": ",", ".tsv": "\t"}.get(path[-4:])
    return 60 if sep and lines and lines[0].count(sep) >= 1 else 0


def _text(path: str, lines: list[str]) -> int:
    return 40 if lines and any(re.match(p, lines[0]) for p in (text._NEW, text._OLD, text._ACCESS)) else 0


def _changelog(path: str, lines: list[str]) -> int:
    return 60 if "changelog" in path.lower() and any(re.match(r"## \[?\S", x) for x in lines) else 0


def _nod(path: str, lines: list[str]) -> int:
    first = _json(lines[0]) if lines else None
    return 90 if first and first.get("nod") == 1 and isinstance(first.get("events"), list) else 0


def _delega(path: str, lines: list[str]) -> int:
    return 85 if path.rstrip("/").endswith("/state") or path.endswith("audit.jsonl") else 0


def _git(path: str, lines: list[str]) -> int:
    return 100 if path.rstrip("/").endswith(".git") else 0


def _journal(path: str, lines: list[str]) -> int:
    first = _json(lines[0]) if lines else None
    return 60 if path in ("oslog", "journald", "syslogd") or first and "__REALTIME_TIMESTAMP" in first else 0


#: In the order in which equal scores are settled.
SOURCES: dict[str, Detect] = {
    "git": _git, "jsonl": _jsonl, "csv": _csv, "textlog": _text, "changelog": _changelog, "oslog": _journal, "template": lambda path, lines: 0, "nod": _nod, "dir": lambda path, lines: 1, "delega": _delega,
}


def pick(path: str, lines: list[str]) -> str:
    """Name of the source with the best score for a path and its first lines."""
    return max(SOURCES, key=lambda n: SOURCES[n](path, lines))
