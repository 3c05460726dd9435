"""Answers as JSON envelopes and as compact tables."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame

SCHEMA_VERSION = 1
#: Rows that each depth of an answer in words shows, at most; None: all within its limit.
DEPTHS = {"counts": 0, "summary": 5, "full": None}


def answer(df: DataFrame, question: str, limit: int, **window: Any) -> dict[str, Any]:
    """Up to ``limit`` rows with what was asked; ``truncated`` is exact, as one more row is looked for."""
    rows = [r.asDict(recursive=True) for r in df.limit(limit + 1).collect()]
    return {
        "schema_version": SCHEMA_VERSION,
        "question": question,
        "window": {k: v for k, v in window.items() if v},
        "budget": {"max_items": limit, "returned": min(len(rows), limit), "truncated": len(rows) > limit},
        "result": rows[:limit],
    }


def _cell(x: Any) -> str:
    if x is None:
        return ""
    if isinstance(x, float):
        return f"{x:.3f}".rstrip("0").rstrip(".")
    if isinstance(x, (list, dict)):
        return json.dumps(x, ensure_ascii=False, default=str)
    return str(x).replace("\t", " ").replace("\n", " ")


def compact(rows: list[dict[str, Any]]) -> str:
    """Rows as a table of tab-separated values; numbers have three decimals at most."""
    if not rows:
        return ""
    names = list(rows[0])
    return "\n".join(["\t".join(names), *("\t".join(_cell(r[n]) for n in names) for r in rows)])


def _time(ms: int) -> str:
    return datetime.fromtimestamp(ms / 1000, UTC).isoformat(timespec="milliseconds" if ms % 1000 else "seconds").replace("+00:00", "Z")


def told(df: DataFrame, question: str, limit: int, total: int, first_ms: int = 0, last_ms: int = 0, index: str = "", warnings: Sequence[str] = (), depth: str = "full") -> str:
    """An answer as text: a line that says how much there is, from when and whether all is shown; warnings; a table.

    ``depth`` is counts (no rows), summary (five at most) or full (``limit``).
    """
    if depth not in DEPTHS:
        raise ValueError(f"depth is one of {', '.join(DEPTHS)}")
    most = DEPTHS[depth]
    shown = limit if most is None else min(limit, most)
    rows = [r.asDict(recursive=True) for r in df.limit(shown).collect()] if shown else []
    covered = f"{_time(first_ms)}..{_time(last_ms)}" if first_ms > 0 else "-"
    head = f"total={total} coverage={covered} truncated={str(total > limit).lower()}" + (f" index={index}" if index else "") + f" q={question}"
    return "\n".join([head, *(f"⚠ {w}" for w in warnings), *([compact(rows)] if rows else [])])
