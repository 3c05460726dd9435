"""The filter that all questions share, compiled to column predicates and semi-joins."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, lowered
from ..model import Store

_KEY = re.compile(r"[A-Za-z0-9_.\-]+", re.A)


def checked_key(key: str) -> str:
    """``key`` if it can name an attribute or relation."""
    if not _KEY.fullmatch(key):
        raise ValueError(f"not a key: {key!r}")
    return key


def listed(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def _prefixed(column: Column, wanted: str) -> Column:
    return column.startswith(wanted[:-1]) if wanted.endswith("*") else column == wanted


def attribute(key: str) -> Column:
    """An attribute's value: of the declared dims first, then of the others. Keys are literal."""
    return F.coalesce(F.col("dims")[key], F.col("attrs")[key])


def origin(entities: Column) -> Column:
    """Where an event comes from: its container, pod or host, else the first of its entities, else ''."""
    return F.coalesce(F.col("attrs")["container"], F.col("attrs")["pod"], F.col("attrs")["host"], entities, F.lit(""))


@dataclass(frozen=True)
class Scope:
    """All conditions must hold; those left out don't apply.

    ``since`` (inclusive; 0: no bound, untimed events pass) and ``until`` (exclusive) are milliseconds;
    ``source``, ``kind``, ``level`` and ``entity`` are comma lists, a kind may end in ``*``; ``grep`` is
    a substring of the title, A-Z in either case; ``attr`` holds ``k:v`` or ``k=v``, ``v`` may end in
    ``*``; ``join`` is ``K=v``, ``K=v*``, ``K=@id`` (shares a value of K with that event) or ``K``.
    """

    since: int = 0
    until: int = 0
    source: str = ""
    kind: str = ""
    level: str = ""
    grep: str = ""
    entity: str = ""
    attr: tuple[str, ...] = ()
    join: str = ""
    infer_level: bool = False

    def __post_init__(self) -> None:
        if self.since and self.until and self.since >= self.until:
            raise ValueError("the window is empty: since must come before until")
        for x in self.attr:
            self._split(x)
        if self.join:
            checked_key(self.join.partition("=")[0])

    @staticmethod
    def _split(text: str) -> tuple[str, str]:
        m = re.search("[:=]", text)
        if not m:
            raise ValueError(f"expected key:value, found {text!r}")
        return checked_key(text[: m.start()]), text[m.end() :]

    def level_column(self) -> Column:
        return F.col("level_inf") if self.infer_level else F.col("level")

    def row_condition(self) -> Column:
        """What can be told from the event's own row; it reaches the scan as pushed filters where it can."""
        out = F.lit(True)
        if self.since:
            out &= F.col("at_ms") >= self.since
        if self.until:
            out &= F.col("at_ms") < self.until
        if self.source:
            names = listed(self.source)
            if len(names) == 1 and ":" in names[0]:
                out &= F.col("source").startswith(names[0])
            else:
                out &= F.split_part("source", F.lit(":"), F.lit(1)).isin(names) | F.col("source").isin(names)
        if self.kind:
            some = F.lit(False)
            for x in listed(self.kind):
                some |= _prefixed(F.col("kind"), x)
            out &= some
        if self.level:
            out &= ascii_lower(self.level_column()).isin([lowered(x) for x in listed(self.level)])
        if self.grep:
            out &= ascii_lower(F.col("title")).contains(lowered(self.grep))
        for x in self.attr:
            key, value = self._split(x)
            out &= attribute(key).isNotNull() if value == "*" else _prefixed(attribute(key), value)
        return out

    def apply(self, store: Store, untimed: bool = True) -> DataFrame:
        """The events in scope; those without a time only if ``untimed``."""
        out = store.events.where(self.row_condition())
        if not untimed:
            out = out.where("at_ms > 0")
        if self.entity:
            named = store.touches.where(F.col("entity").isin(listed(self.entity))).select("rid")
            out = out.join(named, "rid", "left_semi")
        if self.join:
            out = out.join(self._joined(store), "rid", "left_semi")
        return out

    def _joined(self, store: Store) -> DataFrame:
        key, equals, value = self.join.partition("=")
        pairs = store.key_values().where(F.col("k") == key)
        if not equals:
            return pairs.select("rid")
        if value.startswith("@"):
            anchor = store.events.where(F.col("id") == value[1:]).select("rid")
            shared = pairs.join(anchor, "rid", "left_semi").select("v").distinct()
            return pairs.join(shared, "v", "left_semi").select("rid")
        return pairs.where(_prefixed(F.col("v"), value)).select("rid")
