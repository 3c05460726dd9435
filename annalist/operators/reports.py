"""Composite reports: one over logs, one over an entity of code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Store
from . import code, counting, episodes
from .scope import Scope

WORST = "FATAL,CRITICAL,ERROR"


def _section(name: str, df: DataFrame, what: str, count: str) -> DataFrame:
    return df.select(F.lit(name).alias("section"), F.col(what).cast("string").alias("what"), F.col(count).cast("double").alias("count"))


def log_report(store: Store, scope: Scope = Scope(), gap: int = 120_000) -> DataFrame:
    """``section``, ``what``, ``count``: coverage, levels, worst services and messages, peaks, episodes, what precedes them."""
    bad = Scope(since=scope.since, until=scope.until, source=scope.source, level=WORST)
    parts = [
        _section("source", counting.coverage(store, scope), "source", "events"),
        _section("level", counting.top(store, "level", scope, 12), "value", "count"),
        _section("peak", counting.peaks(store, scope=bad, limit=5), "bucket", "count"),
        _section("template", counting.patterns(store, bad, 5), "template", "count"),
        _section("entity", counting.top(store, "entity", bad, 10), "value", "count"),
        _section("episode", episodes.episodes(store, bad, gap).orderBy(F.desc("anchors"), "start_ms").limit(24), "first_id", "anchors"),
        _section("common", episodes.common_precursors(store, bad, gap, gap, within=scope), "template", "episodes"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def code_report(store: Store, entity: str) -> DataFrame:
    """``section``, ``what``, ``count``: owners of an entity, what changes with it, and its place among hotspots."""
    place = code.hotspots(store, limit=1000).withColumn("rank", F.expr("row_number() OVER (ORDER BY score DESC, entity)")).where(F.col("entity") == entity)
    return (
        _section("owner", code.owners(store, entity), "actor", "changes")
        .unionByName(_section("with", code.coupling(store, entity), "entity", "support"))
        .unionByName(_section("rank", place, "entity", "rank"))
    )
