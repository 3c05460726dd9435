"""Episodes of anchor events, what precedes them, and how much more often than by chance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import severity
from ..model import Store
from .scope import Scope, checked_key, origin

TWO_MINUTES, MINUTE = 120_000, 60_000


def with_origin(store: Store, events: DataFrame) -> DataFrame:
    """``events`` with ``origin``."""
    first = store.touches.groupBy("rid").agg(F.min("entity").alias("__first"))
    return events.join(first, "rid", "left").withColumn("origin", origin(F.col("__first"))).drop("__first")


def episodes(store: Store, scope: Scope, gap: int = TWO_MINUTES, by_origin: bool = False, key: str = "") -> DataFrame:
    """Timed anchors that follow one another within ``gap`` ms are one episode.

    Episodes are global, of each origin, or of each value of relation ``key``. Columns: ``grp``,
    ``start_ms``, ``end_ms``, ``anchors``, ``first_id``, ``origins``.
    """
    anchors = with_origin(store, scope.apply(store, untimed=False)).select("rid", "id", "at_ms", "origin")
    if key:
        pairs = store.key_values().where(F.col("k") == checked_key(key)).select("rid", F.col("v").alias("grp")).distinct()
        anchors = anchors.join(pairs, "rid")
    else:
        anchors = anchors.withColumn("grp", F.col("origin") if by_origin else F.lit(""))
    if by_origin or key:
        return _sessions(anchors, ["grp"], gap)
    return _merged(anchors, gap)


def _sessions(anchors: DataFrame, keys: list[str], gap: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("at_ms", "id")
    fresh = F.coalesce((F.col("at_ms") - F.lag("at_ms").over(order) > gap).cast("int"), F.lit(1))
    numbered = anchors.withColumn("fresh", fresh).withColumn("n", F.sum("fresh").over(order))
    return numbered.groupBy(*keys, "n").agg(
        F.min("at_ms").alias("start_ms"),
        F.max("at_ms").alias("end_ms"),
        F.count("*").alias("anchors"),
        F.min(F.struct("at_ms", "id")).getField("id").alias("first_id"),
        F.array_sort(F.collect_set("origin")).alias("origins"),
    ).drop("n")


def _merged(anchors: DataFrame, gap: int) -> DataFrame:
    """Global episodes without one task over all anchors: sessions of each slab of time, then joined.

    A slab is 1000 gaps long; the sessions of a slab are few rows, and only these meet in one window.
    """
    slab = F.floor(F.col("at_ms") / (1000 * max(gap, 1)))
    parts = _sessions(anchors.withColumn("slab", slab), ["slab", "grp"], gap).drop("slab")
    order = Window.partitionBy("grp").orderBy("start_ms", "first_id")
    fresh = F.coalesce((F.col("start_ms") - F.lag("end_ms").over(order) > gap).cast("int"), F.lit(1))
    numbered = parts.withColumn("fresh", fresh).withColumn("n", F.sum("fresh").over(order))
    return numbered.groupBy("grp", "n").agg(
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        F.sum("anchors").alias("anchors"),
        F.min_by("first_id", F.struct("start_ms", "first_id")).alias("first_id"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("origins")))).alias("origins"),
    ).drop("n")


def in_windows(events: DataFrame, spans: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Events inside spans ``[lo, hi)`` with equal ``keys``: a range join on slabs of ``width`` ms.

    A span is filed under every slab that it overlaps, an event under its own, so rows meet by an
    equi-join; each pair meets once.
    """
    filed = spans.withColumn("slab", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    placed = events.withColumn("slab", F.floor(F.col("at_ms") / width))
    return placed.join(filed, [*keys, "slab"]).where("at_ms >= lo AND at_ms < hi").drop("slab")


def precursors(store: Store, scope: Scope, gap: int = TWO_MINUTES, window: int = TWO_MINUTES, by_origin: bool = False, key: str = "", within: Scope = Scope()) -> DataFrame:
    """What came in the ``window`` ms before each episode, by level, template and origin.

    Columns: ``grp``, ``start_ms``, ``first_id``, ``level``, ``template``, ``origin``, ``count``,
    ``last_ms``, ``example_id`` (latest). Events under a second before the episode, from one of its
    origins, are part of it and left out.
    """
    found = episodes(store, scope, gap, by_origin, key).select("grp", "start_ms", "first_id", "origins")
    spans = found.withColumn("lo", F.col("start_ms") - window).withColumn("hi", F.col("start_ms"))
    events = with_origin(store, within.apply(store, untimed=False)).select("rid", "id", "at_ms", F.upper("level").alias("level"), "template", "origin")
    keys: list[str] = []
    if key:
        pairs = store.key_values().where(F.col("k") == key).select("rid", F.col("v").alias("grp")).distinct()
        events, keys = events.join(pairs, "rid"), ["grp"]
    met = in_windows(events, spans, keys, window)
    met = met.where(~((F.col("start_ms") - F.col("at_ms") < 1000) & F.array_contains("origins", F.col("origin"))))
    return met.groupBy("grp", "start_ms", "first_id", "level", "template", "origin").agg(
        F.count("*").alias("count"), F.max("at_ms").alias("last_ms"), F.max_by("id", F.struct("at_ms", "id")).alias("example_id")
    )


def cover(starts: DataFrame, keys: list[str], length: int, lo: int, hi: int) -> DataFrame:
    """Length of the union of ``[at, at + length)`` within ``[lo, hi)``, by ``keys``.

    ``starts`` has distinct ``at``. Between neighbours in time a start adds its length, or the way to
    the next start if that is shorter, so the union needs no intervals to be merged.
    """
    following = F.lead("at").over(Window.partitionBy(*keys).orderBy("at"))
    end = F.least(F.col("at") + length, F.coalesce(following, F.lit(hi)), F.lit(hi))
    return starts.withColumn("part", F.greatest(F.lit(0), end - F.greatest("at", F.lit(lo)))).groupBy(*keys).agg(F.sum("part").alias("covered"))


def common_precursors(store: Store, scope: Scope, gap: int = TWO_MINUTES, window: int = TWO_MINUTES, within: Scope = Scope(), limit: int | None = 10) -> DataFrame:
    """Templates that precede at least two episodes (or the only one), with lift over their base rate.

    A template's base rate is the share of the time, while its sources are active, that lies within
    ``window`` of a minute with the template. Columns: ``level``, ``template``, ``episodes``,
    ``active_episodes``, ``base_rate``, ``expected``, ``lift``; by episodes over the expected ones.
    """
    starts = episodes(store, scope, gap).select("start_ms", "first_id")
    met = precursors(store, scope, gap, window, within=within)
    counts = met.select("start_ms", "first_id", "level", "template").distinct().groupBy("level", "template").agg(F.count("*").alias("episodes"))
    number = starts.agg(F.count("*").alias("all"))
    counts = counts.join(F.broadcast(number), (F.col("episodes") >= 2) | (F.col("all") == 1)).drop("all")  # one row

    events = within.apply(store, untimed=False)
    lo, hi = events.agg(F.min("at_ms"), F.max("at_ms") + 1).first()
    if lo is None:
        return counts.selectExpr("level", "template", "episodes", "0L AS active_episodes", "0D AS base_rate", "0D AS expected", "CAST(NULL AS DOUBLE) AS lift")
    minute = (F.col("at_ms") - F.pmod("at_ms", F.lit(MINUTE))).alias("at")
    named = events.join(counts.select("template").distinct(), "template", "left_semi")
    of_template = named.select("template", minute).distinct()
    emitting = named.select("template", "source").distinct()
    busy = events.select("source", minute).distinct()
    active = emitting.join(busy, "source").select("template", "at").distinct()
    rate = (
        cover(active, ["template"], MINUTE + window, lo, hi)
        .withColumnRenamed("covered", "active")
        .join(cover(of_template, ["template"], MINUTE + window, lo, hi), "template")
        .select("template", F.least(F.lit(1.0), F.col("covered") / F.col("active")).alias("base_rate"))
    )
    # an episode counts as active for a template if its start lies in the template's active cover
    spans = active.select("template", F.col("at").alias("lo"), (F.col("at") + MINUTE + window).alias("hi"))
    hit = in_windows(starts.select(F.col("start_ms").alias("at_ms"), "first_id"), spans, [], window)
    alive = hit.select("template", "at_ms", "first_id").distinct().groupBy("template").agg(F.count("*").alias("active_episodes"))
    out = (
        counts.join(rate, "template")
        .join(alive, "template", "left")
        .withColumn("active_episodes", F.coalesce("active_episodes", F.lit(0)))
        .withColumn("expected", F.col("base_rate") * F.col("active_episodes"))
        .withColumn("lift", F.try_divide(F.try_divide(F.col("episodes"), F.col("active_episodes")), F.col("base_rate")))
        .select("level", "template", "episodes", "active_episodes", "base_rate", "expected", "lift")
    )
    if not limit:
        return out
    return out.orderBy(F.desc(F.col("episodes") - F.col("expected")), F.desc("episodes"), severity(F.col("level")), "template", "level").limit(limit)
