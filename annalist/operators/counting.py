"""Counts of events: most frequent values, timelines, message templates, numeric distributions, streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower
from ..functions.times import bucket
from ..model import Store
from .scope import Scope, attribute, checked_key

HOUR, TEN_MINUTES = 3_600_000, 600_000
#: Numbers as attributes spell them; words such as "nan", and suffixes, are not numbers.
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _first(df: DataFrame, limit: int | None, *order: Column) -> DataFrame:
    """The first rows of a total order; all rows, in no order, without a limit."""
    return df.orderBy(*order).limit(limit) if limit else df


def _values(store: Store, scope: Scope, dim: str) -> DataFrame:
    """``rid`` and ``value`` of a dimension: level, kind, actor, entity, ``attr:<key>`` or a declared key."""
    events = scope.apply(store)
    if dim == "level":
        return events.select("rid", scope.level_column().alias("value"))
    if dim == "kind":
        return events.select("rid", F.col("kind").alias("value"))
    if dim == "actor":
        return events.select("rid", F.coalesce("actor_name", "actor").alias("value"))
    if dim == "entity":
        return events.select("rid").join(store.touches.select("rid", F.col("entity").alias("value")), "rid")
    key = checked_key(dim.removeprefix("attr:"))
    return events.select("rid", attribute(key).alias("value"))


def top(store: Store, dim: str, scope: Scope = Scope(), limit: int | None = 25) -> DataFrame:
    """``value``, ``count``: the most frequent values, ties in their order. Null and '' aren't values."""
    counts = _values(store, scope, dim).where("value <> ''").groupBy("value").agg(F.count("*").alias("count"))
    return _first(counts, limit, F.desc("count"), F.col("value"))


def top_with_rest(store: Store, dim: str, scope: Scope = Scope(), limit: int = 25) -> DataFrame:
    """``top`` and two more rows: events of all other values, and events without a value."""
    every = _values(store, scope, dim).select(F.when(F.col("value") != "", F.col("value")).alias("value"))
    counts = every.groupBy("value").agg(F.count("*").alias("count"))
    best = _first(counts.where("value IS NOT NULL"), limit, F.desc("count"), F.col("value"))
    rest = counts.where("value IS NOT NULL").agg(F.sum("count").alias("n")).crossJoin(best.agg(F.sum("count").alias("m")))  # one row each
    named = best.unionByName(rest.select(F.lit("(rest)").alias("value"), (F.col("n") - F.col("m")).alias("count")))
    return named.unionByName(counts.where("value IS NULL").select(F.lit("(no value)").alias("value"), "count")).where("count > 0")


def top_by_level(store: Store, dim: str, scope: Scope = Scope(), limit: int = 10) -> DataFrame:
    """``level``, ``value``, ``count``: the most frequent values of each level, in one pass."""
    levels = scope.apply(store).select("rid", scope.level_column().alias("level"))
    counts = _values(store, scope, dim).where("value <> ''").join(levels, "rid").groupBy("level", "value").agg(F.count("*").alias("count"))
    place = F.row_number().over(Window.partitionBy("level").orderBy(F.desc("count"), "value"))
    return counts.withColumn("place", place).where(F.col("place") <= limit).drop("place")


def timeline(store: Store, width: int = HOUR, by: str = "", scope: Scope = Scope(), limit: int | None = 500) -> DataFrame:
    """``bucket``, ``key``, ``count`` of timed events, oldest first; ``by`` is '', ``level`` or ``kind``."""
    if by not in ("", "level", "kind"):
        raise ValueError("a timeline is by level or kind")
    key = F.lit("") if not by else scope.level_column() if by == "level" else F.col("kind")
    counts = scope.apply(store, untimed=False).groupBy(bucket(F.col("at_ms"), width).alias("bucket"), key.alias("key")).agg(F.count("*").alias("count"))
    return _first(counts, limit, F.col("bucket"), F.col("key"))


def peaks(store: Store, width: int = TEN_MINUTES, scope: Scope = Scope(), limit: int = 3) -> DataFrame:
    """The buckets with most events, ties to the earlier."""
    return _first(timeline(store, width, "", scope, None).select("bucket", "count"), limit, F.desc("count"), F.col("bucket"))


def patterns(store: Store, scope: Scope = Scope(), limit: int | None = 25) -> DataFrame:
    """``template``, ``count`` and ``example_id`` (last inserted): the most frequent message templates."""
    counts = scope.apply(store).where("template <> ''").groupBy("template").agg(F.count("*").alias("count"), F.max_by("id", "rid").alias("example_id"))
    return _first(counts, limit, F.desc("count"), F.col("template"))


def stats(store: Store, key: str, by: str = "", scope: Scope = Scope(), limit: int | None = 25) -> DataFrame:
    """Distribution of a numeric attribute: ``group``, ``n``, ``min``, ``p50``, ``p95``, ``max``, ``sum``.

    ``by`` is '', ``level``, ``kind``, ``entity`` (the first of an event) or ``attr:<key>``. Percentiles
    are the nearest rank; values that aren't finite numbers don't count.
    """
    events = scope.apply(store)
    text = attribute(checked_key(key))
    number = F.when(text.rlike(_NUMBER), F.expr("try_cast(trim(__text) AS DOUBLE)"))
    rows = events.withColumn("__text", text).withColumn("x", number).where("x IS NOT NULL AND abs(x) < double('Infinity')")
    if by == "entity":
        first = store.touches.groupBy("rid").agg(F.min("entity").alias("group"))
        rows = rows.join(first, "rid", "left").withColumn("group", F.coalesce("group", F.lit("")))
    else:
        group = {"": F.lit(""), "level": scope.level_column(), "kind": F.col("kind")}.get(by)
        rows = rows.withColumn("group", F.coalesce(attribute(checked_key(by.removeprefix("attr:"))), F.lit("")) if group is None else group)
    out = rows.groupBy("group").agg(
        F.count("*").alias("n"),
        F.min("x").alias("min"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY x)").alias("p50"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY x)").alias("p95"),
        F.max("x").alias("max"),
        F.sum("x").alias("sum"),
    )
    return _first(out, limit, F.desc("sum"), F.col("group"))


def events(store: Store, scope: Scope = Scope(), descending: bool = False, limit: int = 100) -> DataFrame:
    """Timed events in the order of time, then id."""
    rows = scope.apply(store, untimed=False).select("id", "source", "kind", "at_ms", "level", "title")
    return _first(rows, limit, *([F.desc("at_ms"), F.desc("id")] if descending else [F.col("at_ms"), F.col("id")]))


def count_events(store: Store, scope: Scope = Scope()) -> DataFrame:
    """Number of timed events in scope."""
    return scope.apply(store, untimed=False).agg(F.count("*").alias("total"))


def coverage(store: Store, scope: Scope = Scope()) -> DataFrame:
    """First and last time of each source in scope, and how many events it has, with and without a time."""
    timed = F.when(F.col("at_ms") > 0, F.col("at_ms"))
    return scope.apply(store).groupBy("source").agg(
        F.count(timed).alias("events"), (F.count("*") - F.count(timed)).alias("untimed"), F.min(timed).alias("first_ms"), F.max(timed).alias("last_ms")
    )


def sources(store: Store) -> DataFrame:
    """``source``, ``what``, ``value``, ``count``: per source its commonest levels, kinds and entities.

    At most 10 levels (as given and as inferred), 5 kinds and 15 entities of each source.
    """
    facts = store.events.select(
        "source",
        F.explode(
            F.array(
                F.struct(F.lit("level").alias("what"), F.col("level").alias("value")),
                F.struct(F.lit("level_inf").alias("what"), F.col("level_inf").alias("value")),
                F.struct(F.lit("kind").alias("what"), F.col("kind").alias("value")),
            )
        ).alias("x"),
    ).select("source", "x.what", "x.value")
    touched = store.touches.select("rid", "entity").join(store.events.select("rid", "source"), "rid").select("source", F.lit("entity").alias("what"), F.col("entity").alias("value"))
    counts = facts.unionByName(touched).where("value <> ''").groupBy("source", "what", "value").agg(F.count("*").alias("count"))
    place = F.row_number().over(Window.partitionBy("source", "what").orderBy(F.desc("count"), "value"))
    most = F.expr("CASE what WHEN 'kind' THEN 5 WHEN 'entity' THEN 15 ELSE 10 END")
    return counts.withColumn("place", place).where(F.col("place") <= most).drop("place")


# --- checks behind hints -------------------------------------------------------------------------


def attr_keys(store: Store) -> DataFrame:
    """Every attribute key, declared or not, with the number of events that have it."""
    keys = store.events.select(F.explode(F.array_union(F.map_keys("attrs"), F.map_keys("dims"))).alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("events"))


def unknown_levels(store: Store, levels: list[str]) -> DataFrame:
    """Those of ``levels`` that no event has."""
    asked = store.events.sparkSession.createDataFrame([(x.upper(),) for x in levels], "level string").distinct()
    return asked.join(store.events.select(F.upper("level").alias("level")).distinct(), "level", "left_anti")


def relation_keys(store: Store) -> DataFrame:
    """Relation keys with the number of events and of distinct values that each has."""
    return store.key_values().groupBy(F.col("k").alias("key")).agg(F.count_distinct("rid").alias("events"), F.count_distinct("v").alias("values"))


def event_relation_keys(store: Store, event_id: str) -> DataFrame:
    """Relation keys and values of one event."""
    one = store.events.where(F.col("id") == event_id).select("rid")
    return store.key_values().join(one, "rid", "left_semi").select("k", "v").distinct()


def untimed_events(store: Store, scope: Scope = Scope()) -> DataFrame:
    """Events in scope that have no time, by source."""
    return scope.apply(store).where("at_ms <= 0").groupBy("source").agg(F.count("*").alias("untimed"))


def other_timed_sources(store: Store, event_id: str) -> DataFrame:
    """``sources``: how many sources have timed events beside that of an event; no row without the event."""
    own = store.events.where(F.col("id") == event_id).orderBy("rid").limit(1).select(F.col("source").alias("own"))
    timed = store.events.where("at_ms > 0").select("source").distinct()
    met = own.join(timed, timed["source"] != own["own"], "left")  # one row against the names of sources
    return met.groupBy("own").agg(F.count("source").alias("sources")).select("sources")


def index_hash(store: Store) -> DataFrame:
    """``hash``: eight hex digits that change if an event comes or goes, or a source's last time moves."""
    parts = store.events.groupBy("source").agg(F.count("*").alias("n"), F.max("rid").alias("last"), F.max("at_ms").alias("upto"))
    state = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "source", "n", "last", "upto"))), ",")
    return parts.agg(F.left(F.md5(state.cast("binary")), F.lit(8)).alias("hash"))


def show(store: Store, prefix: str) -> DataFrame:
    """``field``, ``value`` of the first event by id whose id starts with ``prefix``: its columns, entities, links and attributes."""
    one = store.events.where(F.col("id").startswith(prefix)).orderBy("id").limit(1)
    fields = ["id", "source", "kind", "at_ms", "actor", "title", "body", "level", "template"]
    own = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields))).alias("x")).select("x.*")
    named = [one.select(F.explode(c).alias("k", "value")).select(F.concat(F.lit("attr:"), "k").alias("field"), "value") for c in ("attrs", "dims")]
    touched = store.touches.join(one.select("rid"), "rid", "left_semi").select(F.lit("entity").alias("field"), F.col("entity").alias("value"))
    linked = store.links.join(one.select("rid"), "rid", "left_semi").select(F.concat(F.lit("link:"), "rel").alias("field"), F.col("target").alias("value"))
    labelled = store.labels.join(one.select("rid"), "rid", "left_semi").select(F.concat(F.lit("label:"), "task").alias("field"), F.col("label").alias("value"))
    return reduce(DataFrame.unionByName, [own, *named, touched, linked, labelled]).where("value IS NOT NULL AND value <> ''")


def sources_of_kind(store: Store, kind: str) -> DataFrame:
    """Sources that have events of ``kind``."""
    return store.events.where(F.col("kind") == kind).groupBy("source").agg(F.count("*").alias("events"))


def closest(values: DataFrame, word: str, most: int = 2, limit: int = 3) -> DataFrame:
    """``value``, ``distance``: what ``word`` may have been meant to be, at most ``most`` edits away, A-Z in either case."""
    distance = F.levenshtein(ascii_lower(F.col("value")), ascii_lower(F.lit(word)), most)
    return values.select("value").distinct().withColumn("distance", distance).where("distance >= 0").orderBy("distance", "value").limit(limit)
