"""Questions across sources: near in time, sharing a key, missing a counterpart, linked step by step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Store
from .scope import Scope, _prefixed, checked_key, listed

HOUR = 3_600_000


def correlate(store: Store, event_id: str, delta: int = HOUR, kinds: str = "", limit: int | None = 25) -> DataFrame:
    """Events of other sources within ``delta`` ms of an event, bounds included, nearest first.

    An event without a time has no neighbours in time.
    """
    anchor = store.events.where((F.col("id") == event_id) & (F.col("at_ms") > 0)).select(F.col("at_ms").alias("t0"), F.col("source").alias("s0"))
    near = store.events.where("at_ms > 0")
    if kinds:
        some = F.lit(False)
        for x in listed(kinds):
            some |= _prefixed(F.col("kind"), x)
        near = near.where(some)
    # one anchor: its row is broadcast and the events are scanned once
    found = near.join(F.broadcast(anchor.limit(1)), (F.col("at_ms") >= F.col("t0") - delta) & (F.col("at_ms") <= F.col("t0") + delta) & (F.col("source") != F.col("s0")))
    out = found.select("id", "source", "kind", "at_ms", "level", "title", (F.col("at_ms") - F.col("t0")).alias("delta_ms"))
    return out.orderBy(F.abs("delta_ms"), "at_ms", "id").limit(limit) if limit else out


def sharing(store: Store, event_id: str, key: str) -> DataFrame:
    """All other events that share a value of relation ``key`` with an event."""
    pairs = store.key_values().where(F.col("k") == checked_key(key)).select("rid", "v")
    anchor = store.events.where(F.col("id") == event_id).select("rid")
    shared = pairs.join(anchor, "rid", "left_semi").select("v").distinct()
    rids = pairs.join(shared, "v", "left_semi").select("rid").distinct().join(anchor, "rid", "left_anti")
    return store.events.join(rids, "rid", "left_semi")


def correlate_via(store: Store, event_id: str, key: str, limit: int | None = 25) -> DataFrame:
    """A sample of ``sharing``, oldest first."""
    out = sharing(store, event_id, key).select("id", "source", "kind", "at_ms", "level", "title")
    return out.orderBy("at_ms", "id").limit(limit) if limit else out


def via_totals(store: Store, event_id: str, key: str) -> DataFrame:
    """Numbers of ``sharing``: by source, and by kind and level, in one pass."""
    return (
        sharing(store, event_id, key)
        .groupingSets([[F.col("source")], [F.col("kind"), F.col("level")]], "source", "kind", "level")
        .agg(F.count("*").alias("count"))
        .select("source", "kind", "level", "count")
    )


# --- units without a counterpart -----------------------------------------------------------------


def _sides(store: Store, first: Scope, then: Scope, key: str, by: str) -> tuple[DataFrame, DataFrame]:
    """From-side rows ``unit``, ``v``, ``rid``, ``at_ms``, and to-side rows ``v``, ``at_ms``."""
    pairs = store.key_values()
    values = pairs.where(F.col("k") == checked_key(key)).select("rid", "v")
    came = first.apply(store).select("rid", "at_ms").join(values, "rid")
    if by:
        units = pairs.where(F.col("k") == checked_key(by)).select("rid", F.col("v").alias("unit"))
        came = came.join(units, "rid")
    else:
        came = came.withColumn("unit", F.col("v"))
    return came, then.apply(store).select("rid", "at_ms").join(values, "rid").select("v", "at_ms")


def _covered(came: DataFrame, met: DataFrame, any_order: bool) -> DataFrame:
    """Units of which a value has a to-side event, no earlier than the value's first timed from-side one."""
    first = came.where("at_ms > 0").groupBy("unit").agg(F.min("at_ms").alias("since"))
    last = met.groupBy("v").agg(F.max("at_ms").alias("last"))
    pairs = came.select("unit", "v").distinct().join(last, "v")
    if any_order:
        return pairs.select("unit").distinct()
    return pairs.join(first, "unit").where("last >= since").select("unit").distinct()


def gap_units(store: Store, first: Scope, then: Scope, key: str, by: str = "", any_order: bool = False) -> DataFrame:
    """Every unit of the from side: ``unit``, ``events``, ``first_ms``, ``last_ms``, ``state``.

    A unit is a value of ``key``, or of ``by``. ``state`` is ``covered``, ``missing``, or ``no_time``
    where the order can't be told.
    """
    came, met = _sides(store, first, then, key, by)
    timed = F.when(F.col("at_ms") > 0, F.col("at_ms"))
    units = came.groupBy("unit").agg(F.count_distinct("rid").alias("events"), F.min(timed).alias("first_ms"), F.max(timed).alias("last_ms"))
    covered = _covered(came, met, any_order).withColumn("covered", F.lit(True))
    state = F.when(F.col("covered"), "covered").when(F.col("first_ms").isNull() & F.lit(not any_order), "no_time").otherwise("missing")
    return units.join(covered, "unit", "left").withColumn("state", state).drop("covered")


def gaps(store: Store, first: Scope, then: Scope, key: str, by: str = "", any_order: bool = False) -> DataFrame:
    """One row of counts: ``units``, ``covered``, ``missing``, ``units_without_time``, ``to_values``, ``from_without_key``."""
    came, met = _sides(store, first, then, key, by)
    state = gap_units(store, first, then, key, by, any_order)
    is_ = lambda x: F.count(F.when(F.col("state") == x, 1))
    counts = state.agg(F.count("*").alias("units"), is_("covered").alias("covered"), is_("missing").alias("missing"), is_("no_time").alias("units_without_time"))
    values = met.agg(F.count_distinct("v").alias("to_values"))
    without = first.apply(store).select("rid").join(came.select("rid"), "rid", "left_anti").agg(F.count("*").alias("from_without_key"))
    return counts.crossJoin(values).crossJoin(without)  # one row each


def gap_sample(store: Store, first: Scope, then: Scope, key: str, by: str = "", any_order: bool = False, limit: int = 25) -> DataFrame:
    """Missing units, latest first."""
    missing = gap_units(store, first, then, key, by, any_order).where("state = 'missing'").drop("state")
    return missing.orderBy(F.desc_nulls_last("last_ms"), "unit").limit(limit)


# --- links, step by step -------------------------------------------------------------------------


def edges(store: Store, frontier: DataFrame) -> DataFrame:
    """``rid``, ``rel``: neighbours of the events of ``frontier`` (``rid``) over links, with the relation.

    Neighbours share a relation and target; or one's target is the other's id; or, for ``commit``, a
    prefix of at least four hex digits that no other id has.
    """
    events = store.events.select("rid", "id")
    mine = store.links.join(frontier.select("rid"), "rid", "left_semi")
    ids = events.join(frontier.select("rid"), "rid", "left_semi")
    shared = store.links.join(mine.select("rel", "target").distinct(), ["rel", "target"], "left_semi").select("rid", F.concat_ws(":", "rel", "target").alias("rel"))
    out = events.join(mine.select(F.col("target").alias("id"), "rel").distinct(), "id").select("rid", "rel")
    into = store.links.join(ids.select(F.col("id").alias("target")), "target", "left_semi").select("rid", "rel")
    found = shared.unionByName(out).unionByName(into)
    return found.unionByName(_by_prefix(store, mine, ids))


def _by_prefix(store: Store, mine: DataFrame, ids: DataFrame) -> DataFrame:
    short = (F.col("rel") == "commit") & F.col("target").rlike("^[0-9a-f]{4,39}$")
    commits = store.events.select("rid", "id", F.left("id", F.lit(4)).alias("p"))
    named = store.links.where(short).select("rid", "target", F.left("target", F.lit(4)).alias("p"))
    ends = named.select("target", "p").distinct().join(commits, "p").where(F.col("id").startswith(F.col("target"))).groupBy("target").agg(F.min("rid").alias("to"), F.count("*").alias("n")).where("n = 1")
    pairs = named.select("rid", "target").join(ends.select("target", "to"), "target")
    forth = pairs.join(mine.select("rid").distinct(), "rid", "left_semi").select(F.col("to").alias("rid"))
    back = pairs.join(ids.select(F.col("rid").alias("to")), "to", "left_semi").select("rid")
    return forth.union(back).withColumn("rel", F.lit("commit"))


def trace(store: Store, event_id: str, depth: int = 5, limit: int = 50) -> DataFrame:
    """``id``, ``depth``, ``rel``, ``at_ms``: events reached over links, breadth first.

    Of several relations that reach an event at its depth, the first by name; each level is taken in
    the order of time and id until ``limit`` events are found. At most ``limit`` rows are held.
    """
    spark = store.events.sparkSession
    level = [(r["rid"], r["at_ms"], r["id"]) for r in store.events.where(F.col("id") == event_id).select("rid", "at_ms", "id").limit(1).collect()]
    seen = {r[0] for r in level}
    out: list[tuple[str, int, str, int]] = []
    for k in range(1, depth + 1):
        room = limit - len(out)
        if not level or not room:
            break
        frontier = spark.createDataFrame([(r[0],) for r in level], "rid long")
        found = edges(store, F.broadcast(frontier)).where(~F.col("rid").isin(list(seen))).groupBy("rid").agg(F.min("rel").alias("rel"))
        rows = store.events.join(found, "rid").select("rid", "at_ms", "id", "rel").orderBy("at_ms", "id").limit(room).collect()  # at most limit rows
        level = [(r["rid"], r["at_ms"], r["id"]) for r in rows]
        seen |= {r[0] for r in level}
        out += [(r["id"], k, r["rel"], r["at_ms"]) for r in rows]
    return spark.createDataFrame(out, "id string, depth int, rel string, at_ms long")
