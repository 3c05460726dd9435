"""Materialised counts by bucket, and answers from them that equal those of the events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import bucket
from ..model import Store
from ..operators.counting import top
from ..operators.scope import Scope

WIDTH = 600_000
DIMS = ["source", "kind", "level", "level_inf", "template", "entity"]
SCHEMA = ", ".join(f"{d} STRING" for d in DIMS) + ", bucket LONG, count LONG, last_rid LONG"


def facts(store: Store) -> DataFrame:
    """Events with their only entity ('' if none); events with several aren't counted by entity."""
    single = store.touches.groupBy("rid").agg(F.min("entity").alias("entity"), F.count("*").alias("n"))
    return store.events.join(single, "rid", "left").withColumn("entity", F.when(F.col("n") == 1, F.col("entity")).otherwise(""))


def build(store: Store, width: int = WIDTH, by: tuple[str, ...] = ()) -> DataFrame:
    """``DIMS``, ``bucket``, ``count``, ``last_rid``, and columns of events in ``by``; untimed events are in bucket 0."""
    at = F.when(F.col("at_ms") > 0, bucket(F.col("at_ms"), width)).otherwise(0)
    return facts(store).groupBy(*by, *DIMS, at.alias("bucket")).agg(F.count("*").alias("count"), F.max("rid").alias("last_rid"))


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rollups of two sets of events together."""
    return summed(old.unionByName(new))


def summed(parts: DataFrame) -> DataFrame:
    """Rollups of all the events that ``parts`` are rollups of."""
    return parts.groupBy(*DIMS, "bucket").agg(F.sum("count").alias("count"), F.max("last_rid").alias("last_rid"))


def answers(scope: Scope, dim: str, width: int = WIDTH) -> bool:
    """Whether the rollups can answer ``top`` exactly: no condition on anything that they lack, whole buckets."""
    plain = not (scope.grep or scope.attr or scope.join or scope.entity)
    return plain and dim in ("level", "kind", "template") and scope.since % width == 0 and scope.until % width == 0


def top_from(rollups: DataFrame, store: Store, dim: str, scope: Scope = Scope(), limit: int = 25, width: int = WIDTH) -> DataFrame:
    """``counting.top`` from the rollups where they can answer and are fresh, else from the events."""
    newest = lambda df, c: df.agg(F.max(c)).first()[0]
    if not answers(scope, dim, width) or newest(rollups, "last_rid") != newest(store.events, "rid"):
        return top(store, dim, scope, limit)
    column = scope.level_column() if dim == "level" else F.col(dim)
    # a whole bucket lies in the window if its start does; conditions name the column of events
    rows = rollups.withColumnRenamed("bucket", "at_ms").where(scope.row_condition()).where(column != "")
    return rows.groupBy(column.alias("value")).agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "value").limit(limit)
