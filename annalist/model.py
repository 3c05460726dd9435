"""The event model: schemas of its tables, and the store that holds them.

``events`` is the fact table. ``touches`` ties events to entities, ``links`` ties events by a relation
and a target, ``labels`` classifies events. Times are milliseconds since 1970 in UTC; 0 is "no time".
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = """rid LONG, id STRING, source STRING, kind STRING, at_ms LONG, actor STRING, actor_name STRING, title STRING,
    body STRING, level STRING, level_inf STRING, template STRING, simhash LONG, is_bulk BOOLEAN, touches_n INT,
    attrs MAP<STRING, STRING>, dims MAP<STRING, STRING>"""
TOUCHES = "rid LONG, entity STRING, weight LONG, added LONG, deleted LONG, attrs MAP<STRING, STRING>"
ENTITIES = "entity STRING, type STRING, size LONG, deleted BOOLEAN, excluded BOOLEAN"
LINKS = "rid LONG, rel STRING, target STRING"
LABELS = "rid LONG, task STRING, label STRING, confidence DOUBLE, src STRING, evidence STRING"
MARKERS = "source STRING, name STRING, at_ms LONG, ref STRING, kind STRING"
ISSUES = "number LONG, kind STRING, title STRING, state STRING, labels STRING, merged BOOLEAN, closed_at LONG, is_bug BOOLEAN"

#: Types and defaults of the columns of ``events`` that a projection may leave out.
_DEFAULTS = {
    "actor": "CAST(NULL AS STRING)",
    "actor_name": "actor",
    "title": "''",
    "body": "''",
    "level": "''",
    "level_inf": "level",
    "template": "''",
    "simhash": "0L",
    "is_bulk": "false",
    "touches_n": "0",
    "attrs": "CAST(map() AS MAP<STRING, STRING>)",
    "dims": "CAST(map() AS MAP<STRING, STRING>)",
}


def as_events(df: DataFrame) -> DataFrame:
    """``df`` with the columns of ``events``, in order; columns that it lacks get their defaults."""
    for name, default in _DEFAULTS.items():
        if name not in df.columns:
            df = df.withColumn(name, F.expr(default))
    names = [c.split()[0] for c in EVENTS.replace("MAP<STRING, STRING>", "MAP").split(",")]
    return df.select(*names)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


@dataclass(frozen=True)
class Store:
    """The tables of one event history; tables that a history lacks are empty."""

    events: DataFrame
    touches: DataFrame
    entities: DataFrame
    links: DataFrame
    labels: DataFrame
    markers: DataFrame
    issues: DataFrame
    meta: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, events: DataFrame, **tables: DataFrame) -> Store:
        spark = events.sparkSession
        schemas = {"touches": TOUCHES, "entities": ENTITIES, "links": LINKS, "labels": LABELS, "markers": MARKERS, "issues": ISSUES}
        return cls(events, **{k: tables.get(k) if tables.get(k) is not None else empty(spark, v) for k, v in schemas.items()})

    def key_values(self) -> DataFrame:
        """``rid``, ``k``, ``v``: links and declared dims, which relation keys see alike."""
        links = self.links.select("rid", F.col("rel").alias("k"), F.col("target").alias("v"))
        dims = self.events.select("rid", F.explode("dims").alias("k", "v"))
        return links.unionByName(dims)


def iso(ms):
    """``at_ms`` as ISO-8601 in UTC, with milliseconds only if there are any; '' for no time."""
    at = F.timestamp_millis(ms)
    part = F.when(F.pmod(ms, F.lit(1000)) == 0, "").otherwise(F.date_format(at, ".SSS"))
    return F.when(ms == 0, "").otherwise(F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), part, F.lit("Z")))
