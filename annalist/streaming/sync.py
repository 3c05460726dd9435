"""Many sources kept in step with their files: what changed is read again, and failures stay with their source."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..ingest import ingest
from .ingest import PASSES, History


@dataclass(frozen=True)
class Feed:
    """A source: its name, a folder or pattern of files of lines, and what makes records of their lines."""

    name: str
    path: str
    parse: Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Synced:
    """What a pass over one feed did; ``error`` is empty unless it failed."""

    name: str
    read: int = 0
    gone: int = 0
    error: str = ""


def listing(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``file`` (its URI), ``size``, ``changed`` of the files; their content isn't read."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select("path", F.col("_metadata.file_path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("changed"))


def changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """``file``, ``path``, ``size``, ``changed``, ``state`` (new, changed, gone) of files that aren't as they were."""
    known = before.select("file", F.col("size").alias("size0"), F.col("changed").alias("changed0"))
    same = (F.col("size") == F.col("size0")) & (F.col("changed") == F.col("changed0"))
    state = F.when(F.col("path").isNull(), "gone").when(F.col("size0").isNull(), "new").when(~same, "changed")
    return now.join(known, "file", "full").withColumn("state", state).where("state IS NOT NULL").drop("size0", "changed0")


def _literal(path: str) -> str:
    """``path`` as a pattern that only it matches."""
    return "".join("\\" + c if c in "\\*?[]{}" else c for c in path)


def _records(spark: SparkSession, paths: list[str], parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The records of files, with the attribute ``file``."""
    lines = spark.read.text([_literal(p) for p in paths]).select(F.regexp_replace("value", r"\r$", "").alias("line"), F.col("_metadata.file_path").alias("file"))
    lines = lines.withColumn("place", F.monotonically_increasing_id()).where(F.trim("line") != "")
    named = lines.select("place", F.col("file").alias("__file"))
    others = F.map_filter(F.coalesce("attrs", F.create_map().cast("map<string,string>")), lambda k, v: k != "file")
    return parse(lines).join(named, "place").withColumn("attrs", F.map_concat(others, F.create_map(F.lit("file"), F.col("__file")))).drop("__file")


def _step(history: History, feed: Feed, todo: list[Row]) -> None:
    read = [r["path"] for r in todo if r["state"] != "gone"]
    old = [r["file"] for r in todo if r["state"] != "new"]
    batch = history.next_pass()
    rows = _records(history.spark, read, feed.parse) if read else None
    if old:
        at = F.coalesce(F.col("attrs")["file"], F.col("dims")["file"])
        stale = history.table("events").where(at.isin(old)).select("rid", "id")
        if rows is not None:
            stale = stale.join(ingest(rows, history.options).events.select("id"), "id", "left_anti")
        if not stale.isEmpty():
            history.drop(stale.select("rid"))
    if rows is not None:
        history.append(rows, batch)
    seen = [(feed.name, r["file"], r["state"], r["size"], r["changed"]) for r in todo]
    history.spark.createDataFrame(seen, PASSES).coalesce(1).write.mode("overwrite").parquet(f"{history.path}/passes/batch={batch}")


def sync(history: History, feeds: Iterable[Feed], most: int = 10_000) -> list[Synced]:
    """Bring a history in step with the files of its feeds, ``most`` files at a time.

    Files of the size and time that they had are not read. Others are read whole: events whose ids
    are new are added, and events of such a file whose ids it no longer gives are dropped, so that a
    file that grew, was cut, or was rewritten needs no telling apart, and a last line that was read
    before it was complete goes when it is. A file that is gone takes its events with it (an id that
    several files give belongs to the first that was read). Files count as seen when their events
    are stored: after a loss the same step runs again, with the number that it had. A feed that
    fails leaves the others alone. Only one writer may hold the history.
    """
    out = []
    with history.locked():
        for feed in feeds:
            read = gone = 0
            try:
                now = listing(history.spark, feed.path)
                while todo := changes(now, history.files(feed.name)).orderBy("file").limit(most).collect():
                    _step(history, feed, todo)
                    gone += sum(r["state"] == "gone" for r in todo)
                    read += sum(r["state"] != "gone" for r in todo)
                out.append(Synced(feed.name, read, gone))
            except Exception as e:  # noqa: BLE001  whatever a source throws is its own
                out.append(Synced(feed.name, read, gone, f"{type(e).__name__}: {e}"[:500]))
    return out
