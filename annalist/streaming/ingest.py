"""Incremental ingest and tailing on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..ingest import Options, ingest
from ..model import EVENTS, LINKS, TOUCHES, Store
from ..operators import search
from ..operators.scope import Scope
from ..plans import rollups

#: Files that were dealt with, by the pass that did so.
PASSES = "feed STRING, file STRING, state STRING, size LONG, changed TIMESTAMP"
_SCHEMAS = {"events": EVENTS, "touches": TOUCHES, "links": LINKS, "postings": search.POSTINGS, "lengths": search.LENGTHS, "rollups": rollups.SCHEMA, "passes": PASSES}
#: Batches of different streams have numbers so far apart; those of passes over files come after all.
_APART, _PASS = 1 << 40, 1 << 60


def line_stream(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """``line`` and ``file`` of files that land in a folder; each file is read once."""
    rows = spark.readStream.option("maxFilesPerTrigger", files).text(path)
    return rows.select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("file"))


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


class History:
    """A history that grows batch by batch: Parquet tables under one folder."""

    def __init__(self, spark: SparkSession, path: str, options: Options = Options()):
        self.spark, self.path, self.options = spark, path.rstrip("/"), options

    def table(self, name: str) -> DataFrame:
        here = f"{self.path}/{name}"
        if not self._exists(here) and self._exists(f"{here}.new/_SUCCESS"):
            here = f"{here}.new"  # a rewrite that was cut short between two renames
        return _table(self.spark, here, f"{_SCHEMAS[name]}, batch LONG")

    def store(self) -> Store:
        """The history as it stands."""
        return Store.of(self.table("events"), touches=self.table("touches"), links=self.table("links"))

    def rollups(self) -> DataFrame:
        """Counts by bucket: the sums of those that each batch wrote."""
        return rollups.summed(self.table("rollups"))

    def search(self, query: list[str], limit: int | None = 25) -> DataFrame:
        """``search.ranked`` over the stored postings."""
        return search.ranked(self.table("postings"), self.table("lengths"), query, limit)

    def files(self, feed: str) -> DataFrame:
        """``file``, ``size``, ``changed`` of the files of a feed as they were last seen."""
        last = self.table("passes").where(F.col("feed") == feed).groupBy("file").agg(F.max_by(F.struct("state", "size", "changed"), "batch").alias("x"))
        return last.select("file", "x.*").where("state <> 'gone'").drop("state")

    def next_pass(self) -> int:
        """The number of the next pass over files; one that was not completed has its number again."""
        done = self.table("passes").agg(F.max("batch")).first()[0]
        return _PASS if done is None else done + 1

    @contextmanager
    def locked(self) -> Iterator[None]:
        """Hold the history as its only writer; a lock that a lost driver left is removed by hand (``_lock``)."""
        fs, lock = self._at(f"{self.path}/_lock")
        if not fs.createNewFile(lock):
            raise RuntimeError(f"{self.path} has a writer")
        try:
            yield
        finally:
            fs.delete(lock, False)

    def _at(self, path: str):  # noqa: ANN202
        sc = self.spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(sc._jsc.hadoopConfiguration()), at

    def _exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def append(self, records: DataFrame, batch: int) -> None:
        """Add the records whose ids are new. A batch that is replayed replaces what it wrote before.

        Every batch writes folders of its own number, so a lost driver leaves nothing half-counted:
        the batch runs again and overwrites them.
        """
        self._settle()
        before = self.table("events").where(F.col("batch") != batch)
        base = before.agg(F.max("rid")).first()[0] or 0
        fresh = ingest(records, self.options, base)
        new = fresh.events.join(before.select("id"), "id", "left_anti")
        folder = lambda name: f"{self.path}/{name}/batch={batch}"
        new.write.mode("overwrite").parquet(folder("events"))
        events = self.spark.read.schema(EVENTS).parquet(folder("events"))
        kept = events.select("rid")
        fresh.touches.join(kept, "rid", "left_semi").write.mode("overwrite").parquet(folder("touches"))
        fresh.links.join(kept, "rid", "left_semi").write.mode("overwrite").parquet(folder("links"))
        texts = events.select("rid", F.concat_ws(" ", "title", "body").alias("text"))
        search.postings(texts).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder("postings"))
        search.lengths(texts).write.mode("overwrite").parquet(folder("lengths"))
        made = Store.of(events, touches=self.spark.read.schema(TOUCHES).parquet(folder("touches")))
        rollups.build(made).write.mode("overwrite").parquet(folder("rollups"))

    def follow(self, lines: DataFrame, parse: Callable[[DataFrame], DataFrame], checkpoint: str, once: bool = True, feed: int = 0) -> StreamingQuery:
        """Ingest a stream of lines; with ``once``, what is there now, and then stop.

        Streams of one history have a ``feed`` each (below 2^20), so that none writes over another's batches.
        """

        def batch(rows: DataFrame, number: int) -> None:
            self.append(parse(rows.withColumn("place", F.monotonically_increasing_id())), feed * _APART + number)

        writer = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()

    def remove(self, source: str) -> None:
        """Drop the events of a source whose files were rewritten; it can then be ingested anew."""
        self.drop(self.table("events").where(F.col("source") == source).select("rid"))

    def drop(self, gone: DataFrame) -> None:
        """Take the events with the ``rid`` of ``gone`` out of every table; the events themselves come last, so it can run again."""
        self._settle()
        gone.write.mode("overwrite").parquet(f"{self.path}/_gone")
        gone = self.spark.read.schema("rid LONG").parquet(f"{self.path}/_gone")
        for name in ("touches", "links", "postings", "lengths"):
            self._rewrite(name, self.table(name).join(gone, "rid", "left_anti"), *(["bucket"] if name == "postings" else []))
        rows = self.table("events").join(gone, "rid", "left_anti")
        self._rewrite("rollups", rollups.build(Store.of(rows, touches=self.table("touches")), by=("batch",)))
        self._rewrite("events", rows)

    def _rewrite(self, name: str, rows: DataFrame, *by: str) -> None:
        rows.write.mode("overwrite").partitionBy("batch", *by).parquet(f"{self.path}/{name}.new")
        self._settle(name)

    def _settle(self, *names: str) -> None:
        """Put rewritten tables in the place of the old ones; with no names, whatever a lost driver left."""
        for name in names or _SCHEMAS:
            here = f"{self.path}/{name}"
            if self._exists(f"{here}.new/_SUCCESS"):
                fs, table = self._at(here)
                old, new = self._at(f"{here}.old")[1], self._at(f"{here}.new")[1]
                if fs.exists(table):
                    fs.delete(old, True)
                    fs.rename(table, old)
                fs.rename(new, table)
                fs.delete(old, True)


def tail(events: DataFrame, scope: Scope, show: Callable[[list], None], checkpoint: str, most: int = 1000) -> StreamingQuery:
    """Hand new events in scope to ``show``, each batch in the order of time, at most ``most`` of them.

    ``events`` is a stream of rows of the event model.
    """

    def batch(rows: DataFrame, number: int) -> None:
        show(rows.where(scope.row_condition()).orderBy("at_ms", "id").limit(most).collect())

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str, late: str = "1 day") -> DataFrame:
    """Counts by kind and window of event time; rows later than ``late`` are no longer counted."""
    timed = events.withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width).getField("start").alias("bucket"), "kind").agg(F.count("*").alias("count"))
