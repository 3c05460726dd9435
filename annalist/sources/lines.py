"""Reading lines, and the parts that sources of lines share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ingest import RECORD

NO_LINKS = "array<struct<rel:string,target:string>>"
TOUCHES = "array<struct<entity:string,type:string,weight:bigint,added:bigint,deleted:bigint>>"


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``line``, ``file``, ``place``: non-blank lines of text files, gzipped ones too.

    ``place`` grows with the lines of a file and names each line of a read once.
    """
    rows = spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("line"), F.col("_metadata.file_name").alias("file"))
    return rows.withColumn("place", F.monotonically_increasing_id()).where(F.trim("line") != "")


def line_id(line: Column, *more: Column) -> Column:
    """A stable id of a line: a hash of it and of what else tells it from others."""
    return F.lower(F.hex(F.xxhash64(line, *more)))


def touch(entity: Column, kind: str) -> Column:
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    return F.array(F.struct(entity.alias("entity"), F.lit(kind).alias("type"), one.alias("weight"), none.alias("added"), none.alias("deleted")))


def records(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    """``df`` as records; columns that aren't given are empty."""
    empty = F.lit("")
    defaults = {
        "id": line_id(F.col("line")), "source": F.lit(source), "kind": F.lit("log"), "at_ms": F.lit(0), "actor": F.lit(None), "actor_name": columns.get("actor", F.lit(None)),
        "title": empty, "body": empty, "level": empty, "attrs": F.create_map(), "touches": F.array(), "links": F.array(), "place": F.col("place"),
    }
    types = {"at_ms": "bigint", "attrs": "map<string,string>", "touches": TOUCHES, "links": NO_LINKS, "place": "bigint"}
    names = ["id", "source", "kind", "at_ms", "actor", "actor_name", "title", "body", "level", "attrs", "touches", "links", "place"]
    assert all(n in RECORD for n in names)
    whole = defaults | columns
    return df.select(*(F.coalesce(whole[n], F.lit(0)).cast("bigint").alias(n) if n == "at_ms" else whole[n].cast(types.get(n, "string")).alias(n) for n in names))
