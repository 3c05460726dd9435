"""Projection of the driver's tables to the event model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Store, as_events

#: Events with more touches than this are bulk changes.
BULK = 10


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ms(column: str):
    """A timestamp without zone as milliseconds, rounded down."""
    return F.floor(F.unix_micros(F.col(column).cast("timestamp")) / 1000).cast("long")


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as log events: kind is the type, the entity is the user, ``k`` is a declared dim."""
    e = read(spark, sf_dir, "events")
    title = F.concat_ws(" ", "event_type", F.lit("value"), F.floor("value").cast("string"))
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARN").otherwise("INFO")
    rows = e.select(
        F.col("event_id").alias("rid"),
        F.concat(F.lit("ev:"), F.col("event_id").cast("string")).alias("id"),
        F.lit("events").alias("source"),
        F.col("event_type").alias("kind"),
        ms("ts").alias("at_ms"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("actor"),
        title.alias("title"),
        level.alias("level"),
        # the variable part of these titles is one number
        F.concat_ws(" ", "event_type", F.lit("value"), F.lit("<NUM>")).alias("template"),
        F.lit(1).alias("touches_n"),
        F.create_map(F.lit("value"), F.col("value").cast("string")).alias("attrs"),
        F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("dims"),
        F.col("user_id").alias("user_id"),
    )
    return rows


def log_store(spark: SparkSession, sf_dir: str) -> Store:
    """The log events, their users as entities, and a link of each event to its user."""
    rows = log_events(spark, sf_dir)
    user = F.col("user_id").cast("string")
    touches = rows.select("rid", F.concat(F.lit("user/"), user).alias("entity"), F.lit(1).cast("long").alias("weight"), F.lit(0).cast("long").alias("added"), F.lit(0).cast("long").alias("deleted"), F.create_map().cast("map<string,string>").alias("attrs"))
    links = rows.select("rid", F.lit("user").alias("rel"), user.alias("target"))
    entities = touches.select("entity").distinct().select("entity", F.lit("row-source").alias("type"), F.lit(0).cast("long").alias("size"), F.lit(False).alias("deleted"), F.lit(False).alias("excluded"))
    return Store.of(as_events(rows.drop("user_id")), touches=touches, links=links, entities=entities)


def order_store(spark: SparkSession, sf_dir: str) -> Store:
    """``orders`` as changes: the lines are touches of parts, returned ones deletions, and make a fix."""
    orders, lines, parts = (read(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    named = parts.select("p_partkey", F.concat_ws("/", "p_brand", F.lit("part"), F.col("p_partkey").cast("string")).alias("entity"), "p_size")
    returned = F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0)
    # an order may have several lines of one part: they are one touch
    summed = lines.groupBy(F.col("l_orderkey").alias("rid"), "l_partkey").agg(F.sum("l_quantity").cast("long").alias("added"), F.sum(returned).cast("long").alias("deleted"))
    touches = summed.join(named, summed["l_partkey"] == named["p_partkey"]).select(
        "rid", "entity", (F.col("added") + F.col("deleted")).alias("weight"), "added", "deleted", F.create_map().cast("map<string,string>").alias("attrs")
    )
    counts = summed.groupBy("rid").agg(F.count("*").cast("int").alias("touches_n"))
    rows = orders.select(
        F.col("o_orderkey").alias("rid"),
        F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("id"),
        F.lit("orders").alias("source"),
        F.lit("order").alias("kind"),
        ms("o_orderdate").alias("at_ms"),
        F.concat(F.lit("customer-"), F.col("o_custkey").cast("string")).alias("actor"),
        F.concat(F.lit("order status "), F.col("o_orderstatus")).alias("title"),
        F.col("o_orderpriority").alias("level"),
        F.concat(F.lit("order status "), F.col("o_orderstatus")).alias("template"),
        F.create_map(F.lit("total"), F.col("o_totalprice").cast("string")).alias("attrs"),
    )
    rows = rows.join(counts, "rid", "left").withColumn("touches_n", F.coalesce("touches_n", F.lit(0))).withColumn("is_bulk", F.col("touches_n") > BULK)
    supp = lines.select(F.col("l_orderkey").alias("rid"), F.lit("supp").alias("rel"), F.col("l_suppkey").cast("string").alias("target")).distinct()
    cust = orders.select(F.col("o_orderkey").alias("rid"), F.lit("cust").alias("rel"), F.col("o_custkey").cast("string").alias("target"))
    fixes = summed.where("deleted > 0").select("rid").distinct()
    labels = fixes.select("rid", F.lit("is_fix").alias("task"), F.lit("true").alias("label"), F.lit(1.0).alias("confidence"), F.lit("rules").alias("src"), F.lit("").alias("evidence"))
    kinds = orders.select(F.col("o_orderkey").alias("rid"), F.lit("bug_category").alias("task"), F.lower(F.col("o_orderstatus")).alias("label"), F.lit(0.7).alias("confidence"), F.lit("rules").alias("src"), F.lit("").alias("evidence"))
    entities = named.select("entity", F.lit("file").alias("type"), F.col("p_size").cast("long").alias("size"), F.lit(False).alias("deleted"), F.lit(False).alias("excluded"))
    return Store.of(as_events(rows), touches=touches, links=cust.unionByName(supp), labels=labels.unionByName(kinds), entities=entities)


def chat_store(spark: SparkSession, sf_dir: str) -> Store:
    """``conversations`` as events of one kind by turn, linked by conversation; turns are seconds."""
    c = read(spark, sf_dir, "conversations")
    rows = c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("rid"),
        F.concat_ws(":", F.lit("turn"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.concat(F.lit("chat-"), F.col("role")).alias("source"),
        F.col("role").alias("kind"),
        ((F.col("conv_id") * 1000 + F.col("turn") + 1) * 1000).alias("at_ms"),
        F.substring(F.coalesce("text", F.lit("")), 1, 40).alias("title"),
        F.create_map(F.lit("chars"), F.length(F.coalesce("text", F.lit(""))).cast("string")).alias("attrs"),
        F.col("conv_id").alias("conv_id"),
    )
    links = rows.select("rid", F.lit("conv").alias("rel"), F.col("conv_id").cast("string").alias("target"))
    return Store.of(as_events(rows.drop("conv_id")), links=links)


def text_store(spark: SparkSession, sf_dir: str) -> Store:
    """``documents`` as events without a time: title is the first line, body the rest."""
    d = read(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = d.select(
        F.col("doc_id").alias("rid"),
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.lit("doc").alias("kind"),
        F.lit(0).cast("long").alias("at_ms"),
        F.split(text, "\n")[0].alias("title"),
        F.concat_ws("\n", F.slice(F.split(text, "\n"), 2, 1_000_000_000)).alias("body"),
        F.create_map(F.lit("lang"), F.coalesce("lang", F.lit(""))).alias("attrs"),
    )
    return Store.of(as_events(rows))
