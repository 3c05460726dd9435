"""Full-text search with BM25, and near duplicates by Hamming distance."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, lowered, words
from ..model import Store

K1, B = 1.2, 0.75
#: Postings are filed by a hash of their token, so that a query reads the files of its tokens only.
BUCKETS = 64
POSTINGS = "rid LONG, length INT, token STRING, tf LONG, bucket INT"
LENGTHS = "rid LONG, length INT"


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def postings(texts: DataFrame) -> DataFrame:
    """``rid``, ``length``, ``token``, ``tf``, ``bucket``: the inverted index of ``rid``, ``text``."""
    tokens = texts.select("rid", words(F.col("text")).alias("t")).withColumn("length", F.size("t"))
    return tokens.select("rid", "length", F.explode("t").alias("token")).groupBy("rid", "length", "token").agg(F.count("*").alias("tf")).withColumn("bucket", _bucket(F.col("token")))


def lengths(texts: DataFrame) -> DataFrame:
    """``rid``, ``length``: how many tokens each text has."""
    return texts.select("rid", F.size(words(F.col("text"))).alias("length"))


def ranked(index: DataFrame, sizes: DataFrame, query: list[str], limit: int | None = 25) -> DataFrame:
    """``bm25`` from ``postings`` and ``lengths``: only the postings of the query's tokens are read."""
    wanted = sorted(set(query))
    rows = index.where(F.col("bucket").isin([_bucket(F.lit(w)) for w in wanted]) & F.col("token").isin(wanted))
    tf = [F.coalesce(F.max(F.when(F.col("token") == w, F.col("tf"))), F.lit(0)).alias(f"tf{k}") for k, w in enumerate(wanted)]
    hits = rows.groupBy("rid", "length").agg(*tf)
    return _best(hits, sizes.agg(F.count("*").alias("n"), F.avg("length").alias("mean")), len(wanted), limit)


def bm25(texts: DataFrame, query: list[str], limit: int | None = 25) -> DataFrame:
    """``rid``, ``score`` of rows with all of ``query``'s tokens; higher is better, ties to the smaller rid."""
    wanted = sorted(set(query))
    sized = texts.select("rid", words(F.col("text")).alias("t"))
    totals = sized.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("mean"))
    times = lambda w: F.size(F.filter("t", lambda x: x == w))
    tf = [times(w).alias(f"tf{k}") for k, w in enumerate(wanted)]
    hits = sized.select("rid", F.size("t").alias("length"), *tf)
    return _best(hits, totals, len(wanted), limit)


def _best(hits: DataFrame, totals: DataFrame, tokens: int, limit: int | None) -> DataFrame:
    df = hits.agg(*(F.count(F.when(F.col(f"tf{k}") > 0, 1)).alias(f"df{k}") for k in range(tokens)))
    scored = hits.where(" AND ".join(f"tf{k} > 0" for k in range(tokens))).join(F.broadcast(totals.crossJoin(df)), F.lit(True))  # one row
    score = F.lit(0.0)
    for k in range(tokens):
        n, f = F.col(f"df{k}"), F.col(f"tf{k}")
        idf = F.greatest(F.log((F.col("n") - n + 0.5) / (n + 0.5)), F.lit(1e-6))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    out = scored.select("rid", score.alias("score"))
    return out.orderBy(F.desc("score"), "rid").limit(limit) if limit else out


def search(store: Store, text: str, limit: int = 25) -> DataFrame:
    """Events whose title and body hold ``text`` as a phrase of words, by BM25.

    Case and accents don't matter. If no event does, those that hold it as a plain substring, A-Z in
    either case, latest first. The ranked rows, ``limit`` at most, are worked out at once.
    """
    spark = store.events.sparkSession
    tokens = [r[0] for r in spark.createDataFrame([(text,)], "t string").select(F.explode(words(F.col("t")))).collect()]
    both = F.concat_ws(" ", "title", "body")
    shown = ["id", "source", "kind", "at_ms", "title"]
    if tokens:
        phrase = " " + " ".join(tokens) + " "
        holds = F.concat(F.lit(" "), F.array_join(words(both), " "), F.lit(" ")).contains(phrase)
        ranked = bm25(store.events.select("rid", both.alias("text")), tokens, None)
        found = store.events.where(holds).join(ranked, "rid").orderBy(F.desc("score"), "rid").limit(limit).select(*shown, "score")
        if rows := found.collect():
            return spark.createDataFrame(rows, found.schema)
    plain = store.events.where(ascii_lower(both).contains(lowered(text)))
    return plain.orderBy(F.desc("at_ms"), "id").limit(limit).select(*shown, F.lit(0.0).alias("score"))


def hamming(a, b):
    return F.bit_count(a.bitwiseXOR(b))


def similar(store: Store, prefix: str, most: int = 4, limit: int = 15) -> DataFrame:
    """Events whose SimHash differs in at most ``most`` bits from that of the first id with ``prefix``."""
    anchor = store.events.where(F.col("id").startswith(prefix)).orderBy("id").limit(1).select(F.col("id").alias("id0"), F.col("simhash").alias("h0"))
    hashed = store.events.where("simhash <> 0").join(F.broadcast(anchor), F.col("id") != F.col("id0"))
    near = hashed.withColumn("distance", hamming(F.col("simhash"), F.col("h0"))).where(F.col("distance") <= most)
    return near.select("id", "title", "distance", "rid").orderBy("distance", "rid").limit(limit).drop("rid")


def similar_pairs(hashes: DataFrame, most: int = 3) -> DataFrame:
    """``a``, ``b``, ``distance``: pairs of distinct hashes within ``most`` (up to 3) bits, and how far.

    ``hashes`` has ``rid``, ``h``; each distinct hash is one node, named by its smallest rid. The bits
    that aren't the same in all hashes are cut into ``n`` bands; two such hashes agree on all but
    ``most`` bands, so each is filed under every choice of ``n - most`` of them. ``n`` is the least
    with which a choice has bits enough to tell as many hashes apart as there are, so cells stay small
    however many hashes there are and however few of their bits vary.
    """
    if most > 3:
        raise ValueError("at most 3 differing bits")
    nodes = hashes.groupBy("h").agg(F.min("rid").alias("rid"))
    count, every, some = nodes.agg(F.count("*"), F.bit_and("h"), F.bit_or("h")).first()
    varying = [k for k in range(64) if count and ((every ^ some) >> k) & 1]
    bands = most + 1
    while bands < min(most + 7, len(varying)) and len(varying) * (bands - most) // bands < count.bit_length():
        bands += 1
    masks = [sum(1 << k for k in varying[i::bands]) for i in range(bands)]
    keys = [sum(x) for x in itertools.combinations(masks, bands - most)] if varying else [0]
    signed = [m - (1 << 64) if m >> 63 else m for m in keys]
    filed = nodes.select("rid", "h", F.posexplode(F.array(*(F.col("h").bitwiseAND(F.lit(m)) for m in signed))).alias("band", "v"))
    left, right = filed.toDF("a", "ha", "band", "v"), filed.toDF("b", "hb", "band", "v")
    met = left.join(right, ["band", "v"]).where("a < b").withColumn("distance", hamming(F.col("ha"), F.col("hb"))).where(F.col("distance") <= most)
    return met.select("a", "b", "distance").distinct()
