"""A corpus from documents to packed sequences: language, exact copies, near copies, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet to
the session's shared folder and reads again as the next stage's ``docs``. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm import exact, language, packing, simhash
from annalist.llm.common import stored, table
from annalist.llm.queries import BYTE_BPE

#: Documents whose likeliest language is less likely than this are rejected, as are those without a letter.
LEAST_SCORE = 0.35


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network can tell: no ``und``, no score below ``LEAST_SCORE``.

    Where no document may be learned from, there is no network, and every text with a letter stays.
    """
    model = language.fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    told = language.identify(rows, model, carry=("row",))
    fine = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return told.where(fine).select("row.*")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact.unique(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (five-word shingles, similarity 0.8), the document with the smallest id."""
    return simhash.without_similar(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    out = packing.pack(docs, BYTE_BPE)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language", identified),
    ("exact_dedup", without_copies),
    ("simhash", without_near_copies),
    ("packing", packed),
]

#: A network, a grid of fingerprints and a tokenizer have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, one after the other."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
