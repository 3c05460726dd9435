"""Exact dedup by content-defined chunk recipes.

Each text (A-Z lowered) is cut into chunks where a rolling hash of its last 16 bytes says so. A
chunk's identifier is its 128-bit hash once all chunks with that hash have been compared byte by
byte; where they differ, the identifier also holds which of them it is. Two texts are equal exactly
if their ordered lists of identifiers are. Each distinct chunk of a task moves once, for the
comparison; after that only lists of identifiers move.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, utf8, widened

#: Bytes: no chunk but a text's last is shorter, none is longer; a cut comes every 2**_CUT_BITS bytes or so.
SHORTEST, LONGEST, _CUT_BITS = 1024, 16384, 11
_GEAR = np.random.default_rng(9).integers(0, 1 << 32, 256, dtype=np.uint32)
#: Bytes of chunks that a task holds to tell which it has sent already.
_HELD = 64 << 20
#: Bytes that are cut at once.
_AT_ONCE = 8 << 20


def _cuts(data: bytes) -> list[int]:
    """Ends of the places where the hash of the last 16 bytes has zeros in its top bits."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8):
        h[k:] += h[:-k] << np.uint32(k)
    return (np.flatnonzero(h >> np.uint32(32 - _CUT_BITS) == 0) + 1).tolist()


def chunks(texts: list[bytes]) -> list[list[bytes]]:
    """Each text as its chunks, of which it is the concatenation; an empty text has none.

    Cuts depend on nothing but the text: a cut needs ``SHORTEST`` bytes before it, so no window
    reaches into the text before.
    """
    out: list[list[bytes]] = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size == 0 or size + len(texts[end]) <= _AT_ONCE):
            size += len(texts[end])
            end += 1
        part = texts[at:end]
        ends = _cuts(b"".join(part)) if any(len(x) > SHORTEST for x in part) else []
        base = 0
        for text in part:
            n, start, got = len(text), 0, []
            while n - start > SHORTEST:
                k = bisect_left(ends, base + start + SHORTEST)
                stop = min(ends[k] - base if k < len(ends) else n, start + LONGEST, n)
                got.append(text[start:stop])
                start = stop
            if start < n:
                got.append(text[start:])
            out.append(got)
            base += n
        at = end
    return out


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch with few enough bytes, and their texts, normalised."""
    sizes = np.cumsum(_lengths(batch.column("text")))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + _AT_ONCE, "right")))
        part = batch.slice(start, end - start)
        yield part, [x.lower() for x in part.column("text").to_pylist()]
        start = end


def _lengths(column: pa.Array) -> np.ndarray:
    return pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[bytes], bytes] = xxhash.xxh3_128_digest) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the
    largest id of each group stays; of rows that repeat that id, one. An empty table gives no rows.
    ``digest`` names chunks before they are compared: a poor one costs time, never a wrong group.
    """

    def recipe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _batches(batch):
                lists = [b"".join(map(digest, x)) for x in chunks(texts)]
                shas = [hashlib.sha256(x).hexdigest() for x in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shas), pa.array(lists, pa.binary())], ["id", "sha", "recipe"])

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        held = 0
        for batch in batches:
            for _, texts in _batches(batch):
                new: list[bytes] = []
                for got in chunks(texts):
                    for x in got:
                        if x not in sent:
                            sent.add(x)
                            new.append(x)
                            held += len(x)
                if held > _HELD:
                    sent.clear()
                    held = 0
                yield pa.RecordBatch.from_arrays([pa.array(list(map(digest, new)), pa.binary()), pa.array(new, pa.binary())], ["hash", "chunk"])

    rows = widened(docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")))
    kind = rows.schema["id"].dataType.simpleString()
    recipes = rows.mapInArrow(recipe, f"id {kind}, sha string, recipe binary")
    recipes = stored(recipes.withColumn("row", F.monotonically_increasing_id()), "recipes")

    found = rows.select("id", "text").mapInArrow(distinct, "hash binary, chunk binary")
    collided = stored(found.groupBy("hash").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).where("a <> b").select("hash"), "collided")
    if collided.isEmpty():
        named = recipes.withColumn("which", F.lit(""))
    else:
        named = _told_apart(rows, recipes, collided, digest)
    group = ["recipe", "which"]
    best = named.groupBy(*group).agg(F.max(F.struct("id", "row")).alias("best"), F.count("*").alias("group_size"))
    return named.join(best, group).select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def _told_apart(rows: DataFrame, recipes: DataFrame, collided: DataFrame, digest: Callable[[bytes], bytes]) -> DataFrame:
    """``recipes`` with a column ``which``: for every chunk whose hash others share, its number among them."""

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _batches(batch):
                out = [(hashlib.sha256(t).hexdigest(), k, digest(x), x) for t, got in zip(texts, chunks(texts)) for k, x in enumerate(got)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[c] for x in out], t) for c, t in enumerate((pa.string(), pa.int64(), pa.binary(), pa.binary()))],
                    ["sha", "pos", "hash", "chunk"],
                )

    seen = rows.mapInArrow(occurrences, "sha string, pos long, hash binary, chunk binary").join(collided, "hash", "left_semi")
    place = Window.partitionBy("hash").orderBy("chunk")
    apart = seen.select("hash", "chunk").distinct().withColumn("number", F.row_number().over(place))
    told = (
        seen.join(apart, ["hash", "chunk"])
        .select("sha", F.struct("pos", "number").alias("x"))
        .distinct()
        .groupBy("sha")
        .agg(F.array_sort(F.collect_list("x")).cast("string").alias("which"))
    )
    # by the text's own hash, not by id: ids may be null or repeat
    return recipes.join(told, "sha", "left").withColumn("which", F.coalesce("which", F.lit("")))


def unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when equal texts are reduced to the row with the largest id."""
    kept = deduplicate(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha"))
    lower = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col(id_col).alias("__key"), F.sha2(lower.cast("binary"), 256).alias("__of"))
    same = F.col("__key").eqNullSafe(F.col("__id")) & (F.col("__of") == F.col("__sha"))
    return rows.join(kept, same, "left_semi").dropDuplicates(["__key", "__of"]).select("__row.*")
