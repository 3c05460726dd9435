"""SimHash near-duplicates: fingerprints, a grid over segment popcounts, exact verification.

A fingerprint of 64 bits is cut into 32 segments of two bits. The vector of their popcounts is the
embedding; the Manhattan distance of two embeddings never exceeds the Hamming distance of the
fingerprints, since a differing bit changes one popcount by one at most. A link within ``RADIUS`` = 3
bits therefore lies within Manhattan distance 3 over the two halves of the embedding, and within 1
in one of the halves. Each half is a grid of unit cells in 16 dimensions: a fingerprint settles in
its own cell and visits the cells one step up in each dimension, and every pair within Manhattan
distance 1 meets in the cell of the upper one. Pairs that meet are tested exactly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored, utf8, widened
from .components import components

RADIUS = 3
#: Shingle hashes whose bits are counted at once; a longer text is counted alone, in such blocks.
_MANY = 1 << 17
#: Fingerprints that one comparison holds against all others of a cell.
_BLOCK = 64


def _hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle of ``text``: A-Z lowered, words split at ASCII blanks.

    Shingles repeat as often as they occur; fewer words than ``words`` make one shingle of all of
    them, and no word at all makes none.
    """
    parts = text.lower().split()
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(b" ".join(parts), 42)] if parts else [], np.uint64)
    shingles = map(b" ".join, zip(*(islice(parts, k, None) for k in range(words))))
    return np.fromiter((digest(x, 42) for x in shingles), np.uint64, len(parts) - words + 1)


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprint_all(texts: list[bytes], words: int = 3) -> np.ndarray:
    """64-bit SimHash of each text: a bit is set if over half of the shingle hashes set it; 0 without words."""
    return _voted((_hashes(text, words) for text in texts), len(texts))


def _voted(hashes: Iterable[np.ndarray], n: int) -> np.ndarray:
    """The majority of the bits of each of ``n`` collections of hashes."""
    out = np.zeros(n, np.uint64)
    held: list[np.ndarray] = []
    sizes: list[int] = []
    whose: list[int] = []
    many = 0

    def settle(ones: np.ndarray, size: np.ndarray, at: list[int]) -> None:
        out[at] = np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]

    def flush() -> None:
        if held:
            size = np.array(sizes)
            bits = _bits(np.concatenate(held))
            settle(np.add.reduceat(bits, np.cumsum(size) - size, axis=0, dtype=np.int64), size, whose)
        for x in (held, sizes, whose):
            x.clear()

    for k, got in enumerate(hashes):
        if len(got) > _MANY:
            ones = sum(_bits(got[i : i + _MANY]).sum(axis=0, dtype=np.int64) for i in range(0, len(got), _MANY))
            settle(ones[None, :], np.array([len(got)]), [k])
        elif len(got):
            held.append(got)
            sizes.append(len(got))
            whose.append(k)
            many += len(got)
            if many >= _MANY:
                flush()
                many = 0
    flush()
    return out


def fingerprint(text: bytes, words: int = 3) -> int:
    """The fingerprint of one text."""
    return int(fingerprint_all([text], words)[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fp`` (the fingerprint as a signed long) of every row; null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = fingerprint_all(batch.column(1).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    rows = widened(docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, fp long").select(F.col("id").alias(id_col), "fp")


def _cells(fps: DataFrame) -> DataFrame:
    """``cell``, ``visit`` (0 in the own cell, 1 a step up) and the columns of ``fps``, of which ``k`` tells grids apart."""
    half = "CAST(CASE side WHEN 0 THEN fp & 4294967295L ELSE shiftrightunsigned(fp, 32) END AS BIGINT)"
    sides = fps.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    at = sides.withColumn("h", F.expr(half)).withColumn(
        "own", F.expr("(h - (shiftrightunsigned(h, 1) & 1431655765L)) + shiftleft(CAST(2 * k + side AS BIGINT), 32)")
    )
    up = "filter(transform(sequence(0, 15), j -> CASE WHEN (shiftrightunsigned(own, 2 * j) & 3L) < 2 THEN own + shiftleft(1L, 2 * j) END), x -> x IS NOT NULL)"
    spread = at.withColumn("cell", F.expr(f"explode(concat(array(own), {up}))"))
    return spread.selectExpr("cell", "CAST(cell <> own AS TINYINT) AS visit", *(c for c in fps.columns if c != "k"))


def _forest(fps: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that join all of ``fps`` which are connected within ``radius``: fewer than there are fps."""
    rest = fps
    a, b = [], []
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            block, front = front[:_BLOCK], front[_BLOCK:]
            near = np.bitwise_count(block[:, None] ^ rest[None, :]) <= radius
            hit = near.any(axis=0)
            if hit.any():
                new = rest[hit]
                a.append(block[near[:, hit].argmax(axis=0)])
                b.append(new)
                rest = rest[~hit]
                front = np.concatenate([front, new])
    return a, b


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole cells, in turn: rows come in the order of the first column."""
    kept: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        got = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        whole = bool(kept) and kept[0][0][0] == got[0][-1]
        kept.append(got)
        if whole:
            continue
        rows = [np.concatenate(x) for x in zip(*kept)]
        cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last cell may go on in the next batch
        if cut:
            yield [x[:cut] for x in rows]
        kept = [[x[cut:] for x in rows]]
    if kept:
        yield [np.concatenate(x) for x in zip(*kept)]


def _settled(cell: np.ndarray, visit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of the cells where someone settles and someone else comes; rows are sorted by visit."""
    new = np.flatnonzero(np.diff(cell, prepend=cell[0] - 1))
    size = np.diff(np.append(new, len(cell)))
    fine = (visit[new] == 0) & (size > 1)
    return new[fine], size[fine]


def _met(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links between fingerprints that meet in a cell."""
    for cell, visit, fp in _runs(batches):
        fp = fp.view(np.uint64)
        start, size = _settled(cell, visit)
        two = start[size == 2]
        near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius
        a, b = [fp[two[near]]], [fp[two[near] + 1]]
        for at, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
            x, y = _forest(np.unique(fp[at : at + n]), radius)
            a += x
            b += y
        u, v = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def _dealt(cells: DataFrame) -> DataFrame:
    spark = cells.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return cells.repartition(parts, "cell").sortWithinPartitions("cell", "visit")


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``u``, ``v``: links that connect whatever distinct values of ``fp`` lie within ``radius`` bits.

    Within a cell only a spanning forest of the links is returned, so that thousands of near copies
    don't become millions of pairs; a link that is left out has its ends connected by others.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError("the grid serves at most 3 differing bits")
    cells = _cells(fps.select("fp").distinct().withColumn("k", F.lit(0)))
    return _dealt(cells).mapInArrow(lambda x: _met(x, radius), "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``fp``, ``component_id``.

    ``component_id`` is the smallest id that links of at most ``radius`` differing bits reach, the
    own one included. Null and empty texts have fingerprint 0 and link like any other; repeated ids
    give repeated rows; an empty table gives no rows. Other columns of ``docs`` are not read.
    """
    fps = stored(fingerprints(docs, words, id_col, text_col).withColumnRenamed(id_col, "id"), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(nodes, radius))
    tied = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    tied = stored(tied, "classes")
    lowest = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = tied.join(lowest, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def as_hex(column: str = "fp"):
    """16 lowercase hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


# --- near duplicates by similarity of shingle sets -----------------------------------------------

#: One document in ``_SAMPLED`` is read to tell common shingles: those that occur in ``_COMMON`` of these
#: documents, the ``_LISTED`` commonest. Which pairs are found doesn't depend on it, only how many are tried.
_SAMPLED, _COMMON, _LISTED = 8, 4, 1 << 17
#: So many members of a cell are held against all others in the first round, and times as many after each round.
_FIRST, _GROWTH = 1, 16
#: Rows of one cell that a task gathers, or holds against the leading members; larger cells are split.
_WHOLE = 1 << 16
#: Pairs that are handed on at once.
_PAIRS = 1 << 16
#: Bits of the filter (their logarithm) that tells whose texts a verification reads, at most: 16 MB.
_BITS = 27
#: Segments of a set's counts: a power of two between its size and twice as many, within these bounds. With
#: so many, few differences fall together, and most pairs under 0.75 are told from those of 0.8 or more.
_FEWEST, _MOST = 16, 1 << 12


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of ``text``; fewer words make one shingle of all of them."""
    return np.unique(_hashes(text, words))


def rarest(shingles: np.ndarray, similarity: float, common: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The first shingles of a set, rare ones before ``common`` ones (sorted, with their ``count``).

    Sets of n shingles that are similar share ``similarity`` * n of them at least, so not all of the
    others come before the first shared one: whatever the order, two similar sets have a common
    member among their first n - ceil(``similarity`` * n) + 1.
    """
    n = len(shingles)
    if not n:
        return shingles
    rank = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        rank = np.where(common[at] == shingles, count[at], 0)
    return shingles[np.lexsort((shingles, rank))[: n - int(np.ceil(similarity * n - 1e-9)) + 1]]


def segment_counts(shingles: np.ndarray) -> bytes:
    """How many of the shingles fall in each segment of the range of hashes, a byte each (255: or more).

    The Manhattan distance of two such vectors never exceeds the number of shingles that only one of
    the sets has: such a shingle changes one count by one.
    """
    bits = max(_FEWEST, min(_MOST, 2 * len(shingles))).bit_length() - 1
    return np.minimum(np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def _folded(counts: np.ndarray, segments: int) -> np.ndarray:
    """Rows of counts over fewer segments."""
    return counts.reshape(len(counts), segments, -1).sum(axis=2, dtype=np.int32)


def may_be_similar(one: bytes, n: int, others: Sequence[bytes], sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Which of ``others`` sizes and segment counts don't rule out as similar to ``one``; a lower bound, so none is missed."""
    fine = np.minimum(n, sizes) >= similarity * np.maximum(n, sizes) - 1e-9
    most = (n + sizes) * ((1 - similarity) / (1 + similarity)) + 1e-9
    mine = np.frombuffer(one, np.uint8)[None, :]
    widths = np.fromiter(map(len, others), np.int64, len(others))
    for width in np.unique(widths[fine]).tolist():
        at = np.flatnonzero(fine & (widths == width))
        least = min(width, mine.shape[1])
        # a full byte may stand for more, so such counts are as good as equal
        theirs = np.frombuffer(b"".join([others[k] for k in at.tolist()]), np.uint8).reshape(len(at), width)
        if width == mine.shape[1]:
            apart = np.abs(theirs.astype(np.int16) - mine).sum(axis=1, dtype=np.int64)
        else:
            full = bool((theirs == 255).any() or (mine == 255).any())
            apart = np.zeros(len(at), np.int64) if full else np.abs(_folded(theirs, least) - _folded(mine, least)).sum(axis=1)
        fine[at] = apart <= most[at]
    return fine


def _shared(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """``cell``, ``members``, ``place``, ``id``, ``n`` of the documents that share a shingle.

    Rows come sorted by shingle and size; a cell ends where sizes leave so wide a gap that no pair
    across it is similar. Cells of the same documents have one name. A cell of more than ``_WHOLE``
    documents is handed on as it comes, unsorted, and its ``members`` are -1.
    """

    def cells(shingle: np.ndarray, n: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.flatnonzero(np.diff(shingle, prepend=shingle[0] - 1))
        size = np.diff(np.append(new, len(shingle)))
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        for at, m in zip(new[size > 1].tolist(), size[size > 1].tolist()):
            k = n[at : at + m]
            ends = [0, *(np.flatnonzero(k[:-1] < similarity * k[1:] - 1e-9) + 1).tolist(), m]
            for i, j in zip(ends[:-1], ends[1:]):
                who, first = np.unique(ids[at + i : at + j], return_index=True)
                if len(who) > 1:
                    cell = np.uint64(xxhash.xxh64_intdigest(who.tobytes())).view(np.int64)
                    for x, y in zip(out, (np.full(len(who), cell), np.full(len(who), len(who)), np.arange(len(who)), who, k[i:j][first])):
                        x.append(y)
        if out[0]:
            yield batch_of([np.concatenate(x) for x in out])

    def batch_of(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], ["cell", "members", "place", "id", "n"])

    def streamed(rows: list[np.ndarray], sent: int) -> pa.RecordBatch:
        m = len(rows[0])
        return batch_of([rows[0], np.full(m, -1), np.arange(sent, sent + m), rows[2], rows[1]])

    kept: list[list[np.ndarray]] = []
    held, large, sent = 0, None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if large is not None:  # the rest of a large cell
            cut = int(np.searchsorted(rows[0], large, "right"))
            if cut:
                yield streamed([x[:cut] for x in rows], sent)
                sent += cut
                rows = [x[cut:] for x in rows]
            if not len(rows[0]):
                continue
            large, sent = None, 0
        whole = bool(kept) and kept[-1][0][-1] == rows[0][-1] and kept[0][0][0] == rows[0][-1]
        kept.append(rows)
        held += len(rows[0])
        if whole and held <= _WHOLE:
            continue
        rows = [np.concatenate(x) for x in zip(*kept)]
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        if cut:
            yield from cells(*(x[:cut] for x in rows))
        kept, held = [[x[cut:] for x in rows]], len(rows[0]) - cut
        if held > _WHOLE:
            large = rows[0][-1]
            yield streamed(kept[0], 0)
            sent, kept, held = held, [], 0
    if kept:
        yield from cells(*(np.concatenate(x) for x in zip(*kept)))


def _led(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Pairs of a leading and another member of a cell that may be similar and aren't connected.

    Rows (cell, part, other, place, id, n, root, counts) come sorted; of each part of a cell the
    leading members come first (``other`` 0), and they are all that is held.
    """
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    held = 0

    def handed() -> pa.RecordBatch:
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)  # cells of much the same members repeat them
        a.clear()
        b.clear()
        return pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], ["u", "v"])

    now: tuple[int, int] | None = None
    lead: list[tuple[int, int, int, int, bytes]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cell, part, other, place, ids, n, root, counts = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        new = np.flatnonzero((np.diff(cell, prepend=cell[0] - 1) != 0) | (np.diff(part, prepend=part[0]) != 0))
        for at, end in zip(new.tolist(), np.append(new[1:], len(cell)).tolist()):
            if now != (cell[at], part[at]):
                now, lead = (cell[at], part[at]), []
            first = at + int(np.searchsorted(other[at:end], 1))
            lead += zip(place[at:first].tolist(), ids[at:first].tolist(), n[at:first].tolist(), root[at:first].tolist(), counts[at:first])
            for p, i, size, r, mine in lead:
                k = np.arange(first, end)[(place[first:end] > p) & (root[first:end] != r)]
                k = k[may_be_similar(mine, size, counts[k], n[k], similarity)] if len(k) else k
                if len(k):
                    a.append(np.minimum(ids[k], i))
                    b.append(np.maximum(ids[k], i))
                    held += len(k)
                    if held >= _PAIRS:
                        yield handed()
                        held = 0
    if a:
        yield handed()


def _place(bits: int):
    """The bit of a filter of ``bits`` bits that stands for a key."""
    return F.pmod(F.xxhash64("key"), F.lit(bits))


def _filter(wanted: DataFrame) -> tuple[int, np.ndarray]:
    """A bitmap with the bits of all keys of ``wanted``; at most ``_BITS`` bits whatever their number.

    What passes it is joined by key afterwards, so a full one costs time only.
    """
    bits = 1 << min(_BITS, max(15, (32 * wanted.count()).bit_length()))
    at = _place(bits) + 1
    maps = wanted.groupBy(F.bitmap_bucket_number(at).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("m"))
    out = np.zeros(bits // 8, np.uint8)
    for r in maps.collect():  # 4096 bytes each, at most bits / 32768 of them
        out[(r["n"] - 1) * 4096 : r["n"] * 4096] = np.frombuffer(r["m"], np.uint8)
    return bits, out


def text_key(text_col: str = "text"):
    """The MD5 of a text's bytes (null is empty), by which rows that repeat an id are told apart."""
    return F.unhex(F.md5(utf8(text_col)))


def similar(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``key`` (see ``text_key``), ``component_id`` and ``kept`` of the rows that have a near duplicate.

    Two rows are near duplicates if the sets of their ``words``-word shingles have a Jaccard
    similarity of ``similarity`` or more; ``component_id`` is the smallest id that such links reach,
    and ``kept`` tells the one row of each group with that id and, of these, the smallest key. Null
    ids come after all others; rows that repeat an id are told apart by their texts; texts without a
    word are alike. Rows without a near duplicate are left out.

    Rows with equal sets are one. SimHash comes first: fingerprints over the shingles, the grid over
    their popcounts, and the pairs within ``RADIUS`` bits verified on their shingle sets. Similar sets
    can lie further apart than that, so the rest is found exactly: whatever shares one of its rarest
    shingles (see ``rarest``, no similar pair fails to) meets in a cell. There the first member is
    compared with the others; then further ones, more in each round, with those that they aren't yet
    connected to, until each pair of the cell was compared or is connected. Counts of shingles by
    segment give a lower bound of the difference of two sets (see ``segment_counts``); pairs that it
    doesn't rule out are verified on the sets.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity is over 0 and at most 1")

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                got = [shingle_set(x, words) for x in batch.column(0).slice(at, 500).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got).view(np.int64))], ["shingle"])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                hashes = [_hashes(x, words) for x in part.column(2).to_pylist()]
                fps = _voted(hashes, len(hashes)).view(np.int64)
                sets = [np.unique(x) for x in hashes]
                digest = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
                rare = [rarest(x, similarity, common, count).view(np.int64) for x in sets]
                ends = pa.array(np.cumsum([0, *map(len, rare)]), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(rare)))
                counts = pa.array(list(map(segment_counts, sets)), pa.binary())
                columns = [part.column(0), part.column(1), pa.array(fps), pa.array(list(map(len, sets)), pa.int64()), pa.array(digest, pa.binary()), lists, counts]
                yield pa.RecordBatch.from_arrays(columns, ["row", "key", "fp", "n", "digest", "rare", "counts"])

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, n, m, x, y = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            keep = pa.array([bool(may_be_similar(x[k], n[k], y[k : k + 1], m[k : k + 1], similarity)[0]) for k in range(batch.num_rows)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in range(2)], ["u", "v"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if min(len(a), len(b)) >= similarity * max(len(a), len(b)):
                    both = np.concatenate([a, b])
                    both.sort()
                    same = int((both[1:] == both[:-1]).sum())
                    good[k] = same >= similarity * (len(both) - same)
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in range(2)], ["u", "v"])

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of the pairs whose sets are similar; texts are read again, and only the sets of the pairs' members move."""
        ends = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
        wanted = stored(ends.join(marks.select("id", "key"), "id"), "wanted")
        bits, member = _filter(wanted)

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column(1).to_numpy()
                for rows in np.array_split(np.flatnonzero(member[at >> 3] >> (at & 7).astype(np.uint8) & 1), 1 + batch.num_rows // 500):
                    part = batch.take(pa.array(rows))
                    got = [shingle_set(x, words).tobytes() for x in part.column(2).to_pylist()]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.binary())], ["key", "shingles"])

        found = texts.select("key", _place(bits).alias("at"), "text").mapInArrow(sets, "key binary, shingles binary")
        known = stored(found.join(wanted, "key").dropDuplicates(["id"]).select("id", "shingles"), "shingles")
        one = pairs.join(known.select(F.col("id").alias("u"), F.col("shingles").alias("a")), "u")
        two = one.join(known.select(F.col("id").alias("v"), F.col("shingles").alias("b")), "v")
        out = stored(two.select("u", "v", "a", "b").mapInArrow(compare, "u long, v long"), "verified")
        discard(known, wanted)
        return out

    def dealt(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
        spark = df.sparkSession
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        return df.repartition(parts, *by).sortWithinPartitions(*order)

    texts = docs.select(F.col(id_col).alias("row"), text_key(text_col).alias("key"), utf8(text_col).alias("text"))
    few = texts.select("text", "key").where(F.pmod(F.xxhash64("key"), F.lit(_SAMPLED)) == 0).select("text").mapInArrow(sampled, "shingle long")
    often = few.groupBy("shingle").count().where(F.col("count") >= _COMMON)
    listed = sorted((r["shingle"] % 2**64, r["count"]) for r in often.orderBy(F.desc("count"), "shingle").limit(_LISTED).collect())
    common, count = np.array([x for x, _ in listed], np.uint64), np.array([x for _, x in listed], np.int64)

    kind = texts.schema["row"].dataType.simpleString()
    schema = f"row {kind}, key binary, fp long, n long, digest binary, rare array<bigint>, counts binary"
    marks = stored(widened(texts).mapInArrow(marked, schema).withColumn("id", F.monotonically_increasing_id()), "marks")
    least = marks.groupBy("digest").agg(F.min("id").alias("u"), F.count("*").alias("many")).where("many > 1").drop("many")
    equal = stored(marks.select("id", "digest").join(least, "digest").where("id <> u").select("u", F.col("id").alias("v")), "equal")
    single = marks if equal.isEmpty() else marks.join(equal.select(F.col("v").alias("id")), "id", "left_anti")

    # SimHash: the pairs that the grid finds, and what shares a fingerprint
    leaders = single.groupBy("fp").agg(F.min("id").alias("lead"))
    near = links(single).toDF("x", "y")
    near = near.join(leaders.toDF("x", "u"), "x").join(leaders.toDF("y", "v"), "y").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    same = single.select("id", "fp").join(leaders, "fp").where("id <> lead").select(F.col("lead").alias("u"), F.col("id").alias("v"))
    side = single.select("id", "n", "counts")
    both = near.union(same).distinct().join(side.toDF("u", "n", "x"), "u").join(side.toDF("v", "m", "y"), "v").select("u", "v", "n", "m", "x", "y")
    tried = stored(both.mapInArrow(sift, "u long, v long"), "candidates")
    roots = components(equal.union(verified(tried)))

    # the rest: cells of rare shingles
    spread = dealt(single.select(F.explode("rare").alias("shingle"), "n", "id"), ["shingle"], ["shingle", "n"])
    live = spread.mapInArrow(lambda x: _shared(x, similarity), "cell long, members long, place long, id long, n long").distinct()
    live = stored(live.join(single.select("id", "counts"), "id").select("cell", "members", "place", "id", "n", "counts"), "cells")
    if not live.where("members < 0").isEmpty():
        some = live
        sizes = some.groupBy("cell").agg((F.max("place") + 1).alias("size"))
        live = stored(some.join(sizes, "cell").withColumn("members", F.col("size")).drop("size"), "cells")
        discard(some)
    done, upto, before = 0, _FIRST, live
    while not live.isEmpty():
        # cells whose members are all connected are done
        at = live.join(roots.toDF("id", "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        open_ = at.groupBy("cell").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
        at = stored(at.join(open_, "cell", "left_semi"), "cells")
        discard(before)
        before = at
        last = F.expr(f"(members - 1) div {_WHOLE}")
        leads = at.where((F.col("place") >= done) & (F.col("place") < upto)).withColumn("part", F.explode(F.sequence(F.lit(0), last))).withColumn("other", F.lit(0))
        rest = at.where(F.col("place") > done).withColumn("part", F.expr(f"place div {_WHOLE}")).withColumn("other", F.lit(1))
        columns = ["cell", "part", "other", "place", "id", "n", "root", "counts"]
        met = dealt(leads.select(columns).union(rest.select(columns)), ["cell", "part"], columns[:4])
        met = met.mapInArrow(lambda x: _led(x, similarity), "u long, v long").distinct().join(tried, ["u", "v"], "left_anti")
        met = stored(met, "candidates")
        tried = tried.union(met)
        if not met.isEmpty():
            found = verified(met)
            if not found.isEmpty():
                roots = components(roots.toDF("u", "v").union(found))
            discard(found)
        live = at.where(F.col("members") > upto + 1).drop("root")
        done, upto = upto, upto * _GROWTH
    group = marks.select("id", "row", "key").join(roots.toDF("id", "root"), "id")
    first = group.groupBy("root").agg(F.min(F.struct(F.col("row").isNull().alias("none"), "row", "key", "id")).alias("first"))
    return group.join(first, "root").select(F.col("row").alias("id"), "key", F.col("first.row").alias("component_id"), (F.col("id") == F.col("first.id")).alias("kept"))


def without_similar(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates (see ``similar``): the one that is ``kept``."""
    found = stored(similar(docs, words, similarity, id_col, text_col), "groups")
    by_row = found.groupBy("id", "key").agg(F.max("kept").alias("kept"), F.count("*").alias("copies"))
    by_row = by_row.select(F.col("id").alias("__id"), F.col("key").alias("__key"), "kept", "copies")
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col(id_col).alias("__of"), text_key(text_col).alias("__text"))
    same = F.col("__of").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__key"))
    out = rows.join(by_row.where("NOT kept"), same, "left_anti")
    again = by_row.where("kept AND copies > 1").select("__id", "__key")
    if not again.isEmpty():  # rows that repeat both id and text: one of them
        out = out.join(again, same, "left_anti").union(out.join(again, same, "left_semi").dropDuplicates(["__of", "__text"]))
    return out.select("__row.*")
