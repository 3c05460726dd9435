"""Approximate nearest neighbours: a navigable small-world graph per shard.

Vectors are dealt to shards of bounded size. In each shard equal vectors become one node, and the
nodes a hierarchical graph, kept as flat arrays: one row of neighbour numbers per node and level.
Each shard goes to one task, with the queries, in blocks, after it; the shards' results are merged by
distance and id. Graphs are built and walked in single precision, for many nodes or queries at once;
scores are worked out from the original vectors in double.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Neighbours per node (twice as many on the lowest level), nearest nodes from which they are chosen,
#: and how wide a search looks.
LINKS, BUILD, SEARCH = 12, 48, 224
#: Vectors of a shard, about, and queries of a block.
SHARD, BLOCK = 16384, 1024
#: Nodes that are added at once, queries that walk at once, and nodes that each of them leaves in a step.
_ADDED, _WALKERS, _LEFT = 256, 128, 4


def _gathered(data: np.ndarray, q: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """Squared distances from each row of ``q`` to the nodes in its row of ``xs``; infinite where there is none."""
    d = data[xs]
    d -= q[:, None, :]
    out = np.einsum("ijk,ijk->ij", d, d)
    out[xs < 0] = np.inf
    return out


class Graph:
    """A hierarchical navigable small world over the rows of ``data``, in flat arrays."""

    def __init__(self, data: np.ndarray, neighbours: list[np.ndarray] | None = None, start: int = 0):
        self.data = data
        self.neighbours = neighbours or []  # per level: (nodes, width), -1 where there is none
        self.start = start

    @classmethod
    def build(cls, data: np.ndarray, links: int = LINKS, width: int = BUILD, seed: int = 7) -> Graph:
        """Insert the rows in a random order, many at once; the seed is fixed, so the graph is the same each time.

        A node's neighbours are chosen from its ``width`` nearest among the nodes before it, which one
        product of matrices finds for all nodes of a block; early nodes so get the long links.
        """
        n = len(data)
        if not n:
            return cls(data)
        rng = np.random.default_rng(seed)
        levels = np.minimum((-np.log(1 - rng.random(n)) / np.log(links)).astype(int), 12)
        order = rng.permutation(n)
        squares = np.einsum("ij,ij->i", data, data)
        tables = []
        for level in range(int(levels.max()) + 1):
            on = order[levels[order] >= level]
            most = links if level else 2 * links
            rows = np.full((len(on), 2 * most), -1, np.int32)  # with room, so that few are pruned often
            size = np.zeros(len(on), np.int64)
            own, sq = data[on], squares[on]
            for start in range(1, len(on), _ADDED):
                end = min(start + _ADDED, len(on))
                d = sq[start:end, None] + sq[None, :end] - 2 * own[start:end] @ own[:end].T
                np.maximum(d, 0, out=d)
                d[np.arange(end)[None, :] >= np.arange(start, end)[:, None]] = np.inf  # only nodes before
                k = min(width, end - 1)
                near = np.argpartition(d, k - 1, axis=1)[:, :k] if k < end else np.argsort(d, axis=1)[:, :k]
                by = np.take_along_axis(d, near, 1)
                sorted_ = np.argsort(by, axis=1, kind="stable")
                near, by = np.take_along_axis(near, sorted_, 1), np.take_along_axis(by, sorted_, 1)
                chosen = cls._spread(own, near, by, links)
                rows[start:end, : chosen.shape[1]] = chosen
                size[start:end] = (chosen >= 0).sum(axis=1)
                cls._tied(own, rows, size, chosen, start, most)
            for at in np.array_split(np.flatnonzero(size > most), max(1, int((size > most).sum()) // 512)):
                if len(at):
                    cls._pruned(own, rows, size, at, most)
            table = np.full((n, most), -1, np.int32)
            kept = rows[:, :most]
            table[on] = np.where(kept >= 0, on[kept], -1)
            tables.append(table)
        top = order[levels[order] == levels.max()]
        return cls(data, tables, int(top[0]))

    @staticmethod
    def _spread(data: np.ndarray, near: np.ndarray, by: np.ndarray, most: int) -> np.ndarray:
        """Of each row of ``near`` (nearest first), those nearer to the node than to any chosen before; then the nearest."""
        rows, k = near.shape
        if k <= most:
            return np.where(np.isfinite(by), near, -1).astype(np.int32)
        among = data[near]
        squares = np.einsum("ijk,ijk->ij", among, among)
        between = squares[:, :, None] + squares[:, None, :] - 2 * among @ among.transpose(0, 2, 1)
        nearest = np.full((rows, k), np.inf, np.float32)
        taken = np.zeros((rows, k), bool)
        for j in range(k):
            take = (by[:, j] < nearest[:, j]) & np.isfinite(by[:, j])
            taken[:, j] = take
            at = np.flatnonzero(take)
            nearest[at] = np.minimum(nearest[at], between[at, j])
        # the chosen first, then the others, each nearest first
        rank = np.where(np.isfinite(by), np.where(taken, 0, k) + np.arange(k)[None, :], 4 * k)
        first = np.argsort(rank, axis=1)[:, :most]
        return np.where(np.isfinite(np.take_along_axis(by, first, 1)), np.take_along_axis(near, first, 1), -1).astype(np.int32)

    @classmethod
    def _pruned(cls, data: np.ndarray, rows: np.ndarray, size: np.ndarray, at: np.ndarray, most: int) -> None:
        d = _gathered(data, data[at], rows[at])
        sorted_ = np.argsort(d, axis=1, kind="stable")
        near, by = np.take_along_axis(rows[at], sorted_, 1), np.take_along_axis(d, sorted_, 1)
        rows[at] = -1
        rows[at, :most] = cls._spread(data, near, by, most)
        size[at] = (rows[at] >= 0).sum(axis=1)

    @classmethod
    def _tied(cls, data: np.ndarray, rows: np.ndarray, size: np.ndarray, chosen: np.ndarray, start: int, most: int) -> None:
        """Links back from the chosen neighbours to the nodes from ``start`` on; full rows are pruned."""
        x, slot = np.nonzero(chosen >= 0)
        y = chosen[x, slot].astype(np.int64)
        x = x + start
        by = np.argsort(y, kind="stable")
        x, y = x[by], y[by]
        while len(x):
            first = np.flatnonzero(np.diff(y, prepend=-1))
            place = np.arange(len(y)) - np.repeat(first, np.diff(np.append(first, len(y)))) + size[y]
            fits = place < rows.shape[1]
            rows[y[fits], place[fits]] = x[fits]
            at, times = np.unique(y[fits], return_counts=True)
            size[at] += times
            x, y = x[~fits], y[~fits]
            full = np.unique(y)
            for part in np.array_split(full, max(1, len(full) // 512)):
                if len(part):
                    cls._pruned(data, rows, size, part, most)

    def _greedy(self, q: np.ndarray, at: np.ndarray, level: int) -> np.ndarray:
        at = at.copy()
        best = _gathered(self.data, q, at[:, None])[:, 0]
        moving = np.arange(len(q))
        while len(moving):
            xs = self.neighbours[level][at[moving]]
            d = _gathered(self.data, q[moving], xs)
            k = d.argmin(axis=1)
            d = d[np.arange(len(moving)), k]
            better = d < best[moving]
            at[moving[better]] = xs[better, k[better]]
            best[moving[better]] = d[better]
            moving = moving[better]
        return at

    def nearest(self, queries: np.ndarray, k: int, width: int = SEARCH) -> np.ndarray:
        """About the ``k`` nearest nodes to each row of ``queries``, nearest first; -1 where there are fewer."""
        n, width = len(self.data), max(width, k)
        if n <= width:  # a search would see every node
            out = np.full((len(queries), k), -1, np.int64)
            for at, q in enumerate(queries):
                d = self.data - q
                found = np.argsort(np.einsum("ij,ij->i", d, d), kind="stable")[:k]
                out[at, : len(found)] = found
            return out
        return np.concatenate([self._walk(queries[at : at + _WALKERS], k, width) for at in range(0, len(queries), _WALKERS)] or [np.empty((0, k), np.int64)])

    def _walk(self, q: np.ndarray, k: int, width: int) -> np.ndarray:
        at = np.full(len(q), self.start)
        for level in range(len(self.neighbours) - 1, 0, -1):
            at = self._greedy(q, at, level)
        row = self.neighbours[0]
        seen = np.zeros((len(q), len(self.data) + 1), bool)
        seen[:, -1] = True  # where there is no neighbour
        seen[np.arange(len(q)), at] = True
        best = np.full((len(q), width), -1, np.int64)
        far = np.full((len(q), width), np.inf, np.float32)
        best[:, 0], far[:, 0] = at, _gathered(self.data, q, at[:, None])[:, 0]
        left = np.ones((len(q), width), bool)  # whose neighbours have been looked at, or empty
        left[:, 0] = False
        active = np.arange(len(q))
        while len(active):
            todo = np.where(left[active], np.inf, far[active])
            some = np.argpartition(todo, _LEFT, axis=1)[:, :_LEFT] if width > _LEFT else np.argsort(todo, axis=1)[:, :_LEFT]
            open_ = np.isfinite(np.take_along_axis(todo, some, 1))
            going = open_.any(axis=1)
            active, some, open_ = active[going], some[going], open_[going]
            if not len(active):
                break
            left[active[:, None], some] |= open_
            fresh = np.full((len(active), some.shape[1], row.shape[1]), -1, np.int64)
            for j in range(some.shape[1]):  # in turn, so that no node is met twice
                xs = np.where(open_[:, j, None], row[best[active, some[:, j]]], -1)
                new = ~seen[active[:, None], xs]
                fresh[:, j] = np.where(new, xs, -1)
                seen[active[:, None], xs] = True
            xs = fresh.reshape(len(active), -1)
            some_new = np.flatnonzero((xs >= 0).any(axis=0))
            xs = xs[:, some_new]
            d = np.full(xs.shape, np.inf, np.float32)
            r, c = np.nonzero(xs >= 0)
            if len(r):
                apart = self.data[xs[r, c]] - q[active[r]]
                d[r, c] = np.einsum("ij,ij->i", apart, apart)
            every, dist = np.concatenate([best[active], xs], axis=1), np.concatenate([far[active], d], axis=1)
            done = np.concatenate([left[active], ~np.isfinite(d)], axis=1)
            keep = np.argpartition(dist, width - 1, axis=1)[:, :width] if dist.shape[1] > width else np.argsort(dist, axis=1)
            best[active], far[active], left[active] = (np.take_along_axis(x, keep, 1) for x in (every, dist, done))
        order = np.argsort(far, axis=1, kind="stable")[:, :k]
        return np.where(np.isfinite(np.take_along_axis(far, order, 1)), np.take_along_axis(best, order, 1), -1)


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id``, ``v`` (doubles) and ``dim`` of the vectors that take part, repeated rows once."""
    v = F.col("v")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & fine).distinct().withColumn("dim", F.size("v"))


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, width: int = SEARCH) -> DataFrame:
    """The ``k`` nearest others found for each row whose id is divisible by ``every``.

    Columns: ``query_id``, ``rank`` (from 1), ``id_col``, ``score`` (Euclidean distance in double
    precision); nearest first, ties to the smaller id. A row's candidates are all other rows of the
    same length. Vectors that are null, empty or zero, or hold null or non-finite components, take no
    part; nor do rows with a null id. Rows that repeat id and vector count once; rows that repeat an
    id with another vector are rows like any other, and each asks for itself. Every vector is indexed:
    copies of one vector share a node, which keeps the rows that can matter, the ``k + 1`` smallest ids.

    Every query is asked of every shard, so work grows with queries times shards, and a query's rows
    with shards times ``k``; a larger ``shard`` (memory: 500 bytes a vector of 64 dimensions) lowers both.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    if kind != "bigint":
        raise TypeError(f"{id_col} must be a long, not {kind}")
    rows = stored(valid(vectors, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()), "vectors")
    sizes = {r["dim"]: (r["n"], r["most"]) for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).collect()}
    # numbers of shards run on over the dimensions, of which there are as many as kinds of vector
    first, shards = {}, 0
    for dim in sorted(sizes):
        first[dim], shards = shards, shards + -(-sizes[dim][0] // shard)
    if not shards:
        return spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score double")
    plan = spark.createDataFrame([(d, first[d], -(-sizes[d][0] // shard)) for d in sizes], "dim int, first int, shards int")
    scale = {d: 2.0 ** np.ceil(np.log2(most)) for d, (_, most) in sizes.items()}  # so that squares neither vanish nor overflow

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def made() -> pa.RecordBatch:
            dim = held[0][0]
            ids, row = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            original = np.concatenate([x[3] for x in held])
            order = np.lexsort((row, ids, *original.T[::-1]))
            original, ids, row = original[order], ids[order], row[order]
            at = np.flatnonzero(np.append(True, (original[1:] != original[:-1]).any(axis=1)))
            ends = np.append(at[1:], len(ids))
            counts = np.minimum(ends - at, k + 1)
            kept = np.repeat(at, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            nodes = original[at]
            graph = Graph.build((nodes / scale[dim]).astype(np.float32))
            links = b"".join(x.tobytes() for x in graph.neighbours)
            values = [now, dim, nodes.tobytes(), len(graph.neighbours), links, graph.start, counts.astype(np.int32).tobytes(), ids[kept].tobytes(), row[kept].tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, kinds)], ["slot", "dim", "nodes", "levels", "links", "start", "counts", "ids", "rows"])

        for batch in batches:
            slot = batch.column(0).to_numpy()
            new = np.flatnonzero(np.diff(slot, prepend=slot[0] - 1)) if len(slot) else []
            for a, b in zip(new, np.append(new[1:], len(slot))):
                if held and slot[a] != now:
                    yield made()
                    held = []
                now = int(slot[a])
                part = batch.slice(int(a), int(b - a))
                dim = part.column(1)[0].as_py()
                held.append((dim, part.column(2).to_numpy(), part.column(3).to_numpy(), part.column(4).flatten().to_numpy().reshape(-1, dim)))
        if held:
            yield made()

    slot = F.col("first") + F.pmod(F.xxhash64("id", "v"), F.col("shards")).cast("int")
    dealt = rows.join(F.broadcast(plan), "dim").select(slot.alias("slot"), "dim", "id", "row", "v")
    dealt = dealt.repartitionByRange(shards, "slot").sortWithinPartitions("slot")  # a task for each shard
    schema = "slot int, dim int, nodes binary, levels int, links binary, start int, counts binary, ids binary, rows binary"
    index = stored(dealt.mapInArrow(build, schema), "graphs")

    # the stated queries, in blocks, after each graph of their dimension
    asked = rows.where(F.col("id") % every == 0)
    number = rows.where(F.col("id") % every == 0).groupBy("dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    asked = asked.join(F.broadcast(number), "dim").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    asked = asked.groupBy("dim", "block").agg(F.collect_list(F.struct("id", "row", "v")).alias("asked")).join(F.broadcast(plan), "dim")
    visits = asked.select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("shards") - 1)).alias("slot"), "block", "asked")
    none = [F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in schema.split(", ")[1:])]
    both = index.select("slot", F.lit(-1).alias("block"), F.lit(None).cast(asked.schema["asked"].dataType).alias("asked"), *index.columns[1:]).unionByName(visits.select("slot", "block", "asked", *none))
    both = both.repartitionByRange(shards, "slot").sortWithinPartitions("slot", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                r = {n: batch.column(n)[at] for n in batch.schema.names}
                if r["block"].as_py() < 0:
                    dim = r["dim"].as_py()
                    nodes = np.frombuffer(r["nodes"].as_py(), np.float64).reshape(-1, dim)
                    flat, links, done = np.frombuffer(r["links"].as_py(), np.int32), [], 0
                    for level in range(r["levels"].as_py()):
                        width_of = LINKS if level else 2 * LINKS
                        links.append(flat[done : done + len(nodes) * width_of].reshape(-1, width_of))
                        done += len(nodes) * width_of
                    graph = Graph((nodes / scale[dim]).astype(np.float32), links, r["start"].as_py())
                    counts = np.frombuffer(r["counts"].as_py(), np.int32)
                    ids, row = np.frombuffer(r["ids"].as_py(), np.int64), np.frombuffer(r["rows"].as_py(), np.int64)
                    starts = np.cumsum(counts) - counts
                    continue
                asked = r["asked"].values if hasattr(r["asked"], "values") else pa.array(r["asked"].as_py())
                who, own = asked.field("id").to_numpy(), asked.field("row").to_numpy()
                q = asked.field("v").flatten().to_numpy().reshape(-1, dim)
                found = graph.nearest((q / scale[dim]).astype(np.float32), k + 1, width)
                a, c = np.nonzero(found >= 0)
                node = found[a, c]
                d = nodes[node] - q[a]
                score = np.sqrt(np.einsum("ij,ij->i", d, d))
                # every row of each node found but the query's own, the k nearest of them
                times = counts[node]
                take = np.repeat(starts[node], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                a, score = np.repeat(a, times), np.repeat(score, times)
                other = row[take] != own[a]
                a, score, take = a[other], score[other], take[other]
                order = np.lexsort((row[take], ids[take], score, a))
                a, score, take = a[order], score[order], take[order]
                begin = np.flatnonzero(np.diff(a, prepend=-1))
                place = np.arange(len(a)) - np.repeat(begin, np.diff(np.append(begin, len(a))))
                a, score, take = a[place < k], score[place < k], take[place < k]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (who[a], own[a], ids[take], row[take], score)], ["query_id", "query", "id", "row", "score"])

    found = both.mapInArrow(search, "query_id long, query long, id long, row long, score double")
    place = F.row_number().over(Window.partitionBy("query").orderBy("score", "id", "row"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
