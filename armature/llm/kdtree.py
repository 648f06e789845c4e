"""Exact top-k inner products with a KD-tree per shard (operator 8).

Method: vectors are dealt over shards of about ``SHARD_ROWS`` by a hash of their
id.  A shard's tree splits at the median of its widest dimension and keeps tight
bounding boxes.  A search pops the node whose box has the greatest possible inner product
(per component the better of its two ends), and stops when that bound is below
the kth score found.  Each query is first searched in its own shard; its kth score there goes
with it to every other shard, which then visits only boxes that can beat it.

Queries meet shards in blocks of about ``BLOCK_ROWS``: the rows of a block follow a copy
of the shard's tree into a task and stream past it, so a task holds one tree and one
batch of queries at a time; trees are staged in the shared folder.

Components are turned into ``floor(256 * x)``; scores are exact integers
(64-bit; doubles are used only while every product sum stays below 2^53).

Defined results: null vectors and vectors with null or non-finite components take no
part; see ``vectors`` for short vectors and repeated ids; a table without candidates gives no rows.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from armature.llm import vectors as V
from armature.llm.common import shared_folder, shuffle_partitions, stage

SHARD_ROWS = 8192
BLOCK_ROWS = 4096
LEAF = 256


class Tree:
    """KD-tree with tight boxes over integer vectors; leaves hold up to ``LEAF`` rows."""

    def __init__(self, ids, points, low, high, begin, end, kids):
        self.ids, self.points, self.low, self.high = ids, points, low, high
        self.begin, self.end, self.kids = begin, end, kids

    @classmethod
    def build(cls, ids: np.ndarray, points: np.ndarray) -> "Tree":
        order = np.argsort(ids, kind="stable")
        low, high, begin, end, kids = [], [], [], [], []

        def add(a: int, z: int) -> int:
            some = points[order[a:z]]
            me = len(low)
            low.append(some.min(axis=0))
            high.append(some.max(axis=0))
            begin.append(a)
            end.append(z)
            kids.append((-1, -1))
            return me

        todo = [add(0, len(ids))] if len(ids) else []
        while todo:
            node = todo.pop()
            a, z = begin[node], end[node]
            width = high[node] - low[node]
            if z - a <= LEAF or not width.size or not width.max() > 0:
                continue
            axis, middle = int(width.argmax()), (a + z) // 2
            part = np.argpartition(points[order[a:z], axis], middle - a)
            order[a:z] = order[a:z][part]
            kids[node] = (add(a, middle), add(middle, z))
            todo += kids[node]
        return cls(ids[order], points[order], np.array(low), np.array(high), np.array(begin), np.array(end), np.array(kids))

    def to_bytes(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, *(getattr(self, n) for n in ("ids", "points", "low", "high", "begin", "end", "kids")))
        return f.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> "Tree":
        with np.load(io.BytesIO(data)) as f:
            return cls(*(f[f"arr_{i}"] for i in range(7)))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floors: list):
        """Per query (places, scores) of at most k rows that reach its floor, by best-first descent."""
        if not len(self.ids):
            return [(np.zeros(0, np.int64), np.zeros(0, queries.dtype))] * len(queries)
        plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
        bounds = plus @ self.high.T + minus @ self.low.T        # greatest inner product inside each node's box
        out = []
        for q, me, floor, bound in zip(queries, own, floors, bounds):
            ids = np.zeros(0, np.int64)
            places, scores = ids, np.zeros(0, queries.dtype)
            heap = [(-bound[0], 0)]
            while heap:
                top, node = heapq.heappop(heap)
                if floor is not None and -top < floor:
                    break
                left, right = self.kids[node]
                if left >= 0:
                    heapq.heappush(heap, (-bound[left], left))
                    heapq.heappush(heap, (-bound[right], right))
                    continue
                a, z = self.begin[node], self.end[node]
                found = self.points[a:z] @ q
                keep = np.flatnonzero((found >= floor if floor is not None else np.ones(z - a, bool)) & (self.ids[a:z] != me))
                if not len(keep):
                    continue
                places, scores = np.concatenate((places, keep + a)), np.concatenate((scores, found[keep]))
                sel = V.best(scores, self.ids[places], k)
                places, scores = places[sel], scores[sel]
                if len(places) == k and (floor is None or scores[-1] > floor):
                    floor = scores[-1]
            out.append((places, scores))
        return out


def _integers(matrix: np.ndarray) -> np.ndarray:
    """``floor(256 x)`` as doubles while all sums of products are exact, else as 64-bit integers."""
    v = np.floor(matrix * 256)
    top = np.abs(v).max(initial=0)
    return v if top * top * max(1, v.shape[1]) < 1 << 53 else v.astype(np.int64)


def _same_kind(a: np.ndarray, b: np.ndarray):
    top = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    exact = float(top) * float(top) * max(1, a.shape[1]) < 1 << 53
    kind = np.float64 if exact else np.int64
    return a.astype(kind, copy=False), b.astype(kind, copy=False)


RESULT = "query_id long, vec_id long, score long"


def _rows(tree: Tree, query_ids, found):
    ids = [np.full(len(p), q) for q, (p, _) in zip(query_ids, found)]
    places = [p for p, _ in found]
    flat = np.concatenate(places) if places else np.zeros(0, np.int64)
    return (np.concatenate(ids).astype(np.int64) if ids else flat, tree.ids[flat] if len(flat) else flat,
            np.concatenate([s for _, s in found]).astype(np.int64) if found else flat)


def top_k(table: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score): ids divisible by ``every`` against all other rows."""
    spark = table.sparkSession
    folder = shared_folder(spark)
    rows = stage(V.usable(table), folder, "vectors")
    size = rows.count()
    width = V.dimension(rows)
    shards = max(1, -(-size // SHARD_ROWS))
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")

    def build(batches):
        def emit(number, ids, parts):
            ids, points = np.concatenate(ids), _integers(np.concatenate(parts))
            tree = Tree.build(ids, points)
            mine = np.flatnonzero(tree.ids % every == 0)
            exact = _same_kind(tree.points, tree.points)[0]
            tree.points, tree.low, tree.high = exact, tree.low.astype(exact.dtype), tree.high.astype(exact.dtype)
            found = tree.search(exact[mine], tree.ids[mine], k, [None] * len(mine))
            q, v, s = _rows(tree, tree.ids[mine], found)
            return pa.RecordBatch.from_pydict(
                {"shard": pa.array([number], pa.int32()), "tree": pa.array([tree.to_bytes()], pa.binary()),
                 "found": pa.array([[{"query_id": a, "vec_id": b, "score": c} for a, b, c in zip(q.tolist(), v.tolist(), s.tolist())]],
                                   pa.list_(pa.struct([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])))})

        number, ids, parts = None, [], []
        for batch in batches:
            which = batch.column(0).to_numpy(zero_copy_only=False)
            bid, points = batch.column(1).to_numpy(zero_copy_only=False), V.matrix(batch.column(2), width)
            for n in dict.fromkeys(which.tolist()):
                if n != number and ids:
                    yield emit(number, ids, parts)
                    ids, parts = [], []
                number = n
                ids.append(bid[which == n])
                parts.append(points[which == n])
        if ids:
            yield emit(number, ids, parts)

    parts = max(shuffle_partitions(spark), 1)
    built = (rows.select(shard.alias("shard"), "id", "v").repartition(parts, "shard").sortWithinPartitions("shard")
             .mapInArrow(build, "shard int, tree binary, found array<struct<query_id:bigint,vec_id:bigint,score:bigint>>"))
    built = stage(built, folder, "trees")
    near = built.select(F.explode("found").alias("f")).select("f.*")
    floors = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") == k)
    queries = (rows.where(F.col("id") % every == 0).select(shard.alias("home"), "id", "v")
               .join(floors.select(F.col("query_id").alias("id"), "floor"), "id", "left"))
    total = rows.where(F.col("id") % every == 0).count()
    blocks = max(1, -(-total // BLOCK_ROWS))
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")
    all_shards = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    asked = (queries.withColumn("block", block).withColumn("shard", all_shards).where("shard <> home")
             .select("shard", "block", F.lit(None).cast("binary").alias("tree"), "id", "floor", "v"))
    trees = (built.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
             .select("shard", "block", "tree", F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("floor"),
                     F.lit(None).cast("array<double>").alias("v")))
    # a tree comes before the queries of its block, which stream past it
    dealt = (trees.unionByName(asked).repartition(parts, "shard", "block")
             .sortWithinPartitions("shard", "block", F.col("id").asc_nulls_first()))

    def meet(batches):
        tree = None
        for batch in batches:
            is_tree = batch.column(3).is_null().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(is_tree | np.r_[True, is_tree[:-1]])
            for begin, end in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows]):
                if is_tree[begin]:
                    tree = Tree.from_bytes(batch.column(2)[begin].as_py())
                    continue
                q = batch.slice(begin, end - begin)
                points = _integers(V.matrix(q.column(5), width))
                tree.points, points = _same_kind(tree.points, points)
                tree.low, tree.high = tree.low.astype(points.dtype), tree.high.astype(points.dtype)
                ids = q.column(3).to_numpy(zero_copy_only=False)
                a, b, c = _rows(tree, ids, tree.search(points, ids, k, q.column(4).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, c)], names=["query_id", "vec_id", "score"])

    far = dealt.mapInArrow(meet, RESULT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (near.unionByName(far).withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


#: The same result in one statement.
ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS c
           FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
p AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_inner_product(CAST(q.c AS DOUBLE[]), CAST(c.c AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
