"""Approximate nearest neighbours by inner product on shifted Hilbert curves (operator 4).

Method: vectors get one more component that makes all norms equal (then the
largest inner product is the nearest vector).  Each of ``CURVES`` curves projects them on
``AXES`` random orthogonal directions, shifts them by a random part of the grid, and orders
them by their Hilbert key.  Spark range-partitions (curve, key), so neighbours in
key are neighbours in the files; a vector's position is its partition's offset
(one row per partition) plus its place inside.  A query's candidates are all vectors within a window of
positions around it on each curve; candidates are reranked by the exact inner product of the
original vectors, in double precision.

The window is fitted: for ``SAMPLE`` queries (least hash of the id; the bound of the sample) the exact
neighbours among all rows are found, and the window is the distance in positions within
which the share ``RECALL`` of them lies on at least one curve.  Tables with structure get narrow
windows; vectors without any (random directions) need wide ones, whatever the method.

Candidates come in blocks of consecutive positions that queries stream past, so
a task holds one block and one batch of queries; nothing is emitted per candidate but
each query's best ``k`` of a block.

Defined results: zero vectors, null vectors and vectors with null or non-finite
components take no part; see ``vectors`` for short vectors and repeated ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from armature.llm import vectors as V
from armature.llm.common import shared_folder, shuffle_partitions, stage

CURVES = 4
AXES = 8
BITS = 7
SAMPLE = 200
RECALL = 0.95
BLOCK_ROWS = 4096


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of grid cells (n, axes), after Skilling (2004); axes * bits is at most 63."""
    x = cells.astype(np.uint64).T.copy()
    n, one = len(x), np.uint64(1)
    q = one << np.uint64(bits - 1)
    while q > one:                      # undo excess work, from the top bit down
        p = q - one
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= one
    for i in range(1, n):               # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = one << np.uint64(bits - 1)
    while q > one:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - one), t)
        q >>= one
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):   # interleave
        for i in range(n):
            key = key << one | (x[i] >> np.uint64(b) & one)
    return key.astype(np.int64)


class Curves:
    """Keys of a block of vectors on every curve."""

    def __init__(self, width: int, greatest_norm: float, curves: int = CURVES, axes: int = AXES, bits: int = BITS):
        draw = np.random.default_rng(11)
        axes = min(axes, width + 1)
        self.norm, self.bits = greatest_norm, bits
        self.maps = [np.linalg.qr(draw.standard_normal((width + 1, axes)))[0] for _ in range(curves)]
        self.shifts = [draw.random(axes) for _ in range(curves)]
        self.spread = 4 / np.sqrt(width + 1)       # most coordinates of a unit vector's projection are smaller

    def __call__(self, points: np.ndarray, is_query: bool) -> list[np.ndarray]:
        norms = np.linalg.norm(points, axis=1)
        if is_query:
            full = np.hstack((points / norms[:, None], np.zeros((len(points), 1))))
        else:
            scaled = points / self.norm
            full = np.hstack((scaled, np.sqrt(np.maximum(0, 1 - (scaled ** 2).sum(axis=1)))[:, None]))
        side = 1 << self.bits
        out = []
        for m, shift in zip(self.maps, self.shifts):
            unit = (full @ m / self.spread + 1) / 2 * (side - 1) * 0.75 + shift * 0.25 * side
            out.append(hilbert_keys(np.clip(np.floor(unit), 0, side - 1), self.bits))
        return out


def _batches_of(rows: DataFrame, width: int, greatest: float, is_query: bool, query: bool):
    def run(batches):
        curves = Curves(width, greatest)
        for batch in batches:
            points = V.matrix(batch.column(1), width)
            for c, keys in enumerate(curves(points, is_query)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c] * len(keys), pa.int32()), pa.array(keys), pa.array([query] * len(keys), pa.bool_()), batch.column(0), batch.column(1)],
                    names=["curve", "key", "query", "id", "v"])

    return rows.select("id", "v").mapInArrow(run, "curve int, key long, query boolean, id long, v array<double>")


def _best_of(batches, width: int, asked_ids: np.ndarray, asked: np.ndarray, k: int):
    """Best k rows of this task for each of a few queries."""
    if not len(asked_ids):
        return
    ids = [np.zeros(0, np.int64)] * len(asked)
    scores = [np.zeros(0)] * len(asked)
    for batch in batches:
        bid = batch.column(0).to_numpy(zero_copy_only=False)
        s = V.matrix(batch.column(1), width) @ asked.T
        for i, q in enumerate(asked_ids):
            keep = np.flatnonzero(bid != q)
            keep = keep[V.best(s[keep, i], bid[keep], k)]
            i_all, s_all = np.concatenate((ids[i], bid[keep])), np.concatenate((scores[i], s[keep, i]))
            sel = V.best(s_all, i_all, k)
            ids[i], scores[i] = i_all[sel], s_all[sel]
    q = np.repeat(asked_ids, [len(i) for i in ids])
    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(np.concatenate(ids), pa.int64()),
                                      pa.array(np.concatenate(scores), pa.float64())], names=["query_id", "vec_id", "score"])


TRIPLE = "query_id long, vec_id long, score double"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)


def exact(rows: DataFrame, width: int, asked: DataFrame, k: int) -> DataFrame:
    """Brute force of at most ``SAMPLE`` queries over all rows."""
    few = asked.limit(SAMPLE).collect()
    ids = np.array([r["id"] for r in few], np.int64)
    points = V.matrix(pa.array([r["v"] for r in few], pa.list_(pa.float64())), width)
    found = rows.select("id", "v").mapInArrow(lambda batches: _best_of(batches, width, ids, points, k), TRIPLE)
    return _ranked(found, k)


def search(table: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): ids divisible by ``every`` against all other rows."""
    spark = table.sparkSession
    folder = shared_folder(spark)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = stage(V.usable(table).withColumn("norm", norm).where("norm > 0"), folder, "vectors")
    facts = rows.agg(F.count(F.lit(1)), F.max("norm"), F.max(F.size("v"))).first()
    size, greatest, width = facts[0], facts[1] or 1.0, facts[2] or 1
    asked = rows.where(F.col("id") % every == 0)
    both = _batches_of(rows, width, greatest, False, False).unionByName(_batches_of(asked, width, greatest, True, True))
    # positions: candidates before a row on its curve; a query stands before the candidates of its key
    parts = shuffle_partitions(spark)
    ordered = both.repartitionByRange(parts, "curve", "key", "id").withColumn("part", F.spark_partition_id())
    ordered = stage(ordered, folder, "ordered")
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ordered.groupBy("part", "curve").agg(F.sum(F.when(F.col("query"), 0).otherwise(1)).alias("n"))
    offsets = offsets.withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "curve", "off")
    inside = Window.partitionBy("part", "curve").orderBy("key", F.desc("query"), "id").rowsBetween(Window.unboundedPreceding, -1)
    place = F.coalesce(F.sum(F.when(F.col("query"), 0).otherwise(1)).over(inside), F.lit(0))
    placed = (ordered.withColumn("in", place).join(F.broadcast(offsets), ["part", "curve"])
              .select("curve", "query", "id", "v", (F.col("off") + F.col("in")).alias("at")))
    placed = stage(placed, folder, "placed")

    sample = asked.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("id", "v")
    truth = stage(exact(rows, width, sample, k), folder, "truth")
    where = truth.select("query_id", "vec_id").join(
        placed.where("query").select(F.col("id").alias("query_id"), "curve", F.col("at").alias("q_at")), "query_id")
    apart = where.join(placed.where("NOT query").select(F.col("id").alias("vec_id"), "curve", "at"), ["vec_id", "curve"])
    gaps = apart.groupBy("query_id", "vec_id").agg(F.min(F.abs(F.col("at") - F.col("q_at"))).alias("gap"))
    window = int(gaps.agg(F.percentile("gap", F.lit(RECALL))).first()[0] or 0) + 1

    block = min(BLOCK_ROWS, max(256, window // 2))
    last = max(0, (size - 1) // block)
    low = F.greatest(F.lit(0), F.floor((F.col("at") - window) / block))
    high = F.least(F.lit(last), F.floor((F.col("at") + window) / block))
    queries = (placed.where("query").withColumn("block", F.explode(F.sequence(low, high)))
               .select("curve", "block", F.lit(True).alias("query"), "id", "v"))
    stock = placed.where("NOT query").select("curve", F.floor(F.col("at") / block).alias("block"), "query", "id", "v")
    dealt = stock.unionByName(queries).repartition(parts, "curve", "block").sortWithinPartitions("curve", "block", "query")

    def meet(batches):
        key, ids, points = None, [], []
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64) << 40 | batch.column(1).to_numpy(zero_copy_only=False)
            is_query = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (is_query[1:] != is_query[:-1])])
            for a, z in zip(cuts, np.r_[cuts[1:], len(keys)]):
                if keys[a] != key:
                    key, ids, points = keys[a], [], []
                some, vs = batch.column(3).to_numpy(zero_copy_only=False)[a:z], V.matrix(batch.column(4).slice(int(a), int(z - a)), width)
                if not is_query[a]:
                    ids.append(some)
                    points.append(vs)
                    continue
                if not ids:
                    continue
                ids, points = [np.concatenate(ids)], [np.concatenate(points)]
                got = [[], [], []]
                for at in range(0, len(some), 256):
                    scores = vs[at:at + 256] @ points[0].T
                    scores[some[at:at + 256, None] == ids[0]] = -np.inf
                    for q, row in zip(some[at:at + 256], scores):
                        sel = V.best(row, ids[0], k)
                        sel = sel[row[sel] > -np.inf]
                        got[0].append(np.full(len(sel), q))
                        got[1].append(ids[0][sel])
                        got[2].append(sel)
                q, v, sel = (np.concatenate(g) for g in got)
                # scores of the winners again, one product at a time, so that equal vectors score equally
                at = np.searchsorted(some, q, sorter=np.argsort(some, kind="stable"))
                own = vs[np.argsort(some, kind="stable")[at]]
                exact_score = np.einsum("ij,ij->i", own, points[0][sel])
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(exact_score)],
                                                 names=["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(meet, TRIPLE).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")
