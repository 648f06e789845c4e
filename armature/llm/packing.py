"""Mixture-controlled packing (operator 5).

Method: deficit round-robin over source queues.  Every source has a target rate
(by default its share of the corpus; ``weights`` sets others).  At position x of
the packed stream its deficit is ``rate * x - tokens served``.  A source is due
when its deficit reaches its next burst (``burst`` tokens of the document at the
head of its queue, or the rest of it), and sources are visited in the order in
which they fall due.  Windows of ``window`` tokens are cut from the stream, so
each is filled to the target within a burst per source, and only the very last
window can be short.

Scale: the stream is cut into lanes of ``lane_tokens``.  The target also says how
many tokens of each source come before a lane (``rate * x``, rounded down: the
deficit carried over is below one token), so a lane owns one stretch of every
queue and lanes run in parallel; the open window carries from lane to lane by
its position.  A document's place in its queue is a prefix sum over (task,
source) totals plus the running sum inside its task.  A source that holds a third of
the rows is spread over all lanes like any other.

Defined results: null text counts as empty and holds just the end id; a null
source is a source of its own; rows that repeat an id are separate documents.
Without documents there are no pieces.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from armature.llm import tokens as K
from armature.llm.common import id_key, id_value, shared_folder, shuffle_partitions, stage, text_bytes

PIECES = "doc_id long, source string, start long, ids binary, doc_tokens long, sequence_id long, offset long"
MOST_WEIGHTED_SOURCES = 1000


def encode(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(k, source, task, before, n, width, ids): ``before`` counts the source's tokens earlier in the same task."""

    def run(batches):
        from pyspark import TaskContext
        task = TaskContext.get().partitionId()
        encoder = K.encoder(K.LibraryBpe, tokenizer)
        width = 4 if max(encoder.engine.lib.get_vocab_size(), end_id + 1) > 1 << 16 else 2
        end = end_id.to_bytes(4, "little")
        sums: dict[str | None, int] = {}
        for part in K.row_slices(batches, encodes=True):
            arrays = [np.frombuffer(encoder.encode_bytes(t) + end, "<u4") for t in part.column(2).to_pylist()]
            before = []
            for source, a in zip(part.column(1).to_pylist(), arrays):
                before.append(sums.get(source, 0))
                sums[source] = before[-1] + len(a)
            n = len(arrays)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([task] * n, pa.int64()), pa.array(before, pa.int64()),
                 pa.array([len(a) for a in arrays], pa.int64()), pa.array([width] * n, pa.int32()),
                 pa.array([a.astype(f"<u{width}").tobytes() for a in arrays], pa.binary())],
                names=["k", "source", "task", "before", "n", "width", "ids"])

    rows = docs.select(id_key().alias("k"), F.col("source").cast("string").alias("source"), text_bytes().alias("text"))
    return rows.mapInArrow(run, "k long, source string, task long, before long, n long, width int, ids binary")


def phases(totals: dict[str | None, int], weights: dict[str | None, float]) -> list[tuple]:
    """(source, served0, served1, x0, rate): each source's linear pieces; when a queue ends, the others share its rate."""
    left = {s: float(n) for s, n in totals.items() if n}
    weight = {s: max(float(weights.get(s, 0.0)), 1e-9) for s in left}
    served, x, out = dict.fromkeys(left, 0.0), 0.0, []
    while left:
        whole = sum(weight[s] for s in left)
        rate = {s: weight[s] / whole for s in left}
        step = min(left[s] / rate[s] for s in left)
        for s in list(left):
            last = left[s] <= step * rate[s] * (1 + 1e-12)
            upto = float(totals[s]) if last else served[s] + step * rate[s]
            out.append((s, served[s], upto, x, rate[s]))
            served[s] = upto
            left[s] -= step * rate[s]
            if last:
                del left[s]
        x += step
    return out


def _before(df: DataFrame, index: str, value: str) -> DataFrame:
    """(index, before): sum of ``value`` over smaller ``index``, in two levels so that no window spans all rows."""
    inside = Window.partitionBy("_b").orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)   # one row per 4096
    d = df.withColumn("_b", F.floor(F.col(index) / 4096))
    tops = d.groupBy("_b").agg(F.sum(value).alias("_t"))
    tops = tops.select("_b", F.coalesce(F.sum("_t").over(across), F.lit(0)).alias("_o"))
    inner = d.withColumn("_i", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return inner.join(tops, "_b").select(index, (F.col("_o") + F.col("_i")).alias("before"))


def serve(queues: list[list[int]], base: int, window: int, burst: int) -> list[list[int]]:
    """One lane: [queue, item, start in the item, length] in stream order from position ``base``.

    ``queues``: the lengths of each source's items.  A piece ends at a window's end, at
    its item's end, or after a burst that leaves at least a quarter burst.
    """
    out: list[list[int]] = []
    total = sum(map(sum, queues))
    rates = [sum(q) / total if total else 0.0 for q in queues]
    head, done, got = [0] * len(queues), [0] * len(queues), [0] * len(queues)
    due: list[tuple[float, int]] = []

    def size(s: int) -> int:
        rest = queues[s][head[s]] - done[s]
        return rest if rest < burst + burst // 4 else burst

    def visit(s: int) -> None:
        if head[s] < len(queues[s]):
            heapq.heappush(due, ((got[s] + size(s)) / rates[s], s))

    for s in range(len(queues)):
        visit(s)
    x = base
    while due:
        _, s = heapq.heappop(due)
        left = size(s)
        while left:
            take = min(left, window - x % window)
            if out and x % window and out[-1][:2] == [s, head[s]] and out[-1][2] + out[-1][3] == done[s]:
                out[-1][3] += take
            else:
                out.append([s, head[s], done[s], take])
            x += take
            got[s] += take
            done[s] += take
            left -= take
        if done[s] == queues[s][head[s]]:
            head[s] += 1
            done[s] = 0
        visit(s)
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = 2048, burst: int = 256,
         lane_tokens: int = 2 << 20, weights: dict[str | None, float] | None = None) -> DataFrame:
    """Pieces of all documents (``PIECES``): ``ids`` are little-endian unsigned 32-bit.

    ``weights``: target shares by source, for at most ``MOST_WEIGHTED_SOURCES`` sources; a queue that
    ends leaves its part of the windows to the others.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    encoded = stage(encode(docs, tokenizer, end_id), folder, "ids")
    cells = stage(encoded.groupBy("task", "source").agg(F.sum("n").alias("n")), folder, "cells")
    totals = cells.groupBy("source").agg(F.sum("n").alias("n"))
    if weights:
        known = {r["source"]: r["n"] for r in totals.limit(MOST_WEIGHTED_SOURCES + 1).collect()}
        if len(known) > MOST_WEIGHTED_SOURCES:
            raise ValueError(f"weights are for at most {MOST_WEIGHTED_SOURCES} sources")
        pieces = spark.createDataFrame(phases(known, weights), "source string, lo double, hi double, x0 double, rate double")
    else:
        total = float(cells.agg(F.sum("n")).first()[0] or 1)
        pieces = totals.select("source", F.lit(0.0).alias("lo"), F.col("n").cast("double").alias("hi"),
                               F.lit(0.0).alias("x0"), (F.col("n") / total).alias("rate"))
    earlier = Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.withColumn("off", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    placed = (encoded.alias("e")
              .join(offsets.alias("o"), (F.col("e.task") == F.col("o.task")) & F.col("e.source").eqNullSafe(F.col("o.source")))
              .join(pieces.alias("p"), F.col("e.source").eqNullSafe(F.col("p.source")))
              .select("e.k", "e.source", "e.n", "e.width", "e.ids", "p.x0", "p.rate", "p.lo", "p.hi",
                      (F.col("o.off") + F.col("e.before")).alias("y")))
    # the document's part in this linear piece of its queue, and the lanes which that part crosses
    lower, upper = F.ceil("lo"), F.ceil("hi")
    lane_of = lambda y: F.floor((F.col("x0") + (y - F.col("lo")) / F.col("rate")) / lane_tokens)
    edge = lambda lane: F.floor(F.col("lo") + F.col("rate") * (lane * F.lit(float(lane_tokens)) - F.col("x0")))
    part = (placed.withColumn("a", F.greatest("y", lower)).withColumn("z", F.least(F.col("y") + F.col("n"), upper))
            .where("a < z")
            .withColumn("lane", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), lane_of(F.col("a")) - 1), lane_of(F.col("z")) + 1)))
            .withColumn("a", F.when(F.col("lane") == 0, F.col("a")).otherwise(F.greatest("a", edge(F.col("lane")))))
            .withColumn("z", F.least("z", edge(F.col("lane") + 1)))
            .where("a < z")
            .withColumn("start", F.col("a") - F.col("y")).withColumn("size", F.col("z") - F.col("a")))
    bases = _before(part.groupBy("lane").agg(F.sum("size").alias("size")), "lane", "size")
    slices = part.select("lane", F.lit(1).alias("kind"), "source", "a", "k", "n", "start", "width",
                         F.substring("ids", (F.col("start") * F.col("width") + 1).cast("int"),
                                     (F.col("size") * F.col("width")).cast("int")).alias("ids"))
    zero = F.lit(0).cast("long")
    heads = bases.select("lane", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("source"), F.col("before").alias("a"),
                         zero.alias("k"), zero.alias("n"), zero.alias("start"), F.lit(2).alias("width"),
                         F.lit(None).cast("binary").alias("ids"))
    dealt = (slices.unionByName(heads).repartition(shuffle_partitions(spark), "lane")
             .sortWithinPartitions("lane", "kind", "source", "a", "k"))

    def run(batches):
        def lane_pieces(base, rows):
            queues: dict[str | None, list] = {}
            for row in rows:
                queues.setdefault(row[0], []).append(row)
            items = list(queues.values())
            x, out = base, []
            for s, i, at, size in serve([[len(r[5]) // r[4] for r in q] for q in items], base, window, burst):
                source, k, n, start, width, ids = items[s][i]
                ids = np.frombuffer(ids, f"<u{width}", size, at * width)
                out.append((k, source, start + at, ids.astype("<u4").tobytes(), n, x // window, x % window))
                x += size
            for at in range(0, len(out), 20_000):
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out[at:at + 20_000]), kinds)],
                    names=["k", "source", "start", "ids", "doc_tokens", "sequence_id", "offset"])

        base, held = 0, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    yield from lane_pieces(base, held)
                    base, held = row["a"], []
                else:
                    held.append(tuple(row[c] for c in ("source", "k", "n", "start", "width", "ids")))
        yield from lane_pieces(base, held)

    out = dealt.mapInArrow(run, PIECES.replace("doc_id", "k"))
    return out.select(id_value("k").alias("doc_id"), "source", "start", "ids", "doc_tokens", "sequence_id", "offset")


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")
