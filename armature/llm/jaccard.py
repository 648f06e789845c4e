"""N-gram Jaccard join (operator 13).

Method: blocked sparse matrix product.  Rows are distinct documents (equal sets are one row), columns are word
n-grams, and two rows link if their product, the number of shared columns, reaches
``need(a, b) = ceil(percent * (a + b) / (100 + percent))`` for sizes a and b.  Bounds that follow from the sizes
alone discard rows and pairs before and while counts accumulate:

1. ``peel``: of its columns in hash order, a row shares with any linked row at least ``ell(size)`` among the first
   ``size - ceil(percent * size / 100) + ell(size)``.  Rows that have fewer such columns in common with all others
   together have no link.  This is a count over part of the columns and drops most documents.
2. Among the rows left, columns held by one row go, and rows left with too few columns.  Of the rest in order of rarity a
   row keeps ``columns left - ceil(percent * size / 100) + 1`` as its leading columns: linked rows share one of them.
3. Blocks: the rows that share a leading column, in bands of size.  A block's pivot p is its most typical row, the one
   with the fewest columns of its own; each of its rows is multiplied with p.  That leaves what the row adds to p
   (``plus``) and what it lacks (``minus``).  Links with pivots give components.
4. Within a block, ``|x & y| = |p| - |minus_x| - |minus_y| + |minus_x & minus_y| + |plus_x & plus_y|``: a sparse product of
   differences, taken only between rows of different components.  As ``|x & y| <= |x & p| + |plus_x & plus_y|``, such
   rows either share as many columns with p as a link needs, or have one of the rarest additions
   of x in common (as many as leave fewer than the missing number); pairs below these bounds are never formed.

So every pair of a block that could join two components is decided, and a large group of copies costs one product a row.

Scale: all counts are map-side aggregates; joins are shuffle joins whose crowded columns and pivots adaptive execution
splits.  Sets are read again from the texts where they are needed, so only rows that passed the peel are ever staged.

Defined results: null or blank text has an empty set and is linked with nothing; a null id is the smallest and stays
null; rows that repeat an id are separate documents; repeated rows get equal results; without documents there are no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armature.llm import tokens as K
from armature.llm.common import discard, id_key, id_value, release, shared_folder, small_ids, stage, text_bytes
from armature.llm.graph import components
from armature.llm.minmax import Shingler, _node


def _least(n: Column, percent: int) -> Column:
    """Fewest columns that a row of size n shares with a linked row."""
    return F.floor((n * percent + 99) / 100).cast("long")


def _need(a: Column, b: Column, percent: int) -> Column:
    """Fewest shared columns of linked rows of sizes a and b (whole numbers throughout)."""
    return F.floor(((a + b) * percent + 99 + percent) / (100 + percent)).cast("long")


def _ell(n: Column, percent: int) -> Column:
    return F.floor((n * (100 - percent) + 99) / 100).cast("long")


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """(k, node, n): ``node`` names the set of a row's n-grams, ``n`` is its size."""

    def run(batches):
        shingler = Shingler(words)
        for part in K.row_slices(batches):
            sets = [shingler(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([_node(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())],
                names=["k", "node", "n"])

    return docs.select(id_key().alias("k"), text_bytes().alias("text")).mapInArrow(run, "k long, node binary, n long")


def sets(docs: DataFrame, wanted: DataFrame, words: int, percent: int | None = None) -> DataFrame:
    """(x, n, cols) of the wanted (k, node, x): columns in hash order, with ``percent`` only those that ``peel`` reads.

    A document that is repeated as a whole row comes as often.
    """

    def run(batches):
        shingler = Shingler(words)
        for part in K.row_slices(batches):
            out = []
            for x, node, text in zip(*(part.column(j).to_pylist() for j in range(3))):
                s = shingler(text)
                if _node(s) == node:
                    n = len(s)
                    some = n if percent is None else n - (n * percent + 99) // 100 + (n * (100 - percent) + 99) // 100
                    out.append((x, n, s[:some].view(np.int64)))
            ends = np.cumsum([0] + [len(s) for _, _, s in out]).astype(np.int32)
            values = np.concatenate([np.zeros(0, np.int64), *[s for _, _, s in out]])
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["x", "n", "cols"])

    rows = docs.select(id_key().alias("k"), text_bytes().alias("text")).join(wanted, "k").select("x", "node", "text")
    return rows.mapInArrow(run, "x long, n long, cols array<long>")


def peel(docs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """The rows of ``nodes`` (x, k, node, n) that may have a link."""
    entries = sets(docs, small_ids(nodes.select("k", "node", "x")), words, percent).select("x", F.explode("cols").alias("g"))
    held = entries.groupBy("g").agg(F.min("x").alias("x"), F.max("x").alias("z"))
    alone = held.where("x = z").groupBy("x").agg(F.count(F.lit(1)).alias("alone"))
    n = F.col("n")
    read = n - _least(n, percent) + _ell(n, percent)
    return (nodes.join(alone, "x", "left")
            .where(read - F.coalesce("alone", F.lit(0)) >= _ell(_least(n, percent), percent)).drop("alone"))


def incidence(full: DataFrame, percent: int) -> DataFrame:
    """(x, n, cols): columns held by several rows, rarest first, of rows with enough of them."""
    entries = full.select("x", "n", F.explode("cols").alias("g"))
    df = entries.groupBy("g").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    rows = (entries.join(df, "g").groupBy("x", "n")
            .agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("cols")))
    return rows.select("x", "n", F.col("cols.g").alias("cols")).where(F.size("cols") >= _least(F.col("n"), percent))


def pivots(rows: DataFrame, percent: int) -> DataFrame:
    """(x, p): the pivots of the blocks that a row is in, other than itself."""
    width = -math.log(percent / 100 - 0.001)        # a little wide, so that linked rows are at most one band apart
    band = F.floor(F.log("n") / width).cast("int")
    lead = F.slice("cols", 1, (F.size("cols") - _least(F.col("n"), percent) + 1).cast("int"))
    spread = rows.select("x", (F.col("n") - F.size("cols")).alias("alone"), F.explode(F.array(band, band + 1)).alias("band"), lead.alias("lead")) \
        .select("x", "alone", "band", F.explode("lead").alias("g"))
    heads = (spread.groupBy("g", "band").agg(F.min(F.struct("alone", "x"))["x"].alias("p"), F.count(F.lit(1)).alias("size"))
             .where("size > 1").drop("size"))
    return spread.join(heads, ["g", "band"]).where("x <> p").select("x", "p").distinct()


def products(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(x, p, n, n_p, size_p, plus, minus) of every pair: sizes, columns of p, what x adds to them and what it lacks."""

    def run(batches):
        for part in K.row_slices(batches):
            plus, minus = [], []
            for a, b in zip(part.column("a"), part.column("b")):
                a, b = a.values.to_numpy(), b.values.to_numpy()
                both = np.concatenate((a, b))
                order = np.argsort(both, kind="stable")
                both = both[order]
                single = np.ones(len(both), bool)
                same = both[1:] == both[:-1]
                single[1:] &= ~same
                single[:-1] &= ~same
                own, both = order[single] < len(a), both[single]
                plus.append(both[own])
                minus.append(both[~own])
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0] + list(map(len, d))).astype(np.int32)),
                                              pa.array(np.concatenate([np.zeros(0, np.int64), *d]))) for d in (plus, minus)]
            yield pa.RecordBatch.from_arrays([*map(part.column, ("x", "p", "n", "n_p", "size_p")), *lists],
                                             names=["x", "p", "n", "n_p", "size_p", "plus", "minus"])

    pivot = rows.select(F.col("x").alias("p"), F.col("n").alias("n_p"), F.size("cols").cast("long").alias("size_p"), F.col("cols").alias("b"))
    joined = pairs.join(rows.select("x", "n", F.col("cols").alias("a")), "x").join(pivot, "p")
    return joined.select("x", "p", "n", "n_p", "size_p", "a", "b").mapInArrow(
        run, "x long, p long, n long, n_p long, size_p long, plus array<long>, minus array<long>")


def block_links(made: DataFrame, stars: DataFrame, percent: int, folder: str) -> DataFrame:
    """(u, v): links between rows of a block that are in different components."""
    roots = stars.select(F.col("u").alias("x"), F.col("v").alias("root"))
    none = F.array().cast("array<long>")
    own = made.select(F.col("p").alias("x"), "p", F.col("n_p").alias("n"), "n_p", "size_p", none.alias("plus"),
                      none.alias("minus")).dropDuplicates(["x"])
    block = made.unionByName(own).join(roots, "x", "left").withColumn("root", F.coalesce("root", "x"))
    mixed = (block.groupBy("p", "root").agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("least"))
             .groupBy("p").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("rows", "root"))["root"].alias("main"), F.min("least").alias("least"))
             .where("roots > 1").drop("roots"))
    block = stage(block.join(mixed, "p").withColumn("meet", F.col("size_p") - F.size("minus")), folder, "block")
    # how many additions x must share with its easiest partner, the smallest of the block that fits it
    bound = _need(F.col("n"), F.greatest("least", _least(F.col("n"), percent)), percent) - F.col("meet")
    x = block.where("root <> main").select("p", "x", F.col("root").alias("root_x"), F.col("n").alias("n_x"), F.col("meet").alias("meet_x"),
                                           "plus", bound.alias("bound"))
    y = block.select("p", F.col("x").alias("y"), F.col("root").alias("root_y"), F.col("n").alias("n_y"), F.col("meet").alias("meet_y"))
    fits = (F.col("root_x") != F.col("root_y")) & (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y"))
    asked = _need(F.col("n_x"), F.col("n_y"), percent)
    near = x.where("bound <= 0").drop("plus", "bound").join(y, "p").where(fits & (F.least("meet_x", "meet_y") >= asked)).select("p", "x", "y")

    columns = block.select("p", F.col("x").alias("y"), F.col("root").alias("root_y"), F.col("n").alias("n_y"), F.explode("plus").alias("g"))
    common = columns.groupBy("p", "g").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    some = F.size("plus") - F.greatest("bound", F.lit(1)) + 1
    lead = x.where(some > 0).select("p", "x", "root_x", "n_x", some.alias("some"), F.explode("plus").alias("g")).join(common, ["p", "g"], "left")
    place = F.row_number().over(Window.partitionBy("p", "x").orderBy(F.coalesce("df", F.lit(1)), "g"))
    lead = lead.withColumn("place", place).where("place <= some AND df > 1").select("p", "g", "x", "root_x", "n_x")
    alike = lead.alias("l").join(columns.alias("c"), (F.col("l.p") == F.col("c.p")) & (F.col("l.g") == F.col("c.g")) & fits) \
        .select("l.p", "x", "y")
    met = stage(near.unionByName(alike).distinct(), folder, "met")
    sides = block.select("p", "x", "n", "size_p", "plus", "minus")
    full = met.join(sides, ["p", "x"]).join(sides.select("p", *[F.col(c).alias(f"{c}_y") for c in ("x", "n", "plus", "minus")]).withColumnRenamed("x_y", "y"), ["p", "y"])
    both = (F.col("size_p") - F.size("minus") - F.size("minus_y") + F.size(F.array_intersect("minus", "minus_y"))
            + F.size(F.array_intersect("plus", "plus_y")))
    return full.where(both >= _need(F.col("n"), F.col("n_y"), percent)).select(F.col("x").alias("u"), F.col("y").alias("v")).distinct()


def join(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row: its set's size, the smallest id reachable by links."""
    spark = docs.sparkSession
    folder, percent = shared_folder(spark), round(100 * threshold)
    sketched = stage(sketch(docs, words), folder, "sketch")
    nodes = stage(sketched.where("n > 0").groupBy("node").agg(F.min("k").alias("k"), F.min("n").alias("n"))
                  .withColumn("x", F.monotonically_increasing_id()), folder, "nodes")
    alive = stage(peel(docs, nodes, words, percent), folder, "alive")
    release(spark)
    full = stage(sets(docs, small_ids(alive.select("k", "node", "x")), words).dropDuplicates(["x"]), folder, "sets")
    rows = stage(incidence(full, percent), folder, "rows")
    discard(spark, folder, "sets")
    release(spark)
    made = stage(products(pivots(rows, percent), rows), folder, "products")
    discard(spark, folder, "rows")
    release(spark)
    linked = made.where(F.col("size_p") - F.size("minus") >= _need(F.col("n"), F.col("n_p"), percent))
    stars = components(linked.select(F.col("x").alias("u"), F.col("p").alias("v")), folder, "stars")
    more = stage(block_links(made, stars, percent, folder), folder, "more")
    if not more.isEmpty():
        stars = components(stars.unionByName(more), folder, "all-stars")
    rooted = nodes.select("node", "k", "x").join(stars.select(F.col("u").alias("x"), F.col("v").alias("root")), "x", "left") \
        .withColumn("root", F.coalesce("root", "x"))
    least = rooted.groupBy("root").agg(F.min("k").alias("component"))
    named = stage(rooted.join(least, "root").select("node", "component"), folder, "named")
    discard(spark, folder, "nodes", "alive", "products", "block", "met", "more")
    release(spark)
    found = sketched.join(named, "node", "left").withColumn("c", F.coalesce("component", "k"))
    return found.select(id_value("k").alias("doc_id"), F.col("n").alias("n_shingles"), id_value("c").alias("component_id"))


#: ``join(docs, 4, 0.85)`` in one statement.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3])) END AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
l AS (SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id
      AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
      GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (min(a.n) + min(b.n) - count(*))),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id AS u, doc_id AS root FROM s UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.u WHERE r.root < e.v),
c AS (SELECT u, min(root) AS component_id FROM r GROUP BY u)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id FROM s JOIN c ON s.doc_id = c.u
"""
