"""Near-duplicate groups by min-max hashing (operator 1).

Method: a document's set holds 64-bit hashes of its word shingles.  Under each of
``PERMUTATIONS`` hash functions both the least and the greatest value are kept,
so a signature has twice as many values as hash evaluations, and each value
agrees for two sets with a probability equal to their similarity.  Bands of
``ROWS`` values (three permutations each) are the buckets: two sets with a
similarity of 0.8 miss all 42 buckets with a probability below 3e-6, and sets
that share a few frequent pairs of words hardly ever meet.

Confirmation: every link is confirmed on the full sets
(``100 * |A & B| >= 100 * threshold * |A | B|``).  Pairs are not expanded within a bucket:

* documents with equal sets are one node;
* every node x of a bucket is compared with the bucket's least node h, which leaves x's
  difference from h: what x adds (``plus``) and what it lacks (``minus``).  Links give components;
* two nodes x, y of a bucket in different components can still be linked.  The nodes around a least node that has
  several components get a second, finer signature: ``FINE_BANDS`` bands of ``FINE_ROWS`` values from permutations of its
  own.  Two sets with a similarity of 0.8 miss all 240 with a probability below 4e-8 (1.1e-5 for 4 of 5 shingles, whose
  least and greatest values depend on each other; the first 42 miss those in 4e-5), sets that share half of their
  shingles (parts of one source, say) meet in them 40 times less often than in the first.  x runs over the nodes
  of a fine bucket outside its largest component.  Each node has a parity sketch: a shingle flips one
  of ``PARITY`` bits, so two sets differ in at least as many shingles as their sketches do in bits, and pairs whose
  sketches differ too much are not formed.  The rest is confirmed on the full sets.

So every pair of a fine bucket that could join two components is decided, and far copies that resemble
a big group without being linked to it cost few pairs.

Scale: a bucket's least node is a map-side minimum; buckets join by shuffle
joins that split hot keys; sets are computed only for nodes that share a bucket, and kept in a
table bucketed by node, so a test moves one set per pair.

Defined results: null or blank text has an empty set and is linked with nothing,
not even with another empty text; a null id is the smallest; rows that share an id
count as one document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armature.llm import tokens as K
from armature.llm.common import bucketed, discard, id_key, id_value, release, shared_folder, small_ids, stage, text_bytes
from armature.llm.graph import components

PERMUTATIONS = 126
ROWS = 6
FINE_BANDS = 240
FINE_ROWS = 12
PARITY = 1024
_WORDS = 200_000


class _WordHashes(dict):
    """Hashes of recently used words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) > _WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Shingler:
    def __init__(self, words: int):
        self.words, self.hashes = words, _WordHashes()

    def __call__(self, text: bytes) -> np.ndarray:
        """Sorted distinct shingle hashes; bytes are lower-cased A-Z and split at ASCII white space only."""
        found = text.lower().split()
        if not found:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.hashes.__getitem__, found), np.uint64, len(found))
        size = min(self.words, len(h))
        n = len(h) - size + 1
        out = np.full(n, size, np.uint64)
        for j in range(size):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j:j + n])
        return np.unique(out)


class MinMax:
    def __init__(self, permutations: int = PERMUTATIONS, rows: int = ROWS, seed: int = 20240229):
        draw = np.random.default_rng(seed)
        self.xor = draw.integers(0, 1 << 63, permutations, dtype=np.uint64)
        self.mul = draw.integers(0, 1 << 63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.rows, self.bands = rows, 2 * permutations // rows
        self.weights = draw.integers(0, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def signature(self, values: np.ndarray) -> np.ndarray:
        """Least and greatest value under each permutation, side by side."""
        low = np.full(len(self.xor), ~np.uint64(0))
        high = np.zeros(len(self.xor), np.uint64)
        for at in range(0, len(values), 512):
            x = (values[at:at + 512, None] ^ self.xor) * self.mul
            np.minimum(low, x.min(axis=0), out=low)
            np.maximum(high, x.max(axis=0), out=high)
        return np.stack((low, high), axis=1).ravel()

    def keys(self, signature: np.ndarray) -> np.ndarray:
        """One 64-bit bucket key per band, the band's number mixed in."""
        x = _mix(signature).reshape(self.bands, self.rows) * self.weights
        return _mix(x.sum(axis=1, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64)).view(np.int64)


def _node(values: np.ndarray) -> bytes:
    import xxhash
    return xxhash.xxh3_128_digest(values.tobytes())


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """(k, node, n, buckets): ``node`` names the set, ``n`` is its size."""

    def run(batches):
        shingler, minmax = Shingler(words), MinMax()
        for part in K.row_slices(batches):
            sets = [shingler(t) for t in part.column(1).to_pylist()]
            keys = [minmax.keys(minmax.signature(s)).tolist() if len(s) else [] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([_node(s) for s in sets], pa.binary()),
                 pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["k", "node", "n", "buckets"])

    rows = docs.select(id_key().alias("k"), text_bytes().alias("text"))
    return rows.mapInArrow(run, "k long, node binary, n long, buckets array<long>")


def _full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, members) of the wanted (k, node)."""

    def run(batches):
        shingler = Shingler(words)
        for part in K.row_slices(batches):
            nodes, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            sets = [shingler(t) for t in texts]
            found = [(n, s.tobytes()) for n, s in zip(nodes, sets) if _node(s) == n]
            yield pa.RecordBatch.from_arrays(
                [pa.array([n for n, _ in found], pa.binary()), pa.array([s for _, s in found], pa.binary())],
                names=["node", "members"])

    rows = docs.select(id_key().alias("k"), text_bytes().alias("text"))
    return rows.join(small_ids(wanted), "k").select("node", "text").mapInArrow(run, "node binary, members binary")


COMPARED = "u binary, v binary, nu long, nv long, plus array<long>, minus array<long>"


def _compared(pairs: DataFrame, table: str) -> DataFrame:
    """(u, v, nu, nv, plus, minus): sizes, what u adds to v and what it lacks of v."""

    def run(batches):
        for part in K.row_slices(batches):
            nu, nv, plus, minus = [], [], [], []
            for a, b in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                nu.append(len(a))
                nv.append(len(b))
                plus.append(np.setdiff1d(a, b, assume_unique=True).view(np.int64))
                minus.append(np.setdiff1d(b, a, assume_unique=True).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(nu, pa.int64()), pa.array(nv, pa.int64()),
                 pa.array(plus, pa.list_(pa.int64())), pa.array(minus, pa.list_(pa.int64()))],
                names=["u", "v", "nu", "nv", "plus", "minus"])

    sets = pairs.sparkSession.table(table)
    half = pairs.join(sets.select(F.col("node").alias("u"), F.col("members").alias("a")).hint("merge"), "u")
    both = half.join(sets.select(F.col("node").alias("v"), F.col("members").alias("b")).hint("merge"), "v")
    return both.select("u", "v", "a", "b").mapInArrow(run, COMPARED)


def _linked(both, a, b, percent: int):
    """Whether sets of sizes a and b that share ``both`` members are similar enough."""
    return 100 * both >= percent * (a + b - both)


def _parity(values: np.ndarray) -> list[int]:
    """``PARITY`` bits, each the parity of the members that fall on it."""
    at = (_mix(values * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(PARITY)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=PARITY) & 1).astype(np.uint8)).view(np.int64).tolist()


def _fine(nodes: DataFrame, table: str) -> DataFrame:
    """(node, root, n, odd, buckets) of the nodes (node, root): parity sketch and fine buckets."""

    def run(batches):
        minmax, last = MinMax(FINE_BANDS * FINE_ROWS // 2, FINE_ROWS, 20240301), None
        for part in K.row_slices(batches):
            names = part.column(0).to_pylist()
            # the merge join sorts by node, so rows of a document that is repeated as a whole are neighbours
            part = part.filter(pa.array([a != b for a, b in zip(names, [last, *names])], pa.bool_()))
            last = names[-1] if names else last
            sets = [np.frombuffer(m, np.uint64) for m in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([_parity(s) for s in sets], pa.list_(pa.int64())),
                 pa.array([minmax.keys(minmax.signature(s)).tolist() for s in sets], pa.list_(pa.int64()))],
                names=["node", "root", "n", "odd", "buckets"])

    sets = nodes.sparkSession.table(table).hint("merge")
    return sets.join(nodes, "node").select("node", "root", "members").mapInArrow(
        run, "node binary, root binary, n long, odd array<long>, buckets array<long>")


def _further_links(compared: DataFrame, stars: DataFrame, table: str, percent: int, folder: str) -> DataFrame:
    """(u, v): links between nodes of different components that were compared with the same node."""
    roots = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    around = (compared.select(F.col("u").alias("node"), "v").unionByName(compared.select(F.col("v").alias("node"), "v").distinct())
              .join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    several = F.min("root") != F.max("root")
    mixed = around.groupBy("v").agg(several.alias("several")).where("several").select("v")
    fine = stage(_fine(around.join(mixed, "v").select("node", "root").distinct(), table), folder, "fine")
    spread = fine.select("node", "root", F.explode("buckets").alias("b"))
    main = (spread.groupBy("b", "root").agg(F.count(F.lit(1)).alias("size")).groupBy("b")
            .agg(several.alias("several"), F.max(F.struct("size", "root"))["root"].alias("main")).where("several").select("b", "main"))
    # only the few nodes outside a bucket's largest component are looked up; all others meet them straight from ``fine``
    outside = spread.join(main, "b").where("root <> main").join(fine.select("node", "n", "odd"), "node")
    x = stage(outside.select("b", "main", *[F.col(c).alias(f"x_{c}") for c in ("node", "root", "n", "odd")]), folder, "outside")
    y = fine.select(*[F.col(c).alias(f"y_{c}") for c in ("node", "root", "n", "odd")], F.explode("buckets").alias("b"))
    flipped = sum((F.bit_count(F.col("x_odd")[i].bitwiseXOR(F.col("y_odd")[i])) for i in range(PARITY // 64)), F.lit(0))
    pairs = (x.join(y, "b").where("x_root <> y_root").where((F.col("y_root") == F.col("main")) | (F.col("x_node") < F.col("y_node")))
             .where(100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n"))
             .where((100 + percent) * flipped <= (100 - percent) * (F.col("x_n") + F.col("y_n"))))
    further = stage(pairs.select(F.col("x_node").alias("u"), F.col("y_node").alias("v")).distinct(), folder, "further")
    return _compared(further, table).where(_linked(F.col("nu") - F.size("plus"), F.col("nu"), F.col("nv"), percent)).select("u", "v")


def groups(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """(k, n, component): each row's id key, set size and the smallest id key of its group."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    percent = round(100 * threshold)
    sketched = stage(sketch(docs, words), folder, "sketch")
    nodes = stage(sketched.where("n > 0").groupBy("node").agg(F.min("k").alias("k"), F.min("buckets").alias("buckets")), folder, "nodes")
    spread = nodes.select("node", "k", F.explode("buckets").alias("b"))
    heads = (spread.groupBy("b").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("k", "node")).alias("head"))
             .where("size > 1").select("b", F.col("head.node").alias("v")))
    pairs = stage(spread.join(heads, "b").where("node <> v").select(F.col("node").alias("u"), "v").distinct(), folder, "pairs")
    release(spark)
    shared = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    wanted = stage(nodes.select("k", "node").join(shared, "node"), folder, "wanted")
    table = bucketed(_full_sets(docs, wanted, words), "node")
    release(spark)

    compared = stage(_compared(pairs, table), folder, "compared")
    links = compared.where(_linked(F.col("nu") - F.size("plus"), F.col("nu"), F.col("nv"), percent)).select("u", "v")
    stars = components(links, folder, "stars")
    more = stage(_further_links(compared, stars, table, percent, folder), folder, "more")
    spark.sql(f"DROP TABLE {table}")
    release(spark)
    if not more.isEmpty():
        stars = components(stars.unionByName(more), folder, "all-stars")
    rooted = nodes.select("node", "k").join(stars.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("k").alias("component"))
    named = stage(rooted.join(least, "root").select("node", "component"), folder, "named")
    rows = stage(sketched.select("k", "node", "n"), folder, "rows")
    discard(spark, folder, "sketch", "nodes", "pairs", "wanted", "compared", "fine", "outside", "further", "more")
    release(spark)
    return (rows.join(named, "node", "left")
            .select("k", "n", F.when(F.col("n") == 0, F.col("k")).otherwise(F.col("component")).alias("component")))


def report(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row."""
    g = groups(docs, words, threshold)
    return g.select(id_value("k").alias("doc_id"), F.col("n").alias("n_shingles"),
                    id_value("component").alias("component_id"), (F.col("k") == F.col("component")).alias("kept"))


def dedup(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that are the smallest id of their group."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    g = groups(docs, words, threshold).groupBy("k").agg(F.min("component").alias("c"))
    gone = stage(g.where("k <> c").select(F.col("k").alias("gone")), folder, "gone")
    return docs.join(small_ids(gone), id_key() == F.col("gone"), "left_anti")


#: ``report(docs, 2, 0.8)`` in one statement.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
l AS (SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id
      AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (min(a.n) + min(b.n) - count(*))),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id AS u, doc_id AS root FROM s UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.u WHERE r.root < e.v),
c AS (SELECT u, min(root) AS component_id FROM r GROUP BY u)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON s.doc_id = c.u
"""
