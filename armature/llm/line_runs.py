"""Line deduplication over levelled sorted runs of line hashes (operator 9).

Method: documents arrive in batches of ascending id.  The index is a set of
runs: bucketed tables of distinct 128-bit line hashes, sorted inside their buckets.
A new batch is reduced to its distinct hashes, merge-joined with each run (no
run is shuffled), and what no run holds becomes a run of level 0.  ``fanout`` runs
of a level are merged into one of the next, so a batch meets
``fanout * log(batches)`` runs at most.

A line's key is the line without white space at its ends, A-Z lower-cased.  A
key of at least ``min_chars`` code points that several documents hold stays only
in the document with the smallest id.

Only DataFrame functions run.  A very frequent line is reduced map-side before
it is joined with the runs; the join back to its occurrences is a shuffle join
whose large partitions adaptive execution splits.

Defined results: null text counts as empty (one empty line); a null id is
smaller than all others; rows that share an id count as one document; a column named like
one of this operator's is kept inside ``doc``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from armature.llm.common import discard, id_key, shared_folder, shuffle_partitions, stage

#: The white space that a key drops at its ends, and the letters it lowers.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


class LineRuns:
    """The index: runs by level, each a table ``(h)`` bucketed and sorted by hash."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = 3):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or shuffle_partitions(spark)
        self.levels: list[list[str]] = []

    def _save(self, hashes: DataFrame) -> str:
        name = f"armature_line_run_{uuid.uuid4().hex}"
        (hashes.repartition(self.buckets, "h").sortWithinPartitions("h").write.format("parquet")
         .bucketBy(self.buckets, "h").sortBy("h").saveAsTable(name))
        return name

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def look_up(self, keys: DataFrame) -> DataFrame:
        """``keys`` (one row per ``h``) with ``seen``: whether a run holds the hash."""
        out = keys.withColumn("seen", F.lit(False))
        for name in self.runs():
            run = self.spark.table(name).select("h", F.lit(True).alias("_in"))
            out = (out.join(run.hint("merge"), "h", "left")
                   .withColumn("seen", F.col("seen") | F.coalesce("_in", F.lit(False))).drop("_in"))
        return out

    def add(self, hashes: DataFrame) -> None:
        """Add distinct hashes that no run holds as a run of level 0, then merge full levels."""
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._save(hashes))
        for n, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                merged = self.spark.table(level[0])
                for name in level[1:]:
                    merged = merged.unionByName(self.spark.table(name))
                if n + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[n + 1].append(self._save(merged))
                for name in level:
                    self.spark.sql(f"DROP TABLE {name}")
                level.clear()

    def drop(self) -> None:
        for name in self.runs():
            self.spark.sql(f"DROP TABLE {name}")
        self.levels = []


def dedup(docs: DataFrame, min_chars: int = 10, batches: int = 4, fanout: int = 3) -> DataFrame:
    """(doc, text, n_lines, n_dropped): ``doc`` holds the input columns, ``text`` the remaining lines."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("doc"),
                       id_key().alias("k"), text.alias("text"))
    rows = rows.withColumn("r", F.unhex(F.md5("text")))
    exploded = rows.select("k", "r", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    keyed = exploded.select("k", "r", "at", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    lines = stage(keyed.select("k", "r", "at", F.unhex(F.md5("key")).alias("h")), folder, "lines")

    cuts = lines.agg(F.percentile_approx("k", [i / batches for i in range(1, batches)], 10_000)).first()[0] or []
    edges = [None, *sorted(set(cuts)), None]
    index = LineRuns(spark, fanout=fanout)
    marks = []
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        batch = lines
        if low is not None:
            batch = batch.where(F.col("k") > low)
        if high is not None:
            batch = batch.where(F.col("k") <= high)
        keys = batch.groupBy("h").agg(F.min("k").alias("first"), F.max("k").alias("last"))
        keys = stage(index.look_up(keys), folder, f"keys{i}")
        if high is not None:
            index.add(keys.where("NOT seen").select("h"))
        doubled = keys.where("seen OR first < last").select("h", F.when(~F.col("seen"), F.col("first")).alias("owner"))
        hit = batch.join(doubled, "h").where("owner IS NULL OR k <> owner")
        marks.append(stage(hit.select("k", "r", "at"), folder, f"marks{i}"))
        discard(spark, folder, f"keys{i}")
    index.drop()
    discard(spark, folder, "lines")
    marked = marks[0]
    for m in marks[1:]:
        marked = marked.unionByName(m)
    drops = marked.groupBy("k", "r").agg(F.collect_set("at").alias("dropped"))
    joined = rows.join(drops, ["k", "r"], "left")
    all_lines = F.split("text", "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("dropped")),
                       lambda i: F.get(F.col("lines"), i))
    return (joined.withColumn("lines", all_lines)
            .select("doc", F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
                    F.size("lines").cast("long").alias("n_lines"),
                    F.when(F.col("dropped").isNull(), F.lit(0)).otherwise(F.size("dropped")).cast("long").alias("n_dropped")))


def digests(cleaned: DataFrame) -> DataFrame:
    return cleaned.select(F.col("doc.doc_id").alias("doc_id"), "n_lines", "n_dropped",
                          F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: The same result in one statement.
ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce("text", ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i AS pos, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
k AS (SELECT doc_id, pos, line,
             translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
m AS (SELECT k.doc_id, k.pos, k.line, o.owner IS NOT NULL AND o.owner <> k.doc_id AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
