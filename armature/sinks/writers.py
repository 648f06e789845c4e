"""Sinks (K1, K2, K4, K6): partitioned, append-only, resumable writes.

K1 replaces "one pickle per (scenario, distractor) pair, skipped when the file
exists" with an append to a partitioned Parquet store after an anti-join
against what the store already holds (only ``status = 'ok'`` rows count as
done, so failed pairs are retried - quirk Q3).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from armature.operators.design import RESULT_KEY, pending

RESULT_PARTITIONS = ["experiment", "dataset", "model_id", "question_format"]


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def append_results(results: DataFrame, path: str, keys: tuple[str, ...] | None = None) -> DataFrame:
    """K1: append only rows whose key is not already stored as ok; returns what was written.

    ``keys`` defaults to the parts of ``RESULT_KEY`` among the columns.  Of rows that
    repeat a key inside one append the ok one is kept.
    """
    spark = results.sparkSession
    keys = tuple(keys or (k for k in RESULT_KEY if k in results.columns))
    failed = F.when(F.col("status") == "ok", 0).otherwise(1) if "status" in results.columns else F.lit(0)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(failed, F.xxhash64(*[F.col(c) for c in results.columns])))
    new = results.withColumn("_first", first).where("_first = 1").drop("_first")
    if exists(spark, path):
        done = spark.read.option("mergeSchema", True).parquet(path)
        if "status" in done.columns:
            done = done.where(F.col("status") == "ok")
        held = [F.col(k) if k in done.columns else F.lit(None).alias(k) for k in keys]
        new = pending(new, done.select(*held), keys=keys)
    new.write.partitionBy(*[c for c in RESULT_PARTITIONS if c in new.columns]).mode("append").parquet(path)
    return new


def model_dir(model_id: str = "model_id"):
    """K2 folder name: first and last '/' segment of the model id joined by '_'."""
    parts = F.split(F.col(model_id), "/")
    return F.concat_ws("_", F.element_at(parts, 1), F.element_at(parts, -1))


def write_per_model_csv(df: DataFrame, path: str) -> None:
    """K2: one CSV folder per model."""
    (df.withColumn("model_dir", model_dir()).write.partitionBy("model_dir")
       .option("header", True).mode("overwrite").csv(path))


def write_stats(df: DataFrame, path: str, dp: int = 4) -> None:
    """K4: statistics table as CSV in full precision, and with ``dp`` decimals as text under ``<path>_text``."""
    df.write.option("header", True).mode("overwrite").csv(path)
    cols = [F.round(F.col(f.name), dp).alias(f.name) if f.dataType.typeName() in ("double", "float")
            else F.col(f.name) for f in df.schema.fields]
    df.select(*cols).write.option("header", True).option("sep", "\t").mode("overwrite").csv(f"{path.rstrip('/')}_text")


def write_table_csv(df: DataFrame, path: str) -> None:
    """K6: prepared scenario table."""
    df.write.option("header", True).option("escape", '"').mode("overwrite").csv(path)
