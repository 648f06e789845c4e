"""Incremental collection of arriving batch-response files (Structured Streaming).

Not part of the reference's parity inventory - its nearest feature is the
resumable append-only result store.  ``readStream`` watches the folder where
batch outputs land; each micro-batch keeps the last line per ``custom_id``
and appends it with its run and epoch, and ``collected`` reads the last line of
every id, so a later line wins inside a batch, across batches and across runs: a store that is
used again with a fresh checkpoint gets a new run, whose epochs start at 0 beside the earlier ones.  ``trigger(availableNow=True)`` drains what is there and stops; the
checkpoint folder makes re-runs exactly-once across restarts and lost
executors.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armature.operators.batch import keep_last
from armature.schemas import BATCH_RESPONSE


def _run_folder(spark: SparkSession, store: str, checkpoint: str) -> str:
    """``run=<number>-<id>``: the id of the checkpoint's query, numbered in order of first use of the store."""
    own = json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()[0])["id"]
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    runs = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    runs = sorted(r for r in runs if r.startswith("run="))
    known = [r for r in runs if r.endswith(own)]
    return known[0] if known else f"run={len(runs):06d}-{own}"


def collect_responses(spark: SparkSession, source_dir: str, store: str, checkpoint: str,
                      available_now: bool = True):
    stream = (spark.readStream.schema(BATCH_RESPONSE).json(source_dir)
              .select("custom_id",
                      F.try_element_at(F.col("response.body.choices"), F.lit(1))["message"]["content"].alias("content"),
                      F.col("_metadata.file_path").alias("_file"),
                      F.col("_metadata.file_block_start").alias("_block")))

    def upsert(batch: DataFrame, epoch_id: int) -> None:
        # inside a micro-batch the frame is static: row position within the task orders lines
        rows = batch.withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        latest = keep_last(rows.select("custom_id", "content", F.struct("_file", "_block", "_row").alias("line_key")))
        # an epoch that runs again after a failure replaces its own folder
        latest.select("custom_id", "content").write.mode("overwrite").parquet(
            f"{store}/{_run_folder(batch.sparkSession, store, checkpoint)}/epoch={epoch_id}")

    w = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def collected(spark: SparkSession, store: str) -> DataFrame:
    """(custom_id, content): the last collected line of every id."""
    rows = spark.read.parquet(store)
    return rows.groupBy("custom_id").agg(F.max_by("content", F.struct("run", "epoch")).alias("content"))
