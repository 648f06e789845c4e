"""Shared helpers of the training-data operators: staged tables and document identity.

Conventions that every operator of this subpackage keeps:

* a null ``text`` is an empty text;
* a null ``doc_id`` is one id that sorts before all others;
* rows that repeat a ``doc_id`` stay separate rows, ordered by (doc_id, text);
* rows equal in ``doc_id`` and ``text`` are the same document and get the same result;
* columns beyond those an operator reads never reach its internal tables, so
  extra columns cannot clash with internal names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from armature.session import checkpoint_dir
from armature.shipping import ship

NULL_ID = -(1 << 63)


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; also ships the package to the workers."""
    ship(spark)
    return f"{checkpoint_dir(spark).rstrip('/')}/armature-llm/{uuid.uuid4().hex}"


def stage(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage at a table that every executor can read again, so a lost
    executor costs the running tasks only.
    """
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, folder: str, *names: str) -> None:
    """Delete staged tables that no later plan reads."""
    jvm = spark._jvm
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_key(col: str = "doc_id") -> Column:
    """``doc_id`` as a long, null as the smallest long."""
    return F.coalesce(F.col(col).cast("long"), F.lit(NULL_ID))


def id_value(col: str) -> Column:
    """Inverse of ``id_key``."""
    return F.when(F.col(col) != NULL_ID, F.col(col))


def text_bytes(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bucketed(df: DataFrame, key: str, buckets: int | None = None) -> str:
    """Save ``df`` as a warehouse table bucketed and sorted by ``key``; returns its name.

    Joins on ``key`` then leave this side where it is.
    """
    n = buckets or shuffle_partitions(df.sparkSession)
    name = f"armature_{uuid.uuid4().hex}"
    (df.repartition(n, key).sortWithinPartitions(key).write.format("parquet")
     .bucketBy(n, key).sortBy(key).saveAsTable(name))
    return name


#: Rows of at most two ids that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def small_ids(ids: DataFrame) -> DataFrame:
    """Hint a broadcast of a staged table of ids if it has at most ``BROADCAST_ROWS`` rows."""
    return F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps, whose plans nothing refers to any more."""
    import gc
    gc.collect()
    spark._jvm.System.gc()
