"""Offline batch halves as table transforms (K3, S7, W4, J7; hook surface X5).

Submit: one JSON request line per pending prompt, appended as text files.
Retrieve: read the returned JSONL with an explicit schema, keep the last line
per ``custom_id`` (file order), join to the prompts; a prompt without a
response gets ``status = 'missing'`` instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armature.schemas import BATCH_RESPONSE, TOP_LOGPROBS

REQUEST_URL = "/v1/chat/completions"


def batch_requests(prompts: DataFrame, model: str, max_tokens: int, temperature: float,
                   top_p: float, id_col: str = "prompt_id") -> DataFrame:
    """K3: (custom_id, line) with line = the JSON request object."""
    body = F.struct(
        F.lit(model).alias("model"),
        F.array(F.struct(F.lit("system").alias("role"), F.col("system_prompt").alias("content")),
                F.struct(F.lit("user").alias("role"), F.col("user_prompt").alias("content"))).alias("messages"),
        F.lit(int(max_tokens)).alias("max_completion_tokens"), F.lit(float(temperature)).alias("temperature"),
        F.lit(float(top_p)).alias("top_p"), F.lit(True).alias("logprobs"),
        F.lit(TOP_LOGPROBS).alias("top_logprobs"))
    req = F.struct(F.col(id_col).alias("custom_id"), F.lit("POST").alias("method"),
                   F.lit(REQUEST_URL).alias("url"), body.alias("body"))
    return prompts.select(F.col(id_col).alias("custom_id"), F.to_json(req).alias("line"))


def write_requests(requests: DataFrame, path: str) -> None:
    """Append request lines (one text file per task; appends never rewrite earlier batches)."""
    requests.select("line").write.mode("append").text(path)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Batch output JSONL -> (custom_id, line_key, content, positions).

    ``line_key`` orders lines as they appear in their file: file, split start,
    row position within the task (``monotonically_increasing_id`` low bits).
    """
    raw = spark.read.schema(BATCH_RESPONSE).json(path).select(
        "custom_id", "response",
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        (F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).alias("_row"))
    choice = F.try_element_at(F.col("response.body.choices"), F.lit(1))
    return raw.select(
        "custom_id", F.struct("_file", "_block", "_row").alias("line_key"),
        choice["message"]["content"].alias("content"),
        F.transform(choice["logprobs"]["content"], lambda c: c["top_logprobs"]).alias("positions"))


def keep_last(df: DataFrame, key: str = "custom_id", order: str = "line_key") -> DataFrame:
    """A later line for the same key wins - an aggregate (``max_by``), not a window,
    so a key repeated in a third of the file still pre-aggregates map-side."""
    rest = [c for c in df.columns if c != key]
    packed = F.struct(*[F.col(c) for c in rest])
    return (df.groupBy(key).agg(F.max_by(packed, F.col(order)).alias("_last"))
            .select(key, *[F.col(f"_last.{c}").alias(c) for c in rest]))


def join_responses(prompts: DataFrame, responses: DataFrame, id_col: str = "prompt_id") -> DataFrame:
    """Prompts left-join responses by custom_id; status ok / missing."""
    r = responses.withColumnRenamed("custom_id", "_cid")
    j = prompts.join(r, F.col(id_col) == F.col("_cid"), "left")
    return j.withColumn("status", F.when(F.col("_cid").isNull(), F.lit("missing")).otherwise(F.lit("ok"))).drop("_cid")
