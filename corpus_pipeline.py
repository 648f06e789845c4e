"""Corpus pipeline: toxicity, line dedup, near-duplicate dedup, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept.
All but the last return the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armature.llm import line_runs, minmax, packing, substrings, tokens, toxicity
from armature.llm.common import documents, shared_folder, stage


def _with_text(cleaned: DataFrame, text: str, like: DataFrame) -> DataFrame:
    """The columns of ``like`` from ``doc``, with the new text and its length."""
    return cleaned.select(*[
        F.col(text).alias("text") if c == "text" else
        F.char_length(text).cast(t).alias("n_chars") if c == "n_chars" else
        F.col("doc").getField(c).alias(c) for c, t in like.dtypes])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(line_runs.dedup(docs), "text", docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minmax.dedup(docs, words=5, threshold=0.8)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(substrings.dedup(docs, as_text=True), "kept", docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(docs, tokens.tokenizer_path(), end_id=1))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("passage_dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]

#: A regression score and token ids are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written as Parquet and read again."""
    docs, folder = documents(spark, sf_dir), shared_folder(spark)
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
