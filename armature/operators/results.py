"""Result rows from prompts and responses, their store and its collection.

retrieve: returned lines -> last line per prompt -> joined to the prompts -> scored by the dataset's spec -> result rows,
appended to the partitioned store where they are not yet stored as ok.  A prompt without a response becomes a row with status
``missing`` and no scores, so it stays pending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from armature.functions.text import strip
from armature.operators import batch as BT
from armature.operators.hooks import FOUNDATION_CODES, score_texts
from armature.operators.spec import spec
from armature.sources.registry import VARIANT_FAMILIES, sampling_defaults

_KEY = ["model_id", "question_format", "system_prompt", "user_prompt", "scenario_id", "distractor_id", "answer_raw", "answer", "status"]


def score_columns(dataset: str) -> list[str]:
    """The score columns of a dataset's result rows, besides those of ``_KEY`` and the sampling settings."""
    if dataset.startswith("moralchoice"):
        return ["a1_prob", "a2_prob"]
    if dataset == "normbank":
        return [f"{o.lower()}_prob" for o in VARIANT_FAMILIES["normbank"]]
    return [f"{o.lower()}_prob" for o in VARIANT_FAMILIES["reddit"]]


def result_rows(prompts: DataFrame, responses: DataFrame, dataset: str, variants: DataFrame | None = None, *,
                experiment: str = "main", temperature: float | None = None, top_p: float | None = None,
                make_scorer=None, memo: str | None = None) -> DataFrame:
    """One result row per prompt.

    ``prompts``: rendered prompts of ``dataset`` with prompt_id, model_id and the parts of the result key;
    ``responses``: (custom_id, content, positions), one per id; ``variants``: the models' token sequences.
    Verdict datasets also get verdict, reasoning and, with ``make_scorer`` (``hooks.score_texts``), foundation scores.
    """
    t, p = sampling_defaults(dataset, temperature, top_p)
    joined = BT.join_responses(prompts, responses.select("custom_id", F.col("content").alias("answer_raw"), "positions"))
    joined = joined.withColumn("answer", strip(F.col("answer_raw")))
    scored = spec(dataset).score(joined, variants)
    here = F.col("status") == "ok"
    extra = ["prompt_id"] + [c for c in ("question_ordering", "distractor_modality", "distractor_file_path") if c in prompts.columns]
    if "verdict" in scored.columns:
        extra += ["response_text", "verdict", "reasoning"]
    probs: list[Column] = [F.when(here, F.col(c)).alias(c) for c in score_columns(dataset)]
    rows = scored.select(
        F.lit(experiment).alias("experiment"), F.lit(dataset).alias("dataset"), *extra, *_KEY,
        F.lit("top_p_sampling").alias("eval_technique"), F.lit(p).alias("eval_top_p"), F.lit(t).alias("eval_temperature"), *probs)
    if make_scorer is not None:
        rows = score_texts(rows, "reasoning", make_scorer, rows.columns, memo).select(
            *rows.columns, *[F.col(f"{c.lower()}_score") for c in FOUNDATION_CODES])
    return rows


def retrieve(spark: SparkSession, prompts: DataFrame, path: str, store: str, dataset: str,
             variants: DataFrame | None = None, **settings) -> DataFrame:
    """X5, second half: read returned JSON lines under ``path``, score them and append them to ``store``; returns what was added."""
    from armature.sinks.writers import append_results
    responses = BT.keep_last(BT.read_responses(spark, path))
    return append_results(result_rows(prompts, responses, dataset, variants, **settings), store)


def collect_results(spark: SparkSession, store: str, experiment: str, dataset: str, modality: str = "all") -> DataFrame:
    """The ok rows of one (experiment, dataset); ``modality``: all, none (untreated only), text or image."""
    if modality not in ("all", "none", "text", "image"):
        raise ValueError(f"unknown modality {modality!r}")
    rows = spark.read.option("mergeSchema", True).parquet(store).where(
        (F.col("experiment") == experiment) & (F.col("dataset") == dataset) & (F.col("status") == "ok"))
    if modality == "none":
        return rows.where(F.col("distractor_id").isNull())
    return rows if modality == "all" else rows.where(F.col("distractor_modality") == modality)
