"""Experiment design, resumption and eligibility.

The design pairs every scenario with the untreated arm and with every
distractor - its output *is* that product, emitted cell by cell on a block
grid sized from the counts of both sides (``operators.grid``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armature.functions.text import safe_identifier
from armature.operators.conditions import small_side
from armature.operators.grid import cross


def _arm_cols(distractors: DataFrame) -> list[Column]:
    return [F.col("id").alias("distractor_id")] + [
        F.col(c).alias(f"distractor_{c}") for c in ("modality", "file_path") if c in distractors.columns]


def arms(distractors: DataFrame | None, spark, include_baseline: bool = True) -> DataFrame:
    """(distractor_id, distractor_modality, distractor_file_path): the untreated arm (nulls) and every distractor.

    A registry without modality or file_path gives arms without them: every cell of a product gets a copy of its arms,
    so a caller that does not need these columns leaves them out.
    """
    if distractors is None:
        names, id_type = ["distractor_id", "distractor_modality", "distractor_file_path"], "string"
    else:
        treated = distractors.select(*_arm_cols(distractors))
        names, id_type = treated.columns, distractors.schema["id"].dataType.simpleString()
    untreated = spark.createDataFrame([(None,) * len(names)] if include_baseline else [],
                                      ", ".join([f"distractor_id {id_type}", *[f"{c} string" for c in names[1:]]]))
    if distractors is None:
        return untreated
    return untreated.unionByName(treated) if include_baseline else treated


def design(scenarios: DataFrame, distractors: DataFrame | None, formats: list[str],
           include_baseline: bool = True, target_rows: int | None = None) -> DataFrame:
    """Scenarios x (untreated arm + every distractor) x question formats.

    Returns (scenario cols..., distractor_id, distractor_modality,
    distractor_file_path, question_format); the untreated arm has null
    distractor columns.
    """
    every = arms(distractors, scenarios.sparkSession, include_baseline)
    if len(formats) == 1:
        return cross(scenarios, every, target=target_rows).withColumn("question_format", F.lit(formats[0]))
    n_arms = every.count()
    rows = cross(scenarios, every, scenarios.count() * len(formats), n_arms, target_rows,
                 in_cell=lambda left: left.select("*", F.explode(F.array(*map(F.lit, formats))).alias("question_format")))
    return rows.select(*[c for c in rows.columns if c != "question_format"], "question_format")


def expand_models(df: DataFrame, models: list[str]) -> DataFrame:
    """One design row per model to run (a literal list of run parameters)."""
    return df.select("*", F.explode(F.array(*[F.lit(m) for m in models])).alias("model_id"))


#: What identifies one result.
RESULT_KEY = ("experiment", "dataset", "model_id", "question_format", "scenario_id", "distractor_id", "question_ordering")


def pending(design_rows: DataFrame, done: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """Drop pairs that already have a stored result; null-safe on every key.

    ``keys`` defaults to the parts of ``RESULT_KEY`` among the columns; a part that only one side has is an
    error, since leaving it out would drop work of another experiment, dataset or ordering.
    """
    if keys is None:
        keys = tuple(k for k in RESULT_KEY if k in design_rows.columns or k in done.columns)
        lost = [k for k in keys if k not in design_rows.columns or k not in done.columns]
        if lost:
            raise ValueError(f"only one side has {', '.join(lost)}")
    cond = None
    d = done.select(*[F.col(k).alias(f"_done_{k}") for k in keys])
    for k in keys:
        c = design_rows[k].eqNullSafe(d[f"_done_{k}"])
        cond = c if cond is None else cond & c
    return design_rows.join(d, cond, "left_anti")


def pending_models(scenarios: DataFrame, distractors: DataFrame | None, done: DataFrame, models: list[str]) -> DataFrame:
    """J2 fused with the design and the model expansion: (model_id, scenario_id, distractor_id) without a row in ``done``.

    ``done`` has these three columns.  The design is emitted on the block grid with the bitmaps of
    ``operators.resume``, so scenarios, arms and stored pairs are shuffled, never the product.
    """
    from armature.operators.resume import resume_pending
    one = {"experiment": "", "dataset": "", "question_format": ""}
    stored = done.select("model_id", "scenario_id", "distractor_id", *[F.lit(v).alias(k) for k, v in one.items()],
                         F.lit(0).alias("question_ordering"))
    return resume_pending(scenarios.select("scenario_id"), distractors, [""], stored, experiment="", dataset="",
                          models=models).select("model_id", "scenario_id", "distractor_id")


def prompt_id(scenario_id: Column, distractor_id: Column, ordering: Column | None = None,
              fmt: Column | None = None) -> Column:
    """scenario_distractor-or-none[_ordering_format]."""
    parts = [scenario_id.cast("string"), F.coalesce(distractor_id.cast("string"), F.lit("none"))]
    if ordering is not None:
        parts += [ordering.cast("string"), fmt]
    return F.concat_ws("_", *parts)


def result_file_key(scenario_id: Column, distractor_id: Column) -> Column:
    """K1 file name stem ``s_<id>_d_<id>`` with P1-sanitised ids."""
    return F.concat(F.lit("s_"), safe_identifier(scenario_id), F.lit("_d_"), safe_identifier(distractor_id))


def option_orderings(scenarios: DataFrame) -> DataFrame:
    """Two prompts per scenario; option A = actions[o], B = actions[1-o]."""
    o = F.col("question_ordering")
    return (scenarios.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("question_ordering"))
            .withColumn("option_a", F.when(o == 0, F.col("action1")).otherwise(F.col("action2")))
            .withColumn("option_b", F.when(o == 0, F.col("action2")).otherwise(F.col("action1"))))


def eligibility(rows: DataFrame, capabilities: DataFrame, supports_distractors: bool = True) -> DataFrame:
    """Image distractor on a text-only model, or any distractor on a dataset without
    distractor support -> 'ineligible'; else 'eligible'.

    ``capabilities``: (model_id, accepts_images) - a registry-sized table.
    """
    cap = small_side(capabilities.select("model_id", "accepts_images"))
    j = rows.join(cap, "model_id", "left")
    has_d = F.col("distractor_id").isNotNull()
    bad = (has_d & F.lit(not supports_distractors)) | (
        (F.col("distractor_modality") == "image") & ~F.coalesce(F.col("accepts_images"), F.lit(False)))
    return j.withColumn("status", F.when(bad, F.lit("ineligible")).otherwise(F.lit("eligible")))
