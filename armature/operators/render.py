"""Prompt rendering as column expressions.

Distractor bodies are read once as a table (``distractor_texts``) and joined on
their path - never opened per prompt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armature.functions import text as TX
from armature.operators.conditions import small_side
from armature.operators.design import prompt_id
from armature.sources.registry import render_template, template_parts


#: Keys that stand for a missing path, so that untreated rows spread over many tasks.
_NO_PATH_KEYS = 1024


def attach_distractor_text(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Left-join stripped distractor bodies on the registry's relative path.

    ``texts``: (file_path, body), broadcast only if their rows and bytes are few.  A missing body
    renders as "no text" (the prompt is left unchanged) instead of failing the job.  Where the join
    shuffles, rows without a path are dealt over ``_NO_PATH_KEYS`` keys that no path has.
    """
    t = texts.where(F.col("file_path").isNotNull()).select(F.col("file_path").alias("_tp"), TX.strip(F.col("body")).alias("distractor_text"))
    spread = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(_NO_PATH_KEYS)).cast("string"))
    keyed = rows.withColumn("_path", F.coalesce(F.col("distractor_file_path"), spread))
    return keyed.join(small_side(t), F.col("_path") == F.col("_tp"), "left").drop("_tp", "_path")


def render_choice(rows: DataFrame, question_format: str = "ab") -> DataFrame:
    """MoralChoice prompts: scenario-side injection (P4/P5) + template (P8), per ordering.

    ``rows`` carries context, action1, action2, question_ordering, distractor_*.
    """
    system, pieces = template_parts(f"{question_format}_moralchoice")
    ctx = TX.inject_scenario_side(F.col("context"), F.col("distractor_modality"), F.col("distractor_text"))
    o = F.col("question_ordering")
    a = F.when(o == 0, F.col("action1")).otherwise(F.col("action2"))
    b = F.when(o == 0, F.col("action2")).otherwise(F.col("action1"))
    return rows.select(
        "*",
        prompt_id(F.col("scenario_id"), F.col("distractor_id"), o, F.lit(question_format)).alias("prompt_id"),
        F.lit(system).alias("system_prompt"),
        render_template(pieces, ctx, a, b).alias("user_prompt"))


def render_system_injected(rows: DataFrame, template: str = "normbank") -> DataFrame:
    """NormBank prompts: injection on the system prompt (P6) + user template."""
    system, pieces = template_parts(template)
    sys_col = TX.inject_scenario_side(F.lit(system), F.col("distractor_modality"), F.col("distractor_text"))
    return rows.select("*", prompt_id(F.col("scenario_id"), F.col("distractor_id")).alias("prompt_id"),
                       sys_col.alias("system_prompt"), render_template(pieces, F.col("context")).alias("user_prompt"))


def render_verdict(rows: DataFrame, template: str = "reddit") -> DataFrame:
    """Verdict prompts: strip + first-letter lowering + text/image prefix on the system
    prompt (P7); the user prompt is the stripped post."""
    system, pieces = template_parts(template)
    sys_col = TX.inject_system_side(F.lit(system), F.col("distractor_modality"), F.col("distractor_text"))
    return rows.select("*", prompt_id(F.col("scenario_id"), F.col("distractor_id")).alias("prompt_id"),
                       sys_col.alias("system_prompt"),
                       render_template(pieces, TX.strip(F.col("context"))).alias("user_prompt"))
