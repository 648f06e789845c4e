"""Experiment tables as deterministic views over the driver's parquet tables.

Each view reads only the columns it needs (Catalyst prunes the parquet scan)
and is a pure projection / row expansion - no shuffle.  The same definitions
exist as SQL in ``armature.plans.oracle`` so that DuckDB can check every query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from armature.schemas import RULES
from armature.session import sf_table_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(sf_table_path(sf_dir, name))


def _nullif_mod(c: Column, m: int, value: Column | None = None) -> Column:
    """NULL when c % m == 0 (the untreated arm), else ``value`` (default: c itself)."""
    return F.when(c % m == 0, F.lit(None)).otherwise(c if value is None else value)


def distractors(spark, sf_dir) -> DataFrame:
    """v_distractors: (id, sentiment, modality, file_path) over supplier."""
    k = F.col("s_suppkey")
    return (table(spark, sf_dir, "supplier").select("s_suppkey")
            .where(k % 4 != 0)
            .select(k.alias("id"),
                    F.when(k % 4 == 1, "positive").when(k % 4 == 2, "neutral")
                    .otherwise("negative").alias("sentiment"),
                    F.when(k % 8 < 4, "text").otherwise("image").alias("modality"),
                    F.concat(F.lit("asset/"), (k % 50).cast("string")).alias("file_path")))


def scenarios(spark, sf_dir) -> DataFrame:
    """v_scenarios: (id, context, action1, action2) over part."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("context"),
        F.col("p_brand").alias("action1"), F.col("p_type").alias("action2"))


def _yes_no(c: Column) -> Column:
    return F.when(c == 0, "No").when(c == 1, "Yes").otherwise("No agreement")


def scenario_rules(spark, sf_dir) -> DataFrame:
    """v_scenario_rules: one row per (scenario, rule) - an explode, not a join."""
    rules = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(r).alias("rule")) for i, r in enumerate(RULES)])
    p = (table(spark, sf_dir, "part").select("p_partkey", "p_size")
         .select("p_partkey", "p_size", F.explode(rules).alias("r")))
    return p.select(F.col("p_partkey").alias("id"), F.col("r.rule").alias("rule"),
                    _yes_no((F.col("p_partkey") * 7 + F.col("r.k")) % 3).alias("a1"),
                    _yes_no((F.col("p_size") + F.col("r.k")) % 3).alias("a2"))


def scenario_rules_wide(spark, sf_dir) -> DataFrame:
    """MoralChoice scenario file layout: id, context, actions, a1_<rule>, a2_<rule>."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    cols = [F.col("p_partkey").alias("id"), F.col("p_name").alias("context"),
            F.col("p_brand").alias("action1"), F.col("p_type").alias("action2")]
    for i, r in enumerate(RULES):
        cols.append(_yes_no((F.col("p_partkey") * 7 + i) % 3).alias(f"a1_{r}"))
        cols.append(_yes_no((F.col("p_size") + i) % 3).alias(f"a2_{r}"))
    return p.select(*cols)


def responses(spark, sf_dir) -> DataFrame:
    """v_responses: MoralChoice result rows over lineitem."""
    o = (F.col("l_linenumber") % 2)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("model_id"), F.col("l_partkey").alias("scenario_id"),
        o.alias("question_ordering"),
        F.concat(F.col("l_partkey").cast("string"), F.lit("_"), o.cast("string")).alias("baseline_id"),
        _nullif_mod(F.col("l_suppkey"), 4).alias("distractor_id"),
        F.col("l_discount").alias("a1_prob"), F.col("l_tax").alias("a2_prob"))


def option_responses(spark, sf_dir) -> DataFrame:
    """v_option_responses: NormBank-style option probabilities and verdicts over events."""
    e = F.col("event_id")

    def prob(mult, add):
        return (F.when(e % 1009 == 0, F.lit(0.0))
                .otherwise(((e * mult + add) % 101).cast("double") / 101))
    et = F.col("event_type")
    verdict = (F.when(e % 50 == 0, F.lit(None).cast("string"))
               .when(et == "signup", "ESH").when(et == "purchase", "YTA")
               .when(et == "error", "NTA").when(et == "click", "NAH").otherwise("INFO"))
    return table(spark, sf_dir, "events").select(
        e.alias("event_id"), F.concat(F.lit("m"), (e % 3).cast("string")).alias("model_id"),
        F.col("user_id").alias("scenario_id"), _nullif_mod(e, 4, e % 4).alias("distractor_id"),
        prob(7, 0).alias("good_prob"), prob(13, 5).alias("ok_prob"), prob(29, 11).alias("bad_prob"),
        verdict.alias("verdict"), F.col("value").alias("score"))


def _emb(i: int) -> Column:
    return F.element_at("embedding", i).cast("double")


def foundations(spark, sf_dir) -> DataFrame:
    """v_foundations: five moral-foundation scores per response over embeddings."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        v.alias("vec_id"), F.concat(F.lit("m"), (F.col("label") % 3).cast("string")).alias("model_id"),
        (v - v % 4).alias("scenario_id"), _nullif_mod(v, 4, v % 4).alias("distractor_id"),
        _emb(1).alias("ch_score"), _emb(2).alias("fc_score"), _emb(3).alias("lb_score"),
        _emb(4).alias("as_score"), _emb(5).alias("pd_score"))


def verdict_probs(spark, sf_dir) -> DataFrame:
    """v_verdict_probs: five verdict probabilities per response over embeddings."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        v.alias("vec_id"), F.concat(F.lit("m"), (F.col("label") % 3).cast("string")).alias("model_id"),
        (v - v % 4).alias("scenario_id"), _nullif_mod(v, 4, v % 4).alias("distractor_id"),
        *[F.abs(_emb(6 + i)).alias(f"{o}_prob") for i, o in enumerate(["esh", "yta", "nta", "nah", "info"])])


def text_responses(spark, sf_dir) -> DataFrame:
    """v_text_responses: verdict-style answers wrapped around whole document texts."""
    d = F.col("doc_id")
    head = (F.when(d % 5 == 0, "Verdict: nta").when(d % 5 == 1, "I say NTA, not YTA")
            .when(d % 5 == 2, "verdict - ESH").when(d % 5 == 3, "unsure").otherwise(""))
    mid = F.when(d % 3 == 0, F.lit("\nReasoning: ")).otherwise(F.lit(" "))
    tail = F.when(d % 7 == 0, F.lit("\nSummary: end")).otherwise(F.lit(""))
    return table(spark, sf_dir, "documents").select(
        d.alias("doc_id"), F.concat(head, mid, F.col("text"), tail).alias("answer"))


def batch_responses(spark, sf_dir) -> DataFrame:
    """v_batch_responses: (custom_id, line_no, content) over conversations."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("custom_id"), F.col("turn").alias("line_no"),
        F.col("text").alias("content"))


def done_pairs(spark, sf_dir) -> DataFrame:
    """Pairs with a stored result: distinct (model, scenario, distractor) of v_responses."""
    return responses(spark, sf_dir).select("model_id", "scenario_id", "distractor_id").distinct()


def result_store(spark, sf_dir) -> DataFrame:
    """A result store over lineitem: two experiments, two datasets, two formats, some failed rows."""
    return table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_quantity") % 3 == 0, "pilot").otherwise("main").alias("experiment"),
        F.when(F.col("l_linestatus") == "O", "moralchoice_high_ambiguity").otherwise("moralchoice_low_ambiguity").alias("dataset"),
        F.col("l_returnflag").alias("model_id"),
        F.when(F.col("l_orderkey") % 2 == 0, "ab").otherwise("compare").alias("question_format"),
        F.col("l_partkey").alias("scenario_id"), _nullif_mod(F.col("l_suppkey"), 4).alias("distractor_id"),
        (F.col("l_linenumber") % 2).alias("question_ordering"),
        F.when(F.col("l_linenumber") % 5 == 0, "failed").otherwise("ok").alias("status"))
