"""The reference's three entry points as compositions of DataFrame transforms.

evaluate : design -> pending (anti-join on the store) -> render -> requests
retrieve : returned lines -> scored result rows -> partitioned store (operators.results)
collect  : result store -> filter -> one table (or per-model CSVs) (operators.results)
analyse  : results -> condition statistics -> pairwise tests -> Holm-Sidak -> report rows

Every step is lazy; nothing is collected except the final report text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armature.functions import stats as ST
from armature.operators import batch as BT
from armature.operators import conditions as C
from armature.operators import design as DS
from armature.operators import effects as E
from armature.operators import mixedlm as ML
from armature.operators import report as RP
from armature.operators import shares as SH
from armature.operators import significance as SG
from armature.operators.resume import resume_pending
from armature.operators.spec import spec
from armature.schemas import CONDITION_PAIRS
from armature.sources.registry import DATASETS, models_df, sampling_defaults


def pending_prompts(scenarios: DataFrame, distractors: DataFrame | None, dataset: str, models: list[str],
                    done: DataFrame | None = None, experiment: str = "main") -> DataFrame:
    """Eligible prompts of (experiment, dataset) without an ok result in the store ``done`` (``RESULT_KEY`` columns)."""
    spark, sp = scenarios.sparkSession, spec(dataset)
    if done is None:
        done = spark.createDataFrame([], ", ".join(f"{k} string" for k in DS.RESULT_KEY))
    rows = resume_pending(scenarios, distractors, sp.formats, done, experiment=experiment, dataset=dataset,
                          models=models, orderings=sp.orderings)
    if sp.orderings == 1:
        rows = rows.drop("question_ordering")
    kept = DS.eligibility(rows, models_df(spark), DATASETS[dataset]["distractors"])
    return kept.where("status = 'eligible'").drop("status", "accepts_images")


def evaluation_requests(scenarios: DataFrame, distractors: DataFrame | None, texts: DataFrame,
                        dataset: str, model: str, done: DataFrame | None = None,
                        max_tokens: int = 200, temperature: float | None = None,
                        top_p: float | None = None, experiment: str = "main") -> DataFrame:
    """Pending prompts of one (experiment, dataset, model) as batch request lines (custom_id, line).

    ``scenarios`` carries scenario_id, context[, action1, action2]; ``done`` is the result store.
    The request names the model without its registry prefix.
    """
    prompts = spec(dataset).render(_with_texts(pending_prompts(scenarios, distractors, dataset, [model], done, experiment), texts))
    t, p = sampling_defaults(dataset, temperature, top_p)
    return BT.batch_requests(prompts, model.split("/")[-1], max_tokens, t, p)


def _with_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    from armature.operators.render import attach_distractor_text
    return attach_distractor_text(rows, texts)


def moralchoice_analysis(results: DataFrame, distractors: DataFrame, rules_long: DataFrame) -> dict:
    """MMAP condition statistics, the six pairwise tests and Holm-Sidak, and report rows."""
    r = C.attach_condition(results, distractors)
    means = E.mmap_condition_means(r, rules_long)
    contrib = E.mmap_contributions(r, rules_long).withColumnRenamed("score", "option")
    tests = ML.mixed_lm_pairs(contrib, ["model_id", "option"], ["baseline_id"])
    tests = ST.holm_sidak(tests, "p", "p_adj")
    rows = RP.latex_rows(RP.latex_cells(RP.minmax_flags(means.select("model_id", "condition", "mean_score"),
                                                        ["model_id"])))
    return {"means": means, "tests": tests, "report_rows": rows, "unmatched": C.unmatched_arms(results, distractors),
            "p_value_rows": RP.p_value_rows(tests, [f"{a}_vs_{b}" for a, b in CONDITION_PAIRS], by=["option"])}


def option_analysis(results: DataFrame, distractors: DataFrame, options: list[str], normalise: bool = True,
                    drop_zero: bool = True, suffix: str = "_prob") -> dict:
    """NormBank / verdict / foundation families: per-option statistics and tests."""
    r = C.attach_condition(results, distractors)
    means = E.paired_effects(r, options, "scenario_id", normalise, drop_zero, suffix)
    contrib = E.option_contributions(r, options, "scenario_id", normalise, drop_zero, suffix)
    tests = ST.holm_sidak(ML.mixed_lm_pairs(contrib, ["model_id", "option"], ["scenario_id"]), "p", "p_adj")
    return {"means": means, "tests": tests, "unmatched": C.unmatched_arms(results, distractors),
            "p_value_rows": RP.p_value_rows(tests, [f"{a}_vs_{b}" for a, b in CONDITION_PAIRS], by=["option"])}


def verdict_analysis(results: DataFrame, distractors: DataFrame, target: str = "NTA") -> dict:
    """The second analysis entry: verdict counts, shares and their change, tests of shares and foundations.

    ``results``: verdict result rows (model_id, distractor_id, verdict, foundation scores).
    """
    r = C.attach_condition(results, distractors)
    r = r.withColumn("distractor_type", SH.distractor_type(F.col("condition")))
    by = ["model_id", "distractor_type"]
    shares = SH.verdict_shares(r, by)
    return {"shares": shares, "delta": SH.share_delta(shares), "contingency": SH.contingency(r, by),
            "target_counts": SH.conditional_counts(r, by, target), "foundation_means": SH.mean_scores(r, by),
            "chi_square": SG.chi_square_tests(r), "unmatched": C.unmatched_arms(results, distractors)}
