"""Registered queries: ``name -> (spark_fn(spark, sf_dir) -> DataFrame, oracle SQL | None)``.

Every query reads the driver tables (through the views in
``armature.sources.tables``) over their whole extent.  Floating outputs are
rounded to 6 decimals on both sides because the checker hashes values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from armature.operators import conditions as C
from armature.operators import effects as E
from armature.plans.views_sql import with_views
from armature.sources import tables as V

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}

DP = 6


def register(name: str, sql: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def rounded(df: DataFrame, dp: int = DP) -> DataFrame:
    """Round every double column (the oracle does the same)."""
    return df.select(*[F.round(F.col(f.name), dp).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def _r(expr: str, alias: str) -> str:
    return f"round({expr}, {DP}) AS {alias}"


# SQL fragment: the statistics block used by every effects query (reference semantics)
def _stats_sql(score: str, diff: str) -> str:
    return ", ".join([
        _r(f"avg({score})", "mean_score"), _r(f"avg({diff})", "mean_diff"),
        _r(f"stddev_pop({score})", "sd_score"), _r(f"stddev_pop({diff})", "sd_diff"),
        _r(f"stddev_pop({score}) / sqrt(count(*))", "se_score"),
        _r(f"stddev_pop({diff}) / sqrt(count(*))", "se_diff"),
        "count(*) AS n_rows"])


def _with_condition(spark, sf_dir, df):
    return C.attach_condition(df, V.distractors(spark, sf_dir))


# ---------------------------------------------------------------------------
# MoralChoice MMAP
# ---------------------------------------------------------------------------

_MMAP_BASE_SQL = """
WITH r0 AS (
  SELECT r.*, CASE WHEN r.distractor_id IS NULL THEN 'baseline' ELSE coalesce(d.sentiment, 'unknown') END AS condition
  FROM v_responses r LEFT JOIN v_distractors d ON r.distractor_id = d.id),
bad AS (SELECT DISTINCT model_id, baseline_id FROM v_responses WHERE a1_prob + a2_prob = 0),
r AS (SELECT r0.* FROM r0 ANTI JOIN bad USING (model_id, baseline_id)),
fc AS (SELECT id, rule, a1 FROM v_scenario_rules WHERE (a1 = 'No' AND a2 = 'Yes') OR (a1 = 'Yes' AND a2 = 'No')),
t AS (
  SELECT r.model_id, r.baseline_id, r.scenario_id, r.question_ordering, r.distractor_id, r.condition, fc.rule,
         CASE WHEN fc.a1 = 'No' THEN r.a1_prob ELSE r.a2_prob END / nullif(r.a1_prob + r.a2_prob, 0) AS mmap
  FROM r JOIN fc ON r.scenario_id = fc.id)
"""


@register("mmap_condition_means", with_views(_MMAP_BASE_SQL + f""",
j AS (SELECT t.model_id, t.condition, t.mmap, t.mmap - b.mmap AS diff
      FROM t LEFT JOIN (SELECT model_id, baseline_id, rule, mmap FROM t WHERE condition = 'baseline') b
      ON t.model_id = b.model_id AND t.baseline_id = b.baseline_id AND t.rule = b.rule)
SELECT model_id, condition, {_stats_sql('mmap', 'diff')}
FROM j WHERE condition <> 'unknown' GROUP BY model_id, condition
""", "v_distractors", "v_scenario_rules", "v_responses"))
def q_mmap_condition_means(spark, sf_dir):
    r = _with_condition(spark, sf_dir, V.responses(spark, sf_dir))
    return rounded(E.mmap_condition_means(r, V.scenario_rules(spark, sf_dir)))


_NAN_ROWS = "scenario_id % 13 = 0 AND question_ordering = 1"


@register("mmap_nan_means", REGISTRY["mmap_condition_means"][1].replace(
    "l_discount AS a1_prob", "CASE WHEN l_partkey % 13 = 0 AND l_linenumber % 2 = 1 THEN NULL ELSE l_discount END AS a1_prob"))
def q_mmap_nan_means(spark, sf_dir):
    """P23 where some stored probabilities are NaN: they are left out, as missing ones are."""
    r = V.responses(spark, sf_dir).withColumn("a1_prob", F.when(F.expr(_NAN_ROWS), F.lit(float("nan"))).otherwise(F.col("a1_prob")))
    return rounded(E.mmap_condition_means(_with_condition(spark, sf_dir, r), V.scenario_rules(spark, sf_dir)))


@register("unmatched_arms", with_views("""
SELECT r.model_id, r.distractor_id, count(*) AS n FROM v_responses r
WHERE r.distractor_id IS NOT NULL AND r.distractor_id NOT IN (SELECT id FROM v_distractors WHERE modality = 'text')
GROUP BY r.model_id, r.distractor_id
""", "v_distractors", "v_responses"))
def q_unmatched_arms(spark, sf_dir):
    """Q1: stored arms that the registry in use (text distractors only) does not have."""
    return C.unmatched_arms(V.responses(spark, sf_dir), V.distractors(spark, sf_dir).where("modality = 'text'"))


@register("mmap_by_rule", with_views("""
WITH r AS (
  SELECT r.*, CASE WHEN r.distractor_id IS NULL THEN 'baseline' ELSE coalesce(d.sentiment, 'unknown') END AS condition
  FROM v_responses r LEFT JOIN v_distractors d ON r.distractor_id = d.id),
fc AS (SELECT id, rule, a1 FROM v_scenario_rules WHERE (a1 = 'No' AND a2 = 'Yes') OR (a1 = 'Yes' AND a2 = 'No')),
t AS (SELECT r.model_id, r.condition, fc.rule,
             CASE WHEN fc.a1 = 'No' THEN r.a1_prob ELSE r.a2_prob END / nullif(r.a1_prob + r.a2_prob, 0) AS mmap
      FROM r JOIN fc ON r.scenario_id = fc.id),
a AS (SELECT model_id, condition, rule, count(*) AS n, avg(mmap) AS m FROM t GROUP BY ALL),
grid AS (SELECT m.model_id, c.condition, u.rule FROM (SELECT DISTINCT model_id FROM v_responses) m
         CROSS JOIN (VALUES ('baseline'), ('positive'), ('neutral'), ('negative')) c(condition)
         CROSS JOIN (SELECT DISTINCT rule FROM v_scenario_rules) u)
SELECT g.model_id, g.condition, g.rule, round(CASE WHEN a.n IS NULL THEN 0.0 ELSE a.m END, 6) AS mean_mmap
FROM grid g LEFT JOIN a USING (model_id, condition, rule)
""", "v_distractors", "v_scenario_rules", "v_responses"))
def q_mmap_by_rule(spark, sf_dir):
    r = _with_condition(spark, sf_dir, V.responses(spark, sf_dir))
    return rounded(E.mmap_by_rule(r, V.scenario_rules(spark, sf_dir)))


@register("mmap_effect_rows", with_views(_MMAP_BASE_SQL + """,
b AS (SELECT model_id, baseline_id, rule, avg(mmap) AS mmap_base FROM t WHERE condition = 'baseline' GROUP BY ALL)
SELECT t.model_id, t.scenario_id, t.question_ordering, t.distractor_id, t.condition, t.rule,
       round(t.mmap, 6) AS mmap, round(b.mmap_base, 6) AS mmap_base, round(t.mmap - b.mmap_base, 6) AS mmap_diff
FROM t LEFT JOIN b ON t.model_id = b.model_id AND t.baseline_id = b.baseline_id AND t.rule = b.rule
""", "v_distractors", "v_scenario_rules", "v_responses"))
def q_mmap_effect_rows(spark, sf_dir):
    r = _with_condition(spark, sf_dir, V.responses(spark, sf_dir))
    return rounded(E.mmap_effect_rows(r, V.scenario_rules(spark, sf_dir)))


@register("forced_choice_rows", with_views("""
SELECT id, rule, a1, a2, CASE WHEN a1 = 'No' THEN 1 ELSE 2 END AS good_action
FROM v_scenario_rules WHERE (a1 = 'No' AND a2 = 'Yes') OR (a1 = 'Yes' AND a2 = 'No')
""", "v_scenario_rules"))
def q_forced_choice_rows(spark, sf_dir):
    fc = E.forced_choice(V.scenario_rules(spark, sf_dir))
    return fc.select("id", "rule", "a1", "a2",
                     F.when(F.col("a1") == "No", F.lit(1)).otherwise(F.lit(2)).alias("good_action"))


@register("invalid_key_filter", with_views("""
SELECT model_id, baseline_id, count(*) AS n_rows, count(*) FILTER (WHERE a1_prob + a2_prob = 0) AS n_zero
FROM v_responses GROUP BY model_id, baseline_id HAVING count(*) FILTER (WHERE a1_prob + a2_prob = 0) > 0
""", "v_responses"))
def q_invalid_key_filter(spark, sf_dir):
    r = V.responses(spark, sf_dir)
    zero = (F.col("a1_prob") + F.col("a2_prob")) == 0
    return (r.groupBy("model_id", "baseline_id")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(zero).alias("n_zero"))
            .where(F.col("n_zero") > 0))


# ---------------------------------------------------------------------------
# Option families
# ---------------------------------------------------------------------------

def _option_stats_sql(view: str, options: list[str], key: str, normalise: bool, drop_zero: bool,
                      suffix: str) -> str:
    total = " + ".join(f"coalesce({o}{suffix}, 0)" for o in options)
    share = (lambda o, p="": f"{p}{o}{suffix} / nullif({total.replace('coalesce(', 'coalesce(' + p)}, 0)") \
        if normalise else (lambda o, p="": f"{p}{o}{suffix}")
    bad = (f"bad AS (SELECT DISTINCT model_id, {key} FROM {view} WHERE {total} = 0),"
           if drop_zero else "bad AS (SELECT NULL AS model_id, NULL AS " + key + " WHERE false),")
    unions = "\nUNION ALL\n".join(
        f"SELECT r.model_id, '{o}' AS option, r.condition, {share(o, 'r.')} AS score, "
        f"{share(o, 'r.')} - {share(o, 'b.')} AS diff "
        f"FROM r LEFT JOIN (SELECT * FROM r WHERE condition = 'baseline') b "
        f"ON r.model_id = b.model_id AND r.{key} = b.{key}"
        for o in options)
    return f"""
WITH r0 AS (
  SELECT x.*, CASE WHEN x.distractor_id IS NULL THEN 'baseline' ELSE coalesce(d.sentiment, 'unknown') END AS condition
  FROM {view} x LEFT JOIN v_distractors d ON x.distractor_id = d.id),
{bad}
r AS (SELECT r0.* FROM r0 ANTI JOIN bad USING (model_id, {key})),
u AS ({unions})
SELECT model_id, option, condition, {_stats_sql('score', 'diff')}
FROM u WHERE condition <> 'unknown' GROUP BY model_id, option, condition
"""


def _option_query(name, view_fn, view, options, normalise, drop_zero, suffix):
    sql = with_views(_option_stats_sql(view, options, "scenario_id", normalise, drop_zero, suffix),
                     "v_distractors", view)

    @register(name, sql)
    def q(spark, sf_dir):
        df = _with_condition(spark, sf_dir, view_fn(spark, sf_dir))
        return rounded(E.paired_effects(df, options, "scenario_id", normalise, drop_zero, suffix))
    return q


_option_query("option_share_means", V.option_responses, "v_option_responses",
              ["good", "ok", "bad"], True, True, "_prob")
_option_query("verdict_prob_means", V.verdict_probs, "v_verdict_probs",
              ["esh", "yta", "nta", "nah", "info"], True, True, "_prob")
_option_query("foundation_means", V.foundations, "v_foundations",
              ["ch", "fc", "lb", "as", "pd"], False, False, "_score")


@register("option_share_rows", with_views("""
WITH r0 AS (
  SELECT x.*, CASE WHEN x.distractor_id IS NULL THEN 'baseline' ELSE coalesce(d.sentiment, 'unknown') END AS condition,
         coalesce(good_prob, 0) + coalesce(ok_prob, 0) + coalesce(bad_prob, 0) AS total
  FROM v_option_responses x LEFT JOIN v_distractors d ON x.distractor_id = d.id),
bad AS (SELECT DISTINCT model_id, scenario_id FROM r0 WHERE total = 0),
r AS (SELECT r0.* FROM r0 ANTI JOIN bad USING (model_id, scenario_id)),
l AS (SELECT event_id, model_id, scenario_id, condition, o.option,
             CASE o.option WHEN 'good' THEN good_prob WHEN 'ok' THEN ok_prob ELSE bad_prob END / nullif(total, 0) AS share
      FROM r CROSS JOIN (VALUES ('good'), ('ok'), ('bad')) o(option)),
b AS (SELECT model_id, scenario_id, option, avg(share) AS share_base FROM l WHERE condition = 'baseline' GROUP BY ALL)
SELECT l.event_id, l.model_id, l.scenario_id, l.condition, l.option, round(l.share, 6) AS share,
       round(b.share_base, 6) AS share_base, round(l.share - b.share_base, 6) AS share_diff
FROM l LEFT JOIN b USING (model_id, scenario_id, option)
""", "v_distractors", "v_option_responses"))
def q_option_share_rows(spark, sf_dir):
    df = _with_condition(spark, sf_dir, V.option_responses(spark, sf_dir))
    return rounded(E.option_effect_rows(df, ["good", "ok", "bad"], "event_id"))


@register("foundation_effect_rows", with_views("""
WITH r AS (
  SELECT x.*, CASE WHEN x.distractor_id IS NULL THEN 'baseline' ELSE coalesce(d.sentiment, 'unknown') END AS condition
  FROM v_foundations x LEFT JOIN v_distractors d ON x.distractor_id = d.id),
l AS (SELECT vec_id, model_id, scenario_id, condition, o.option,
             CASE o.option WHEN 'ch' THEN ch_score WHEN 'fc' THEN fc_score WHEN 'lb' THEN lb_score
                           WHEN 'as' THEN as_score ELSE pd_score END AS share
      FROM r CROSS JOIN (VALUES ('ch'), ('fc'), ('lb'), ('as'), ('pd')) o(option)),
b AS (SELECT model_id, scenario_id, option, avg(share) AS share_base FROM l WHERE condition = 'baseline' GROUP BY ALL)
SELECT l.vec_id, l.model_id, l.scenario_id, l.condition, l.option, round(l.share, 6) AS share,
       round(b.share_base, 6) AS share_base, round(l.share - b.share_base, 6) AS share_diff
FROM l LEFT JOIN b USING (model_id, scenario_id, option)
""", "v_distractors", "v_foundations"))
def q_foundation_effect_rows(spark, sf_dir):
    df = _with_condition(spark, sf_dir, V.foundations(spark, sf_dir))
    return rounded(E.option_effect_rows(df, ["ch", "fc", "lb", "as", "pd"], "vec_id", normalise=False,
                                        drop_zero=False, suffix="_score"))


@register("large_score_means", with_views("""
WITH r AS (
  SELECT x.model_id, x.scenario_id, 1000000.0::DOUBLE + x.score * 0.00001::DOUBLE AS score,
         CASE WHEN x.distractor_id IS NULL THEN 'baseline' ELSE coalesce(d.sentiment, 'unknown') END AS condition
  FROM v_option_responses x LEFT JOIN v_distractors d ON x.distractor_id = d.id),
b AS (SELECT model_id, scenario_id, score AS base FROM r WHERE condition = 'baseline'),
j AS (SELECT r.model_id, r.condition, r.score, r.score - b.base AS diff FROM r LEFT JOIN b USING (model_id, scenario_id))
SELECT model_id, condition, round(avg(score), 6) AS mean_score, round(avg(diff) * 1000, 6) AS diff_milli,
       round(stddev_pop(score) * 1000, 6) AS sd_score_milli, round(stddev_pop(diff) * 1000, 6) AS sd_diff_milli, count(*) AS n_rows
FROM j WHERE condition <> 'unknown' GROUP BY model_id, condition
""", "v_distractors", "v_option_responses"))
def q_large_score_means(spark, sf_dir):
    """A5/A6 where scores are large and close together: deviations in thousandths."""
    df = _with_condition(spark, sf_dir, V.option_responses(spark, sf_dir)).withColumn("x_score", F.lit(1e6) + F.col("score") * F.lit(0.00001))
    m = E.paired_effects(df, ["x"], "scenario_id", normalise=False, drop_zero=False, suffix="_score")
    return m.select("model_id", "condition", F.round("mean_score", 6).alias("mean_score"), *[
        F.round(F.col(c) * 1000, 6).alias(n) for c, n in (
            ("mean_diff", "diff_milli"), ("sd_score", "sd_score_milli"), ("sd_diff", "sd_diff_milli"))], "n_rows")


# ---------------------------------------------------------------------------
# Verdict shares and foundation summaries (reddit analysis family)
# ---------------------------------------------------------------------------
from armature.functions import stats as ST  # noqa: E402
from armature.operators import shares as SH  # noqa: E402
from armature.operators import significance as SG  # noqa: E402
from armature.schemas import FOUNDATION_LABELS, VERDICTS  # noqa: E402

_VR = """vr AS (
  SELECT x.*, CASE WHEN x.distractor_id IS NULL THEN 'baseline'
                   ELSE CASE d.sentiment WHEN 'positive' THEN 'pos' WHEN 'neutral' THEN 'neu'
                                         WHEN 'negative' THEN 'neg' END END AS distractor_type
  FROM v_option_responses x LEFT JOIN v_distractors d ON x.distractor_id = d.id)"""

_FR = """fr AS (
  SELECT x.*, CASE WHEN x.distractor_id IS NULL THEN 'baseline' ELSE coalesce(d.sentiment, 'unknown') END AS condition,
         CASE WHEN x.distractor_id IS NULL THEN 'baseline'
              ELSE CASE d.sentiment WHEN 'positive' THEN 'pos' WHEN 'neutral' THEN 'neu'
                                    WHEN 'negative' THEN 'neg' END END AS distractor_type
  FROM v_foundations x LEFT JOIN v_distractors d ON x.distractor_id = d.id)"""


def _verdict_frame(spark, sf_dir):
    df = _with_condition(spark, sf_dir, V.option_responses(spark, sf_dir))
    return df.withColumn("distractor_type", SH.distractor_type(F.col("condition")))


def _foundation_frame(spark, sf_dir):
    df = _with_condition(spark, sf_dir, V.foundations(spark, sf_dir))
    return df.withColumn("distractor_type", SH.distractor_type(F.col("condition")))


@register("verdict_shares", with_views(f"""
WITH {_VR}, c AS (SELECT model_id, distractor_type, verdict, count(*) AS count FROM vr
                  WHERE verdict IS NOT NULL GROUP BY ALL)
SELECT model_id, distractor_type, verdict, count,
       round(count / sum(count) OVER (PARTITION BY model_id, distractor_type), 6) AS share FROM c
""", "v_distractors", "v_option_responses"))
def q_verdict_shares(spark, sf_dir):
    return rounded(SH.verdict_shares(_verdict_frame(spark, sf_dir), ["model_id", "distractor_type"]))


@register("verdict_shares_overall", with_views("""
WITH c AS (SELECT model_id, verdict, count(*) AS count FROM v_option_responses WHERE verdict IS NOT NULL GROUP BY ALL)
SELECT model_id, verdict, count, round(count / sum(count) OVER (PARTITION BY model_id), 6) AS share FROM c
""", "v_option_responses"))
def q_verdict_shares_overall(spark, sf_dir):
    return rounded(SH.verdict_shares(V.option_responses(spark, sf_dir), ["model_id"]))


@register("verdict_share_delta", with_views(f"""
WITH {_VR}, c AS (SELECT model_id, distractor_type, verdict, count(*) AS count FROM vr
                  WHERE verdict IS NOT NULL GROUP BY ALL),
s AS (SELECT *, count / sum(count) OVER (PARTITION BY model_id, distractor_type) AS share FROM c),
grid AS (SELECT p.model_id, p.distractor_type, v.verdict
         FROM (SELECT DISTINCT model_id, distractor_type FROM s WHERE distractor_type <> 'baseline') p
         CROSS JOIN (SELECT DISTINCT verdict FROM s) v),
b AS (SELECT model_id, verdict, share AS share_base FROM s WHERE distractor_type = 'baseline')
SELECT g.model_id, g.distractor_type, g.verdict, round(coalesce(s.share, 0), 6) AS share,
       round(coalesce(b.share_base, 0), 6) AS share_base,
       round(coalesce(s.share, 0) - coalesce(b.share_base, 0), 6) AS delta
FROM grid g LEFT JOIN s USING (model_id, distractor_type, verdict) LEFT JOIN b USING (model_id, verdict)
""", "v_distractors", "v_option_responses"))
def q_verdict_share_delta(spark, sf_dir):
    s = SH.verdict_shares(_verdict_frame(spark, sf_dir), ["model_id", "distractor_type"])
    return rounded(SH.share_delta(s))


@register("verdict_contingency", with_views(f"""
WITH {_VR}
SELECT model_id, distractor_type, {", ".join(f"count(*) FILTER (WHERE verdict = '{v}') AS {v}" for v in VERDICTS)}
FROM vr WHERE verdict IS NOT NULL GROUP BY model_id, distractor_type
""", "v_distractors", "v_option_responses"))
def q_verdict_contingency(spark, sf_dir):
    return SH.contingency(_verdict_frame(spark, sf_dir), ["model_id", "distractor_type"])


# the same tables where some results carry a verdict outside the known ones
_OPEN_VR = _VR.replace("SELECT x.*,", "SELECT x.* REPLACE (CASE WHEN x.event_id % 9 = 0 THEN 'Unclear' ELSE x.verdict END AS verdict),")


def _open_verdict_frame(spark, sf_dir):
    return _verdict_frame(spark, sf_dir).withColumn(
        "verdict", F.when(F.col("event_id") % 9 == 0, F.lit("Unclear")).otherwise(F.col("verdict")))


@register("open_verdict_delta", REGISTRY["verdict_share_delta"][1].replace(_VR, _OPEN_VR))
def q_open_verdict_delta(spark, sf_dir):
    return rounded(SH.share_delta(SH.verdict_shares(_open_verdict_frame(spark, sf_dir), ["model_id", "distractor_type"])))


@register("open_verdict_contingency", with_views(f"""
WITH {_OPEN_VR}
SELECT model_id, distractor_type, {", ".join(f"count(*) FILTER (WHERE verdict = '{v}') AS {v}" for v in [*VERDICTS, "Unclear"])}
FROM vr WHERE verdict IS NOT NULL GROUP BY model_id, distractor_type
""", "v_distractors", "v_option_responses"))
def q_open_verdict_contingency(spark, sf_dir):
    return SH.contingency(_open_verdict_frame(spark, sf_dir), ["model_id", "distractor_type"])


@register("verdict_conditional_counts", with_views(f"""
WITH {_VR}
SELECT model_id, distractor_type, count(*) AS n, count(*) FILTER (WHERE verdict = 'NTA') AS k
FROM vr GROUP BY model_id, distractor_type
""", "v_distractors", "v_option_responses"))
def q_verdict_conditional_counts(spark, sf_dir):
    return SH.conditional_counts(_verdict_frame(spark, sf_dir), ["model_id", "distractor_type"], "NTA")


_TOP_SQL = "CASE " + " ".join(
    f"WHEN {c} = greatest({', '.join(FOUNDATION_LABELS)}) THEN '{lab}'" for c, lab in FOUNDATION_LABELS.items()) + " END"


@register("top_foundation_shares", with_views(f"""
WITH t AS (SELECT model_id, {_TOP_SQL} AS top_foundation FROM v_foundations),
c AS (SELECT model_id, top_foundation, count(*) AS count FROM t WHERE top_foundation IS NOT NULL GROUP BY ALL)
SELECT model_id, top_foundation, count, round(count / sum(count) OVER (PARTITION BY model_id), 6) AS share FROM c
""", "v_foundations"))
def q_top_foundation_shares(spark, sf_dir):
    t = V.foundations(spark, sf_dir).select("model_id", SH.top_foundation().alias("top_foundation"))
    return rounded(SH.verdict_shares(t, ["model_id"], verdict="top_foundation"))


_MELT_SQL = "\nUNION ALL\n".join(
    f"SELECT vec_id, model_id, condition, '{lab}' AS foundation, round({c}, 6) AS score FROM fr"
    for c, lab in FOUNDATION_LABELS.items())


@register("foundation_melt", with_views(f"WITH {_FR}\n{_MELT_SQL}", "v_distractors", "v_foundations"))
def q_foundation_melt(spark, sf_dir):
    f = _with_condition(spark, sf_dir, V.foundations(spark, sf_dir))
    return rounded(SH.melt_foundations(f, ["vec_id", "model_id", "condition"]))


@register("foundation_model_means", with_views(
    "SELECT model_id, " + ", ".join(_r(f"avg({c})", c) for c in FOUNDATION_LABELS)
    + " FROM v_foundations GROUP BY model_id", "v_foundations"))
def q_foundation_model_means(spark, sf_dir):
    return rounded(SH.mean_scores(V.foundations(spark, sf_dir), ["model_id"]))


@register("foundation_condition_means", with_views(
    f"WITH {_FR} SELECT model_id, condition, " + ", ".join(_r(f"avg({c})", c) for c in FOUNDATION_LABELS)
    + " FROM fr GROUP BY model_id, condition", "v_distractors", "v_foundations"))
def q_foundation_condition_means(spark, sf_dir):
    f = _with_condition(spark, sf_dir, V.foundations(spark, sf_dir))
    return rounded(SH.mean_scores(f, ["model_id", "condition"]))


# ---------------------------------------------------------------------------
# Tests: two-proportion z, Wilson, chi-square, Kruskal-Wallis, Holm, Holm-Sidak
# ---------------------------------------------------------------------------

def _ztest_sql(targets: list[str]) -> str:
    tv = ", ".join(f"('{t}')" for t in targets)
    return f"""{_VR},
cc AS (SELECT model_id, distractor_type, t.target, count(*) AS n, count(*) FILTER (WHERE verdict = t.target) AS k
       FROM vr CROSS JOIN (VALUES {tv}) t(target) GROUP BY ALL),
zb AS (SELECT c.model_id, c.target, c.distractor_type || ' vs baseline' AS comparison,
              CAST(coalesce(b.k, 0) AS DOUBLE) / nullif(coalesce(b.n, 0), 0) AS baseline,
              CAST(c.k AS DOUBLE) / nullif(c.n, 0) AS comp,
              c.k AS k1, c.n AS n1, coalesce(b.k, 0) AS k0, coalesce(b.n, 0) AS n0
       FROM cc c LEFT JOIN (SELECT * FROM cc WHERE distractor_type = 'baseline') b
            ON c.model_id = b.model_id AND c.target = b.target
       WHERE c.distractor_type IN ('neg', 'neu', 'pos')),
zp AS (SELECT *, CAST(k1 + k0 AS DOUBLE) / nullif(n1 + n0, 0) AS pp FROM zb),
zz AS (SELECT *, comp - baseline AS delta,
              (comp - baseline) / nullif(sqrt(pp * (1 - pp) * (1.0 / nullif(n1, 0) + 1.0 / nullif(n0, 0))), 0) AS z FROM zp),
zx AS (SELECT *, abs(z) / sqrt(2.0) AS _x FROM zz),
zt AS (SELECT model_id, target, comparison, baseline, comp, delta, z, {ST.erfc_duck_sql('_x')} AS p FROM zx)"""


def _ztests(spark, sf_dir, targets):
    return SG.two_proportion_tests(_verdict_frame(spark, sf_dir), targets)


@register("two_prop_ztest", with_views(f"""
WITH {_ztest_sql(['NTA'])}
SELECT model_id, comparison, round(baseline, 6) AS baseline, round(comp, 6) AS comp, round(delta, 6) AS delta,
       round(z, 6) AS z, round(p, 6) AS p, round(p_adj, 6) AS p_adj
FROM {ST.holm_sql('zt', 'p')}
""", "v_distractors", "v_option_responses"))
def q_two_prop_ztest(spark, sf_dir):
    z = SG.two_proportion_tests(_verdict_frame(spark, sf_dir), "NTA").drop("target")
    return rounded(ST.holm(z, "p", "p_adj"))


@register("holm_sidak_adjust", with_views(f"""
WITH {_ztest_sql(VERDICTS)}
SELECT model_id, target, comparison, round(p, 6) AS p, round(p_adj, 6) AS p_adj
FROM {ST.holm_sidak_sql('zt', 'p')}
""", "v_distractors", "v_option_responses"))
def q_holm_sidak_adjust(spark, sf_dir):
    z = _ztests(spark, sf_dir, VERDICTS)
    return rounded(ST.holm_sidak(z, "p", "p_adj").select("model_id", "target", "comparison", "p", "p_adj"))


@register("neg_log10_p", with_views(f"""
WITH {_ztest_sql(VERDICTS)}
SELECT model_id, target, comparison, round(-log10(p_adj), 6) AS neg_log10_p
FROM {ST.holm_sql('zt', 'p', 'target')}
""", "v_distractors", "v_option_responses"))
def q_neg_log10_p(spark, sf_dir):
    z = ST.holm(_ztests(spark, sf_dir, VERDICTS), "p", "p_adj", by=["target"])
    return rounded(z.select("model_id", "target", "comparison", (-F.log10("p_adj")).alias("neg_log10_p")))


@register("wilson_ci", with_views(f"""
WITH {_VR}, cc AS (SELECT model_id, distractor_type, count(*) AS n, count(*) FILTER (WHERE verdict = 'NTA') AS k
                   FROM vr GROUP BY ALL),
w AS (SELECT *, CAST(k AS DOUBLE) / n AS ph, {ST._lit(1.959963984540054)} AS z FROM cc)
SELECT model_id, distractor_type, round(ph, 6) AS share,
       round((ph + z*z / (2*n)) / (1 + z*z / n) - z * sqrt(ph * (1 - ph) / n + z*z / (4*n*n)) / (1 + z*z / n), 6) AS ci_lo,
       round((ph + z*z / (2*n)) / (1 + z*z / n) + z * sqrt(ph * (1 - ph) / n + z*z / (4*n*n)) / (1 + z*z / n), 6) AS ci_hi
FROM w
""", "v_distractors", "v_option_responses"))
def q_wilson_ci(spark, sf_dir):
    return rounded(SG.wilson_table(_verdict_frame(spark, sf_dir), "NTA"))


_CHI2_SQL = f"""WITH {_VR}, obs AS (SELECT model_id, distractor_type, verdict, count(*) AS o FROM vr WHERE verdict IS NOT NULL GROUP BY ALL),
ty AS (SELECT DISTINCT model_id, distractor_type FROM obs), ve AS (SELECT DISTINCT model_id, verdict FROM obs),
cells AS (SELECT t.model_id, t.distractor_type, v.verdict, coalesce(o.o, 0) AS o
          FROM ty t JOIN ve v USING (model_id) LEFT JOIN obs o USING (model_id, distractor_type, verdict)),
rt AS (SELECT model_id, distractor_type, sum(o) AS rt FROM obs GROUP BY ALL),
ct AS (SELECT model_id, verdict, sum(o) AS ct FROM obs GROUP BY ALL),
tot AS (SELECT model_id, sum(o) AS nt, count(DISTINCT distractor_type) AS nr, count(DISTINCT verdict) AS nc FROM obs GROUP BY ALL),
e AS (SELECT cells.model_id, cells.o, rt * ct / CAST(nt AS DOUBLE) AS e, (nr - 1) * (nc - 1) AS dof
      FROM cells JOIN rt USING (model_id, distractor_type) JOIN ct USING (model_id, verdict) JOIN tot USING (model_id))
SELECT model_id,
       sum(CASE WHEN dof = 0 THEN 0.0
                      WHEN dof = 1 THEN power(o + sign(e - o) * least(0.5, abs(e - o)) - e, 2) / e
                      ELSE power(o - e, 2) / e END) AS chi2,
       CAST(max(dof) AS BIGINT) AS dof
FROM e GROUP BY model_id
"""


@register("chi2_stat", with_views(f"""
WITH st AS (
{_CHI2_SQL})
SELECT model_id, round(chi2, 6) AS chi2, dof FROM st
""", "v_distractors", "v_option_responses"))
def q_chi2_stat(spark, sf_dir):
    return rounded(SG.chi_square_tests(_verdict_frame(spark, sf_dir)))


@register("chi2_tests", with_views(f"""
WITH st AS (
{_CHI2_SQL}),
sp AS (SELECT model_id, chi2, dof, {ST.chi2_sf_duck('chi2', 'dof')} AS p FROM st)
SELECT model_id, round(chi2, 6) AS chi2, dof, round(p, 6) AS p, round(p_adj, 6) AS p_adj
FROM {ST.holm_sql('sp', 'p')}
""", "v_distractors", "v_option_responses"))
def q_chi2_tests(spark, sf_dir):
    """T4 with p-values (chi-square tail) and Holm adjustment - rows-only check."""
    t = SG.with_chi2_p(SG.chi_square_tests(_verdict_frame(spark, sf_dir)), "chi2", "dof")
    return rounded(ST.holm(t, "p", "p_adj"))


_KW_MELT = "\nUNION ALL\n".join(
    f"SELECT model_id, distractor_type, '{lab}' AS foundation, {c} AS score FROM fr"
    for c, lab in FOUNDATION_LABELS.items())


_KW_SQL = f"""WITH {_FR}, m AS ({_KW_MELT}),
x AS (SELECT * FROM m WHERE score IS NOT NULL AND NOT isnan(score)),
rk AS (SELECT *, rank() OVER (PARTITION BY model_id, foundation ORDER BY score)
                 + (count(*) OVER (PARTITION BY model_id, foundation, score) - 1) / 2.0 AS rnk FROM x),
rs AS (SELECT model_id, foundation, distractor_type, sum(rnk) AS r_sum, count(*) AS n_g FROM rk GROUP BY ALL),
ts AS (SELECT model_id, foundation, sum(c * c * c - c) AS t3, sum(c) AS n
       FROM (SELECT model_id, foundation, score, CAST(count(*) AS DOUBLE) AS c FROM x GROUP BY ALL) GROUP BY ALL),
g AS (SELECT model_id, foundation, sum(r_sum * r_sum / n_g) AS ssbn, count(*) AS k FROM rs GROUP BY ALL)
SELECT g.model_id, g.foundation,
       (12.0 / (n * (n + 1)) * ssbn - 3 * (n + 1)) / nullif(1 - t3 / (n * n * n - n), 0) AS H,
       k - 1 AS dof
FROM g JOIN ts USING (model_id, foundation) WHERE k >= 2
"""


@register("kruskal_h", with_views(f"""
WITH kw AS (
{_KW_SQL})
SELECT model_id, foundation, round(H, 6) AS H, dof FROM kw
""", "v_distractors", "v_foundations"))
def q_kruskal_h(spark, sf_dir):
    m = SH.melt_foundations(_foundation_frame(spark, sf_dir), ["model_id", "distractor_type"])
    return rounded(SG.kruskal_tests(m, ["model_id", "foundation"], "distractor_type", "score"))


@register("kruskal_tests", with_views(f"""
WITH kw AS (
{_KW_SQL}),
kp AS (SELECT model_id, foundation, H, dof, {ST.chi2_sf_duck('H', 'dof')} AS p FROM kw)
SELECT model_id, foundation, round(H, 6) AS H, dof, round(p, 6) AS p, round(p_adj, 6) AS p_adj
FROM {ST.holm_sql('kp', 'p')}
""", "v_distractors", "v_foundations"))
def q_kruskal_tests(spark, sf_dir):
    """T5 with chi-square p-values and Holm adjustment - rows-only check."""
    m = SH.melt_foundations(_foundation_frame(spark, sf_dir), ["model_id", "distractor_type"])
    k = SG.with_chi2_p(SG.kruskal_tests(m, ["model_id", "foundation"], "distractor_type", "score"), "H", "dof")
    return rounded(ST.holm(k, "p", "p_adj"))


# ---------------------------------------------------------------------------
# Response text: verdicts, reasoning, answer extraction, ids (whole texts)
# ---------------------------------------------------------------------------
from armature.functions import text as TX  # noqa: E402

_RT_SQL = "rt AS (SELECT doc_id, " + TX.strip_sql("coalesce(nullif(answer, ''), '')") + " AS t FROM v_text_responses)"


def _response_text(spark, sf_dir):
    return V.text_responses(spark, sf_dir).select("doc_id", TX.response_text(F.col("answer")).alias("t"))


@register("verdict_extract", with_views(f"""
WITH {_RT_SQL}
SELECT doc_id, CASE WHEN regexp_matches(t, {TX._q(TX._CI_SQL + TX.VERDICT_BODY)})
                    THEN upper(regexp_extract(t, {TX._q(TX._CI_SQL + TX.VERDICT_BODY)}, 1)) END AS verdict_primary
FROM rt
""", "v_text_responses"))
def q_verdict_extract(spark, sf_dir):
    return _response_text(spark, sf_dir).select("doc_id", TX.verdict_primary(F.col("t")).alias("verdict_primary"))


@register("verdict_fallback", with_views(f"""
WITH {_RT_SQL}
SELECT doc_id, {TX.verdict_sql('t')} AS verdict FROM rt
""", "v_text_responses"))
def q_verdict_fallback(spark, sf_dir):
    return TX.extract_verdict_reasoning(_response_text(spark, sf_dir), "t", reasoning_col=None).select(
        "doc_id", "verdict")


@register("reasoning_extract", with_views(f"""
WITH {_RT_SQL}
SELECT doc_id, {TX.reasoning_sql('t')} AS reasoning FROM rt
""", "v_text_responses"))
def q_reasoning_extract(spark, sf_dir):
    return TX.extract_verdict_reasoning(_response_text(spark, sf_dir), "t").select("doc_id", "reasoning")


@register("answer_after_marker", f"""
SELECT conv_id, turn, {TX.strip_sql("string_split(role || chr(10) || text, 'assistant')[-1]")} AS answer
FROM conversations
""")
def q_answer_after_marker(spark, sf_dir):
    c = V.table(spark, sf_dir, "conversations")
    raw = F.concat(F.col("role"), F.lit("\n"), F.col("text"))
    return c.select("conv_id", "turn", TX.answer_after_marker(raw, "assistant").alias("answer"))


@register("answer_after_prompt", """
SELECT conv_id, turn, substr(role || ': ' || text, length(role || ': ') + 1) AS answer FROM conversations
""")
def q_answer_after_prompt(spark, sf_dir):
    """The answer of an output that repeats its prompt."""
    prompt = F.concat(F.col("role"), F.lit(": "))
    return V.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", TX.answer_after_prompt(F.concat(prompt, F.col("text")), prompt).alias("answer"))


@register("time_stamps", "SELECT event_id, strftime(ts, '%Y-%m-%d_%H:%M:%S') AS stamp FROM events")
def q_time_stamps(spark, sf_dir):
    """P27."""
    return V.table(spark, sf_dir, "events").select("event_id", TX.timestamp_stamp(F.col("ts")).alias("stamp"))


@register("safe_ids", """
SELECT page_id, coalesce(regexp_replace(url, '[^\\p{L}\\p{N}_\\-]', '_', 'g'), 'none') AS safe_url FROM pages
""")
def q_safe_ids(spark, sf_dir):
    p = V.table(spark, sf_dir, "pages")
    return p.select("page_id", TX.safe_identifier(F.col("url")).alias("safe_url"))


# ---------------------------------------------------------------------------
# Design, resumption, rendering, eligibility
# ---------------------------------------------------------------------------
from armature.operators import design as DS  # noqa: E402
from armature.operators import render as RD  # noqa: E402
from armature.sources.registry import TEMPLATES, template_parts  # noqa: E402

RUN_MODELS = ["A", "N", "R"]                 # run parameter: models to evaluate
CAPABILITIES = [("A", True), ("N", False), ("R", False)]   # run parameter: image support


def _sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _tmpl_sql(name: str, *args: str) -> str:
    _system, pieces = template_parts(name)
    out = [_sq(pieces[0])]
    for a, p in zip(args, pieces[1:]):
        out += [f"({a})", _sq(p)]
    return " || ".join(out)


_DESIGN_SQL = """design AS (
  SELECT id AS scenario_id, CAST(NULL AS BIGINT) AS distractor_id, CAST(NULL AS VARCHAR) AS distractor_modality,
         'ab' AS question_format FROM v_scenarios
  UNION ALL
  SELECT s.id, d.id, d.modality, 'ab' FROM v_scenarios s CROSS JOIN v_distractors d)"""


def _design(spark, sf_dir):
    s = V.scenarios(spark, sf_dir).select(F.col("id").alias("scenario_id"))
    return DS.design(s, V.distractors(spark, sf_dir).select("id", "modality"), ["ab"]).select(
        "scenario_id", "distractor_id", "distractor_modality", "question_format")


@register("design_cross", with_views(f"WITH {_DESIGN_SQL} SELECT * FROM design", "v_scenarios", "v_distractors"))
def q_design_cross(spark, sf_dir):
    return _design(spark, sf_dir)


@register("design_pending", with_views(f"""
WITH {_DESIGN_SQL},
x AS (SELECT m.model_id, d.scenario_id, d.distractor_id FROM design d
      CROSS JOIN (VALUES {", ".join(f"('{m}')" for m in RUN_MODELS)}) m(model_id))
SELECT * FROM x WHERE NOT EXISTS (
  SELECT 1 FROM v_responses r WHERE r.model_id = x.model_id AND r.scenario_id = x.scenario_id
    AND r.distractor_id IS NOT DISTINCT FROM x.distractor_id)
""", "v_scenarios", "v_distractors", "v_responses"))
def q_design_pending(spark, sf_dir):
    s = V.scenarios(spark, sf_dir).select(F.col("id").alias("scenario_id"))
    return DS.pending_models(s, V.distractors(spark, sf_dir).select("id"), V.done_pairs(spark, sf_dir), RUN_MODELS)


_STORE_SQL = """store AS (
  SELECT CASE WHEN l_quantity % 3 = 0 THEN 'pilot' ELSE 'main' END AS experiment,
         CASE WHEN l_linestatus = 'O' THEN 'moralchoice_high_ambiguity' ELSE 'moralchoice_low_ambiguity' END AS dataset,
         l_returnflag AS model_id, CASE WHEN l_orderkey % 2 = 0 THEN 'ab' ELSE 'compare' END AS question_format,
         l_partkey AS scenario_id, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_suppkey END AS distractor_id,
         l_linenumber % 2 AS question_ordering, CASE WHEN l_linenumber % 5 = 0 THEN 'failed' ELSE 'ok' END AS status
  FROM lineitem)"""


@register("resume_pending", with_views(f"""
WITH {_STORE_SQL},
arms AS (SELECT CAST(NULL AS BIGINT) AS distractor_id UNION ALL SELECT id FROM v_distractors),
x AS (SELECT s.id AS scenario_id, a.distractor_id, f.question_format, o.question_ordering FROM v_scenarios s CROSS JOIN arms a
      CROSS JOIN (VALUES ('ab'), ('compare')) f(question_format) CROSS JOIN (VALUES (0), (1)) o(question_ordering))
SELECT 'main' AS experiment, 'moralchoice_high_ambiguity' AS dataset, 'N' AS model_id, x.* FROM x WHERE NOT EXISTS (
  SELECT 1 FROM store r WHERE r.experiment = 'main' AND r.dataset = 'moralchoice_high_ambiguity' AND r.model_id = 'N'
    AND r.status = 'ok' AND r.question_format = x.question_format AND r.scenario_id = x.scenario_id
    AND r.distractor_id IS NOT DISTINCT FROM x.distractor_id AND r.question_ordering = x.question_ordering)
""", "v_scenarios", "v_distractors"))
def q_resume_pending(spark, sf_dir):
    from armature.operators.resume import resume_pending
    rows = resume_pending(V.scenarios(spark, sf_dir).select(F.col("id").alias("scenario_id")), V.distractors(spark, sf_dir).select("id"),
                          ["ab", "compare"], V.result_store(spark, sf_dir), experiment="main",
                          dataset="moralchoice_high_ambiguity", models=["N"], orderings=2)
    return rows.select("experiment", "dataset", "model_id", "scenario_id", "distractor_id", "question_format", "question_ordering")


@register("prompt_ids", with_views(f"""
WITH p AS (SELECT DISTINCT scenario_id, distractor_id, question_ordering FROM v_responses)
SELECT CAST(scenario_id AS VARCHAR) || '_' || coalesce(CAST(distractor_id AS VARCHAR), 'none') || '_'
       || CAST(question_ordering AS VARCHAR) || '_ab' AS prompt_id,
       's_' || regexp_replace(CAST(scenario_id AS VARCHAR), '[^\\p{{L}}\\p{{N}}_\\-]', '_', 'g') || '_d_'
       || coalesce(regexp_replace(CAST(distractor_id AS VARCHAR), '[^\\p{{L}}\\p{{N}}_\\-]', '_', 'g'), 'none') AS file_key
FROM p
""", "v_responses"))
def q_prompt_ids(spark, sf_dir):
    p = V.responses(spark, sf_dir).select("scenario_id", "distractor_id", "question_ordering").distinct()
    return p.select(DS.prompt_id(F.col("scenario_id"), F.col("distractor_id"), F.col("question_ordering"),
                                 F.lit("ab")).alias("prompt_id"),
                    DS.result_file_key(F.col("scenario_id"), F.col("distractor_id")).alias("file_key"))


@register("option_orderings", with_views("""
SELECT id, o.question_ordering, CASE WHEN o.question_ordering = 0 THEN action1 ELSE action2 END AS option_a,
       CASE WHEN o.question_ordering = 0 THEN action2 ELSE action1 END AS option_b
FROM v_scenarios CROSS JOIN (VALUES (0), (1)) o(question_ordering)
""", "v_scenarios"))
def q_option_orderings(spark, sf_dir):
    return DS.option_orderings(V.scenarios(spark, sf_dir)).select("id", "question_ordering", "option_a", "option_b")


def _distractor_texts(spark, sf_dir):
    b = V.table(spark, sf_dir, "benchmark")
    return b.select(F.concat(F.lit("asset/"), F.col("item_id").cast("string")).alias("file_path"),
                    F.col("text").alias("body"))


def _render_rows(spark, sf_dir, with_ordering: bool):
    keys = ["scenario_id", "distractor_id"] + (["question_ordering"] if with_ordering else [])
    pairs = V.responses(spark, sf_dir).select(*keys).distinct()
    s = V.scenarios(spark, sf_dir).select(F.col("id").alias("_sid"), "context", "action1", "action2")
    d = V.distractors(spark, sf_dir).select(F.col("id").alias("_did"), F.col("modality").alias("distractor_modality"),
                                            F.col("file_path").alias("distractor_file_path"))
    rows = (pairs.join(s, F.col("scenario_id") == F.col("_sid"), "inner")
            .join(C.small_side(d), F.col("distractor_id") == F.col("_did"), "left"))
    return RD.attach_distractor_text(rows, _distractor_texts(spark, sf_dir))


_TXT_SQL = f"""txt AS (SELECT 'asset/' || CAST(item_id AS VARCHAR) AS file_path, {TX.strip_sql('text')} AS body FROM benchmark)"""


def _render_rows_sql(with_ordering: bool) -> str:
    o = ", question_ordering" if with_ordering else ""
    return f"""{_TXT_SQL},
p AS (SELECT DISTINCT scenario_id, distractor_id{o} FROM v_responses),
rr AS (SELECT p.*, s.context, s.action1, s.action2, d.modality, t.body
       FROM p JOIN v_scenarios s ON p.scenario_id = s.id
       LEFT JOIN v_distractors d ON p.distractor_id = d.id
       LEFT JOIN txt t ON d.file_path = t.file_path)"""


def _inject_sql(ctx: str) -> str:
    return (f"CASE WHEN modality IS NULL THEN {ctx} WHEN modality = 'text' THEN "
            f"CASE WHEN length(coalesce(body, '')) > 0 THEN body || ' Later, ' || lower(substr({ctx}, 1, 1)) "
            f"|| substr({ctx}, 2) ELSE {ctx} END WHEN modality = 'image' THEN 'You see the scene in the image. ' "
            f"|| {ctx} ELSE {ctx} END")


@register("render_scenario_side", with_views(f"""
WITH {_render_rows_sql(True)},
x AS (SELECT *, {_inject_sql('context')} AS ctx,
             CASE WHEN question_ordering = 0 THEN action1 ELSE action2 END AS a,
             CASE WHEN question_ordering = 0 THEN action2 ELSE action1 END AS b FROM rr)
SELECT CAST(scenario_id AS VARCHAR) || '_' || coalesce(CAST(distractor_id AS VARCHAR), 'none') || '_'
       || CAST(question_ordering AS VARCHAR) || '_ab' AS prompt_id,
       {_tmpl_sql('ab_moralchoice', 'ctx', 'a', 'b')} AS user_prompt
FROM x
""", "v_scenarios", "v_distractors", "v_responses"))
def q_render_scenario_side(spark, sf_dir):
    return RD.render_choice(_render_rows(spark, sf_dir, True)).select("prompt_id", "user_prompt")


@register("render_system_side", with_views(f"""
WITH {_render_rows_sql(False)}
SELECT CAST(scenario_id AS VARCHAR) || '_' || coalesce(CAST(distractor_id AS VARCHAR), 'none') AS prompt_id,
       {_inject_sql(_sq(TEMPLATES['normbank'][0]))} AS system_prompt,
       {_tmpl_sql('normbank', 'context')} AS user_prompt
FROM rr
""", "v_scenarios", "v_distractors", "v_responses"))
def q_render_system_side(spark, sf_dir):
    return RD.render_system_injected(_render_rows(spark, sf_dir, False)).select(
        "prompt_id", "system_prompt", "user_prompt")


_REDDIT_BASE = TX.strip_sql(_sq(TEMPLATES["reddit"][0]))
_LOWER1 = r"(?s)^(\P{L}*)(\p{L})(.*)\z"


@register("render_verdict_system", with_views(f"""
WITH {_TXT_SQL},
arms AS (SELECT d.id AS distractor_id, d.modality, t.body FROM v_distractors d LEFT JOIN txt t ON d.file_path = t.file_path
         UNION ALL SELECT NULL, NULL, NULL),
b AS (SELECT *, {_REDDIT_BASE} AS base FROM arms),
r AS (SELECT *, CASE WHEN regexp_matches(base, {_sq(_LOWER1)})
                     THEN regexp_extract(base, {_sq(_LOWER1)}, 1) || lower(regexp_extract(base, {_sq(_LOWER1)}, 2))
                          || regexp_extract(base, {_sq(_LOWER1)}, 3) ELSE base END AS rem FROM b)
SELECT distractor_id,
       CASE WHEN modality IS NULL THEN base
            WHEN modality = 'text' THEN CASE WHEN length(coalesce(body, '')) = 0 THEN base
                                             WHEN length(rem) > 0 THEN body || ' Later, ' || rem ELSE body END
            WHEN modality = 'image' THEN CASE WHEN length(rem) > 0 THEN 'You see the scene in the image. ' || rem
                                              ELSE 'You see the scene in the image.' END
            ELSE base END AS system_prompt
FROM r
""", "v_distractors"))
def q_render_verdict_system(spark, sf_dir):
    d = V.distractors(spark, sf_dir).select(F.col("id").alias("distractor_id"),
                                            F.col("modality").alias("distractor_modality"),
                                            F.col("file_path").alias("distractor_file_path"))
    none_arm = (V.distractors(spark, sf_dir).groupBy().agg(F.count(F.lit(1)).alias("_n"))
                .select(F.lit(None).cast("long").alias("distractor_id"),
                        F.lit(None).cast("string").alias("distractor_modality"),
                        F.lit(None).cast("string").alias("distractor_file_path")))
    arms = RD.attach_distractor_text(d.unionByName(none_arm), _distractor_texts(spark, sf_dir))
    arms = arms.withColumn("scenario_id", F.lit("")).withColumn("context", F.lit(""))
    return RD.render_verdict(arms).select("distractor_id", "system_prompt")


@register("render_verdict_prompts", with_views(f"""
WITH {_TXT_SQL},
arms AS (SELECT p.doc_id, p.text AS post, d.id AS distractor_id, d.modality, t.body FROM documents p
         LEFT JOIN v_distractors d ON d.id = p.doc_id % 100 LEFT JOIN txt t ON d.file_path = t.file_path),
b AS (SELECT *, {_REDDIT_BASE} AS base FROM arms),
r AS (SELECT *, CASE WHEN regexp_matches(base, {_sq(_LOWER1)})
                     THEN regexp_extract(base, {_sq(_LOWER1)}, 1) || lower(regexp_extract(base, {_sq(_LOWER1)}, 2))
                          || regexp_extract(base, {_sq(_LOWER1)}, 3) ELSE base END AS rem FROM b)
SELECT CAST(doc_id AS VARCHAR) || '_' || coalesce(CAST(distractor_id AS VARCHAR), 'none') AS prompt_id,
       CASE WHEN modality IS NULL THEN base
            WHEN modality = 'text' THEN CASE WHEN length(coalesce(body, '')) = 0 THEN base
                                             WHEN length(rem) > 0 THEN body || ' Later, ' || rem ELSE body END
            WHEN length(rem) > 0 THEN 'You see the scene in the image. ' || rem ELSE 'You see the scene in the image.' END AS system_prompt,
       {TX.strip_sql('post')} AS user_prompt
FROM r
""", "v_distractors"))
def q_render_verdict_prompts(spark, sf_dir):
    """P7 + P8: whole posts as verdict prompts, each with the arm of its number or none."""
    arms = V.distractors(spark, sf_dir).select(
        F.col("id").alias("distractor_id"), F.col("modality").alias("distractor_modality"), F.col("file_path").alias("distractor_file_path"))
    posts = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("scenario_id"), F.col("text").alias("context"))
    rows = posts.join(C.small_side(arms), F.col("scenario_id") % 100 == F.col("distractor_id"), "left")
    return RD.render_verdict(RD.attach_distractor_text(rows, _distractor_texts(spark, sf_dir))).select(
        "prompt_id", "system_prompt", "user_prompt")



@register("eligibility", with_views(f"""
WITH r AS (SELECT x.model_id, d.modality FROM v_responses x LEFT JOIN v_distractors d ON x.distractor_id = d.id),
cap AS (SELECT * FROM (VALUES {", ".join(f"('{m}', {str(c).lower()})" for m, c in CAPABILITIES)}) c(model_id, accepts_images))
SELECT r.model_id, r.modality AS distractor_modality,
       CASE WHEN r.modality = 'image' AND NOT coalesce(cap.accepts_images, false) THEN 'ineligible' ELSE 'eligible' END AS status,
       count(*) AS n
FROM r LEFT JOIN cap USING (model_id) GROUP BY ALL
""", "v_distractors", "v_responses"))
def q_eligibility(spark, sf_dir):
    r = V.responses(spark, sf_dir)
    d = V.distractors(spark, sf_dir).select(F.col("id").alias("_did"), F.col("modality").alias("distractor_modality"))
    r = r.join(C.small_side(d), F.col("distractor_id") == F.col("_did"), "left")
    cap = spark.createDataFrame(CAPABILITIES, "model_id string, accepts_images boolean")
    e = DS.eligibility(r, cap)
    return e.groupBy("model_id", "distractor_modality", "status").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------
# Scoring: chain-rule answer probabilities, variant marginals, softmax pick, answer->action
# ---------------------------------------------------------------------------
from armature.functions import probability as PR  # noqa: E402

_POS_SQL = ("pos AS (SELECT doc_id, " + PR.whitespace_positions_duck("t") + " AS positions FROM rt)")


def _positions(spark, sf_dir):
    return _response_text(spark, sf_dir).select("doc_id", F.expr(PR.whitespace_positions_sql("t")).alias("positions"))


@register("chain_prob", with_views(f"""
WITH {_RT_SQL}, {_POS_SQL}
SELECT doc_id, round({PR.chain_prob_duck('positions', ['Verdict:', ' NTA'])}, 6) AS p_verdict_nta,
       round({PR.chain_prob_duck('positions', ['I', ' say', ' NTA,'])}, 6) AS p_i_say_nta
FROM pos
""", "v_text_responses"))
def q_chain_prob(spark, sf_dir):
    p = _positions(spark, sf_dir)
    return rounded(p.select("doc_id", PR.chain_prob("positions", "Verdict: NTA").alias("p_verdict_nta"),
                            PR.chain_prob("positions", "I say NTA,").alias("p_i_say_nta")))


_VERDICT_LABELS = ["ESH", "YTA", "NTA", "NAH", "INFO"]


@register("variant_marginal", with_views(f"""
WITH {_RT_SQL}, {_POS_SQL}
SELECT doc_id, {", ".join(f"round({PR.marginal_duck('positions', lab)}, 6) AS {lab.lower()}_prob" for lab in _VERDICT_LABELS)}
FROM pos
""", "v_text_responses"))
def q_variant_marginal(spark, sf_dir):
    depth = PR.VariantTrie(PR.token_seqs(_VERDICT_LABELS)).depth
    p = _response_text(spark, sf_dir).select("doc_id", F.expr(PR.whitespace_positions_sql("t", depth)).alias("positions"))
    p = PR.answer_probs(p, "positions", _VERDICT_LABELS)
    return rounded(p.select("doc_id", *[f"{lab.lower()}_prob" for lab in _VERDICT_LABELS]))


@register("softmax_pick", f"""
WITH e AS (SELECT vec_id - vec_id % 4 AS seq_id, vec_id % 4 AS pos,
                  {PR.softmax_logprob_duck('embedding', 'label + 1')} AS lp FROM embeddings)
SELECT seq_id, round(exp(sum(lp)), 6) AS prob, round(exp(sum(lp) FILTER (WHERE pos > 0)), 6) AS prob_skip_bos,
       count(*) AS n_positions
FROM e GROUP BY seq_id
""")
def q_softmax_pick(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") - F.col("vec_id") % 4).alias("seq_id"), (F.col("vec_id") % 4).alias("pos"),
        F.expr(PR.softmax_logprob_sql("embedding", "label + 1")).alias("lp"))
    g = e.groupBy("seq_id").agg(F.exp(F.sum("lp")).alias("prob"),
                                F.exp(F.sum(F.when(F.col("pos") > 0, F.col("lp")))).alias("prob_skip_bos"),
                                F.count(F.lit(1)).alias("n_positions"))
    return rounded(g)


# token sequences in the cut of an installed public tokenizer; positions hold tokens of three spellings each
def _installed_cut():
    import public_tokenizers
    from armature.sources.registry import byte_level_cut
    return byte_level_cut(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def _picked_positions_duck(every: list[list[str]], picks: list[str], number: str, last: str) -> str:
    """Positions 1..last: at each the tokens of the picked sequences, log-probabilities from lengths and ``number`` (DuckDB)."""
    duck = "[" + ", ".join("[" + ", ".join(map(PR._dq, t)) + "]" for t in every) + "]"
    entry = "{{'token': {s}[{p} + 1][j], 'logprob': CAST(length({s}[{p} + 1][j]) + j + {number} AS DOUBLE) / -10.0 - {k}.0}}"
    held = ", ".join(entry.format(s=duck, p=p, k=k, number=number) for k, p in enumerate(picks))
    return f"list_transform(range(1, {last} + 1), lambda j: list_filter([{held}], lambda e: e.token IS NOT NULL))"


def _picked_positions(every: list[list[str]], picks: list[str], number: str, last: str) -> str:
    """The same in Spark SQL."""
    lists = "array(" + ", ".join("array(" + ", ".join(PR._sq(x) for x in t) + ")" for t in every) + ")"
    token = "try_element_at({s}[CAST({p} AS INT)], CAST(j AS INT))"
    entry = "named_struct('token', {t}, 'logprob', CAST(length({t}) + j + {number} AS DOUBLE) / -10D - {k}D)"
    held = ", ".join(entry.format(t=token.format(s=lists, p=p), k=k, number=number) for k, p in enumerate(picks))
    return f"transform(sequence(1L, CAST({last} AS BIGINT)), j -> filter(array({held}), e -> e.token IS NOT NULL))"


def _register_token_queries():
    from armature.sources.registry import VARIANTS, variants_df
    cut = _installed_cut()
    seqs = {lab: [cut(v) for v in VARIANTS[lab]] for lab in [*_VERDICT_LABELS, "A", "B"]}
    every = [t for lab in _VERDICT_LABELS for t in seqs[lab]]
    depth, n = max(map(len, every)), len(every)
    picks = [f"doc_id % {n}", f"length(text) % {n}", f"(doc_id * 7 + length(text)) % {n}"]
    last = f"(doc_id % 3 + {depth - 2})"
    sql = f"""
WITH d AS (SELECT doc_id, coalesce("text", '') AS text FROM documents),
pos AS (SELECT doc_id, {_picked_positions_duck(every, picks, "0", last)} AS positions FROM d)
SELECT doc_id, {", ".join(f"round({PR.marginal_duck('positions', lab, seqs[lab])}, 6) AS {lab.lower()}_prob" for lab in _VERDICT_LABELS)}
FROM pos
"""

    def variant_trie(spark, sf_dir):
        d = V.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        d = d.select("doc_id", F.expr(_picked_positions(every, picks, "0", last)).alias("positions"))
        p = PR.answer_probs(d, "positions", _VERDICT_LABELS, variants=variants_df(spark, cut))
        return rounded(p.select("doc_id", *[f"{lab.lower()}_prob" for lab in _VERDICT_LABELS]))
    register("variant_trie", sql)(variant_trie)

    # responses to the prompts of the stored (scenario, distractor, ordering) triples; every fifth has none
    ab = seqs["A"] + seqs["B"]
    where, d = "(scenario_id + question_ordering) % 5 <> 0", "coalesce(distractor_id, 0)"
    spots = [f"(scenario_id + {d}) % {len(ab)}", f"(scenario_id * 3 + {d} * 5) % {len(ab)}", f"({d} * 11 + question_ordering) % {len(ab)}"]
    content = "CASE WHEN scenario_id % 2 = 0 THEN ' A ' ELSE 'B' END"
    label = {lab: PR.marginal_duck("positions", lab, seqs[lab]) for lab in "AB"}
    result_sql = with_views(f"""
WITH p AS (SELECT DISTINCT r.scenario_id, r.distractor_id, r.question_ordering FROM v_responses r JOIN v_scenarios s ON r.scenario_id = s.id),
a AS (SELECT *, {where} AS here, {content} AS content, {_picked_positions_duck(ab, spots, "scenario_id % 7", "(scenario_id % 4)")} AS positions FROM p),
b AS (SELECT *, {label["A"]} AS pa, {label["B"]} AS pb FROM a)
SELECT CAST(scenario_id AS VARCHAR) || '_' || coalesce(CAST(distractor_id AS VARCHAR), 'none') || '_' || CAST(question_ordering AS VARCHAR) || '_ab' AS prompt_id,
  'moralchoice_high_ambiguity' AS dataset, scenario_id, distractor_id, question_ordering, CASE WHEN here THEN 'ok' ELSE 'missing' END AS status,
  CASE WHEN here THEN trim(content) END AS answer, 'top_p_sampling' AS eval_technique, 1.0::DOUBLE AS eval_temperature,
  CASE WHEN here THEN round(CASE WHEN question_ordering = 0 THEN pa ELSE pb END, 6) END AS a1_prob,
  CASE WHEN here THEN round(CASE WHEN question_ordering = 0 THEN pb ELSE pa END, 6) END AS a2_prob FROM b
""", "v_responses", "v_scenarios")

    def result_rows(spark, sf_dir):
        """Prompts and returned responses to scored result rows."""
        from armature.operators.results import result_rows as rows_of
        prompts = RD.render_choice(_render_rows(spark, sf_dir, True), "ab").withColumn("model_id", F.lit("openai/gpt-4.1")) \
            .withColumn("question_format", F.lit("ab"))
        returned = prompts.where(where).select(
            F.col("prompt_id").alias("custom_id"), F.expr(content).alias("content"),
            F.expr(f"CASE WHEN scenario_id % 4 = 0 THEN array() ELSE {_picked_positions(ab, spots, 'scenario_id % 7', '(scenario_id % 4)')} END").alias("positions"))
        rows = rows_of(prompts, returned, "moralchoice_high_ambiguity", variants_df(spark, cut))
        return rounded(rows.select("prompt_id", "dataset", "scenario_id", "distractor_id", "question_ordering", "status", "answer",
                                   "eval_technique", "eval_temperature", "a1_prob", "a2_prob"))
    register("result_rows", result_sql)(result_rows)


try:
    _register_token_queries()
except ModuleNotFoundError as missing:          # no tokenizer files are installed here
    if missing.name not in ("public_tokenizers", "tiktoken"):
        raise


# answer id sequences with a start token in front, over logits that are masked and null in places
_ID_SEQS = {"A": [[0, 1, 5], [0, 1, 9, 3], [0, 7]], "B": [[0, 2], [0, 1, 5, 7], [0, 33, 60, 12, 4]], "C": [[0, 1, 2, 3, 4, 5], [0]]}
_MASKED = ("CASE WHEN (vec_id + {i}) % 11 = 0 THEN CAST('-Infinity' AS DOUBLE) WHEN (vec_id + {i}) % 13 = 0 THEN NULL "
           "ELSE CAST(v AS DOUBLE) END")


def _id_chain_duck(seq):
    ids = seq[1:]
    if not ids:
        return "1.0"
    terms = " * ".join(f"coalesce(exp(l[{j}][{i + 1}]), 0.0)" for j, i in enumerate(ids, 1))
    return f"(CASE WHEN len(l) < {len(ids)} THEN 0.0 ELSE {terms} END)"


@register("logit_answer_prob", f"""
WITH e AS (SELECT vec_id - vec_id % 4 AS seq_id, vec_id % 4 AS pos,
             list_transform(embedding, lambda v, i: {_MASKED.format(i="i - 1")}) AS v FROM embeddings),
m AS (SELECT *, list_max(list_filter(v, lambda x: x IS NOT NULL)) AS top FROM e),
n AS (SELECT *, top + ln(list_sum(list_transform(list_filter(v, lambda x: x IS NOT NULL), lambda x: exp(x - top)))) AS lse FROM m),
p AS (SELECT seq_id, list(list_transform(v, lambda x: x - lse) ORDER BY pos) AS l FROM n GROUP BY seq_id)
SELECT seq_id, {", ".join(f"round({' + '.join(map(_id_chain_duck, s))}, 6) AS {lab.lower()}_prob" for lab, s in _ID_SEQS.items())} FROM p
""")
def q_logit_answer_prob(spark, sf_dir):
    v = V.table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") - F.col("vec_id") % 4).alias("seq_id"), (F.col("vec_id") % 4 + 1).alias("pos"),
        F.expr(f"transform(embedding, (v, i) -> {_MASKED.format(i='i')})").alias("v"))
    chunks = v.select("seq_id", "pos", F.explode(F.sequence(F.lit(0), F.lit(48), F.lit(16))).alias("offset"), "v") \
        .select("seq_id", "pos", "offset", F.expr("slice(v, offset + 1, 16)").alias("logits"))
    rows = [(lab, [str(i) for i in s[1:]]) for lab, seqs in _ID_SEQS.items() for s in seqs]      # without the start token
    variants = spark.createDataFrame(rows, "label string, token_seq array<string>")
    wanted = PR.VariantTrie(PR.token_seqs(list(_ID_SEQS), variants)).tokens()
    p = PR.answer_probs(PR.logit_positions(chunks, ["seq_id"], wanted), "positions", list(_ID_SEQS), variants=variants)
    return rounded(p.drop("positions"))


@register("answer_to_action", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN 'ab' ELSE 'compare' END AS question_format,
       l_linenumber % 2 AS question_ordering,
       round(CASE WHEN l_linenumber % 2 = 0 THEN l_discount ELSE l_tax END, 6) AS a1_prob,
       round(CASE WHEN l_linenumber % 2 = 0 THEN l_tax ELSE l_discount END, 6) AS a2_prob
FROM lineitem
""")
def q_answer_to_action(spark, sf_dir):
    from armature.operators.scoring import answer_to_action
    li = V.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_linestatus") == "O", F.lit("ab")).otherwise(F.lit("compare")).alias("question_format"),
        (F.col("l_linenumber") % 2).alias("question_ordering"),
        F.col("l_discount").alias("p_first"), F.col("l_tax").alias("p_second"))
    return rounded(answer_to_action(li).select("l_orderkey", "l_linenumber", "question_format",
                                               "question_ordering", "a1_prob", "a2_prob"))


@register("answers_by_format", """
WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN 'ab_moralchoice' ELSE 'compare_moralchoice' END AS question_format,
  l_linenumber % 2 AS o, l_discount AS a, l_tax AS b, l_quantity / 100 AS yes, 1 - l_quantity / 100 AS no FROM lineitem),
y AS (SELECT *, CASE WHEN question_format LIKE 'ab%' THEN a ELSE yes END AS f, CASE WHEN question_format LIKE 'ab%' THEN b ELSE no END AS s FROM x)
SELECT l_orderkey, l_linenumber, question_format, round(CASE WHEN o = 0 THEN f ELSE s END, 6) AS a1_prob,
       round(CASE WHEN o = 0 THEN s ELSE f END, 6) AS a2_prob FROM y
""")
def q_answers_by_format(spark, sf_dir):
    """P10 over both formats: the labels follow the question format, the actions its ordering."""
    from armature.operators.scoring import answer_to_action, pick_answers
    x = V.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_linestatus") == "O", F.lit("ab_moralchoice")).otherwise(F.lit("compare_moralchoice")).alias("question_format"),
        (F.col("l_linenumber") % 2).alias("question_ordering"), F.col("l_discount").alias("a_prob"), F.col("l_tax").alias("b_prob"),
        (F.col("l_quantity") / 100).alias("yes_prob"), (1 - F.col("l_quantity") / 100).alias("no_prob"))
    return rounded(answer_to_action(pick_answers(x)).select("l_orderkey", "l_linenumber", "question_format", "a1_prob", "a2_prob"))


# ---------------------------------------------------------------------------
# Batch halves: request JSON, keep-last responses, prompt/response join
# ---------------------------------------------------------------------------
from armature.operators import batch as BT  # noqa: E402


@register("keep_last_response", with_views("""
SELECT custom_id, max(line_no) AS line_no, arg_max(content, line_no) AS content
FROM v_batch_responses GROUP BY custom_id
""", "v_batch_responses"))
def q_keep_last_response(spark, sf_dir):
    return BT.keep_last(V.batch_responses(spark, sf_dir), "custom_id", "line_no")


@register("prompt_response_join", with_views("""
WITH k AS (SELECT custom_id, arg_max(content, line_no) AS content FROM v_batch_responses GROUP BY custom_id)
SELECT CAST(d.doc_id AS VARCHAR) AS prompt_id, k.content,
       CASE WHEN k.custom_id IS NULL THEN 'missing' ELSE 'ok' END AS status
FROM documents d LEFT JOIN k ON CAST(d.doc_id AS VARCHAR) = k.custom_id
""", "v_batch_responses"))
def q_prompt_response_join(spark, sf_dir):
    prompts = V.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("prompt_id"))
    kept = BT.keep_last(V.batch_responses(spark, sf_dir), "custom_id", "line_no").select("custom_id", "content")
    return BT.join_responses(prompts, kept).select("prompt_id", "content", "status")


@register("batch_request_json", with_views(f"""
WITH {_render_rows_sql(False)},
pr AS (SELECT CAST(scenario_id AS VARCHAR) || '_' || coalesce(CAST(distractor_id AS VARCHAR), 'none') AS prompt_id,
             {_inject_sql(_sq(TEMPLATES['normbank'][0]))} AS system_prompt,
             {_tmpl_sql('normbank', 'context')} AS user_prompt FROM rr)
SELECT prompt_id AS custom_id,
       CAST(to_json({{'custom_id': prompt_id, 'method': 'POST', 'url': '/v1/chat/completions',
                     'body': {{'model': 'gpt-4.1',
                              'messages': [{{'role': 'system', 'content': system_prompt}}, {{'role': 'user', 'content': user_prompt}}],
                              'max_completion_tokens': 200, 'temperature': CAST(0.2 AS DOUBLE), 'top_p': CAST(1.0 AS DOUBLE),
                              'logprobs': true, 'top_logprobs': 20}}}}) AS VARCHAR) AS line
FROM pr
""", "v_scenarios", "v_distractors", "v_responses"))
def q_batch_request_json(spark, sf_dir):
    from armature.sources.registry import sampling_defaults
    temp, top_p = sampling_defaults("normbank")
    prompts = RD.render_system_injected(_render_rows(spark, sf_dir, False))
    return BT.batch_requests(prompts, "gpt-4.1", 200, temp, top_p)


# ---------------------------------------------------------------------------
# Registry checks, length statistics, corpus slice, counts
# ---------------------------------------------------------------------------

from armature.sources import files as FS  # noqa: E402

_LISTING_SQL = """listing AS (SELECT DISTINCT modality || '/' || sentiment || '/' || file_path AS path FROM v_distractors)"""
_LISTING_RE = r"^([^/]+)/([^/]+)/(.+)\z"


@register("registry_ids", with_views(f"""
WITH {_LISTING_SQL}
SELECT row_number() OVER (ORDER BY path) - 1 AS id,
       regexp_extract(path, {_sq(_LISTING_RE)}, 2) AS sentiment,
       regexp_extract(path, {_sq(_LISTING_RE)}, 3) AS file_path,
       regexp_extract(path, {_sq(_LISTING_RE)}, 1) AS modality
FROM listing
""", "v_distractors"))
def q_registry_ids(spark, sf_dir):
    d = V.distractors(spark, sf_dir)
    listing = d.select(F.concat_ws("/", "modality", "sentiment", "file_path").alias("path")).distinct()
    return FS.registry_from_listing(listing, "path")


@register("duplicate_assets", with_views("""
SELECT file_path, count(*) AS n_refs FROM v_distractors GROUP BY file_path HAVING count(*) > 1
""", "v_distractors"))
def q_duplicate_assets(spark, sf_dir):
    return FS.duplicate_paths(V.distractors(spark, sf_dir))


@register("length_stats", f"""
SELECT 'distractor_bytes' AS measure, round(avg(octet_length(encode(text))), 6) AS mean_length, count(*) AS n FROM benchmark
UNION ALL
SELECT 'scenario_chars', round(avg(length(text)), 6), count(*) FROM documents
""")
def q_length_stats(spark, sf_dir):
    from armature.operators.shares import length_means
    b = V.table(spark, sf_dir, "benchmark").select("text")
    d = V.table(spark, sf_dir, "documents").select("text")
    return rounded(length_means(b, d))


@register("pattern_slice_head", """
WITH s AS (SELECT doc_id, text FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 500)
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS id, doc_id, text AS context FROM s
""")
def q_pattern_slice_head(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return FS.pattern_slice(docs, F.col("lang") == "en", "doc_id", 500).select(
        "id", "doc_id", F.col("text").alias("context"))


@register("distinct_counts", with_views("""
SELECT count(*) AS n_rows, count(DISTINCT model_id) AS n_models, count(DISTINCT scenario_id) AS n_scenarios,
       count(DISTINCT distractor_id) AS n_distractors, count(DISTINCT baseline_id) AS n_keys
FROM v_responses
""", "v_responses"))
def q_distinct_counts(spark, sf_dir):
    # collapsed map-side to distinct keys first: the distinct counts never expand raw rows
    r = (V.responses(spark, sf_dir).groupBy("model_id", "scenario_id", "baseline_id", "distractor_id")
         .agg(F.count(F.lit(1)).alias("n")))
    return r.agg(F.sum("n").alias("n_rows"), F.countDistinct("model_id").alias("n_models"),
                 F.countDistinct("scenario_id").alias("n_scenarios"),
                 F.countDistinct("distractor_id").alias("n_distractors"),
                 F.countDistinct("baseline_id").alias("n_keys"))


# ---------------------------------------------------------------------------
# Stores and files: written to the shared folder, read back
# ---------------------------------------------------------------------------
def _shared_path(spark, name: str) -> str:
    import uuid
    from armature.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/armature-files/{uuid.uuid4().hex}/{name}"


@register("union_results", with_views("""
SELECT model_id, scenario_id, distractor_id, round(good_prob, 6) AS good_prob, round(ok_prob, 6) AS ok_prob,
       NULL::DOUBLE AS esh_prob, NULL::DOUBLE AS yta_prob FROM v_option_responses
UNION ALL SELECT model_id, scenario_id, distractor_id, NULL, NULL, round(esh_prob, 6), round(yta_prob, 6) FROM v_verdict_probs
""", "v_option_responses", "v_verdict_probs"))
def q_union_results(spark, sf_dir):
    """Two result tables with different score columns."""
    from armature.sources.files import union_results
    a = V.option_responses(spark, sf_dir).select("model_id", "scenario_id", "distractor_id", "good_prob", "ok_prob")
    b = V.verdict_probs(spark, sf_dir).select("model_id", "scenario_id", "distractor_id", "esh_prob", "yta_prob")
    return rounded(union_results([a, b]))


@register("stored_results", f"""
WITH {_STORE_SQL}
SELECT DISTINCT experiment, dataset, model_id, question_format, scenario_id, distractor_id, question_ordering
FROM store WHERE experiment = 'main' AND dataset = 'moralchoice_high_ambiguity' AND status = 'ok'
""")
def q_stored_results(spark, sf_dir):
    """K1 + S8: append to a partitioned store (twice), then collect one experiment's ok rows."""
    from armature.operators.design import RESULT_KEY
    from armature.operators.results import collect_results
    from armature.sinks.writers import append_results
    path, rows = _shared_path(spark, "store"), V.result_store(spark, sf_dir)
    append_results(rows.where("scenario_id % 2 = 0"), path)
    append_results(rows, path)
    return collect_results(spark, path, "main", "moralchoice_high_ambiguity").select(*RESULT_KEY)


@register("batch_responses_read", """
SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS custom_id, text AS content, CAST(turn % 3 AS INT) AS n_positions FROM conversations
""")
def q_batch_responses_read(spark, sf_dir):
    """S7 + W4: returned JSON lines from files."""
    c = V.table(spark, sf_dir, "conversations")
    top = F.struct(F.lit("A").alias("token"), F.lit(-0.5).alias("logprob"))
    position = F.struct(F.lit("A").alias("token"), F.lit(-0.5).alias("logprob"), F.array(top).alias("top_logprobs"))
    choice = F.struct(F.struct(F.col("text").alias("content")).alias("message"),
                      F.struct(F.array_repeat(position, (F.col("turn") % 3).cast("int")).alias("content")).alias("logprobs"))
    line = F.struct(F.concat_ws("-", "conv_id", "turn").alias("custom_id"),
                    F.struct(F.lit(200).alias("status_code"), F.struct(F.array(choice).alias("choices")).alias("body")).alias("response"))
    path = _shared_path(spark, "responses")
    c.select(F.to_json(line).alias("line")).write.text(path)
    r = BT.keep_last(BT.read_responses(spark, path))
    return r.select("custom_id", "content", F.size("positions").alias("n_positions"))


@register("per_model_files", with_views("""
SELECT model_id || '_' || model_id AS model_dir, event_id, verdict FROM v_option_responses
""", "v_option_responses"))
def q_per_model_files(spark, sf_dir):
    """K2: one CSV folder per model, read back."""
    from armature.sinks.writers import write_per_model_csv
    path = _shared_path(spark, "models")
    write_per_model_csv(V.option_responses(spark, sf_dir).select("model_id", "event_id", "verdict"), path)
    return spark.read.schema("model_id string, event_id long, verdict string, model_dir string").option("header", True).csv(path) \
        .select("model_dir", "event_id", "verdict")


# ---------------------------------------------------------------------------
# Report layer: min/max flags, LaTeX rows, multi-experiment summary, arm comparison
# ---------------------------------------------------------------------------
from armature.operators import report as RP  # noqa: E402

# flags and cells come from unrounded means
_MMAP_MEANS_SQL = with_views(_MMAP_BASE_SQL + """,
j AS (SELECT t.model_id, t.condition, t.mmap FROM t LEFT JOIN (SELECT model_id, baseline_id, rule FROM t WHERE condition = 'baseline') b
      ON t.model_id = b.model_id AND t.baseline_id = b.baseline_id AND t.rule = b.rule)
SELECT model_id, condition, avg(mmap) AS mean_score FROM j WHERE condition <> 'unknown' GROUP BY model_id, condition
""", "v_distractors", "v_scenario_rules", "v_responses")


def _mmap_means(spark, sf_dir):
    r = _with_condition(spark, sf_dir, V.responses(spark, sf_dir))
    return E.mmap_condition_means(r, V.scenario_rules(spark, sf_dir)).select("model_id", "condition", "mean_score")


@register("minmax_flags", f"""
WITH m AS ({_MMAP_MEANS_SQL})
SELECT model_id, condition, round(mean_score, 6) AS mean_score,
       CASE WHEN mean_score = max(mean_score) OVER (PARTITION BY model_id) THEN 'max'
            WHEN mean_score = min(mean_score) OVER (PARTITION BY model_id) THEN 'min' ELSE '' END AS flag
FROM m
""")
def q_minmax_flags(spark, sf_dir):
    return rounded(RP.minmax_flags(_mmap_means(spark, sf_dir), ["model_id"]))


@register("report_rows", f"""
WITH m AS ({_MMAP_MEANS_SQL}),
f AS (SELECT model_id, condition, printf('%.2f', mean_score * 100) || '\\%' AS s,
             CASE WHEN mean_score = max(mean_score) OVER (PARTITION BY model_id) THEN 'max'
                  WHEN mean_score = min(mean_score) OVER (PARTITION BY model_id) THEN 'min' ELSE '' END AS flag FROM m),
c AS (SELECT model_id, condition, CASE flag WHEN 'max' THEN '\\textcolor{{mygreen}}{{' || s || '}}'
                                            WHEN 'min' THEN '\\textcolor{{red}}{{' || s || '}}' ELSE s END AS cell FROM f)
SELECT model_id, model_id || ' & ' || {" || ' & ' || ".join(f"coalesce(max(cell) FILTER (WHERE condition = '{c}'), '-')" for c in ["baseline", "positive", "neutral", "negative"])} || ' \\\\' AS latex_row
FROM c GROUP BY model_id
""")
def q_report_rows(spark, sf_dir):
    return RP.latex_rows(RP.latex_cells(RP.minmax_flags(_mmap_means(spark, sf_dir), ["model_id"])))


_EXPERIMENTS = [
    ("moralchoice", "mmap_condition_means", "'mmap'"),
    ("normbank", "option_share_means", "option"),
    ("reddit_verdict", "verdict_prob_means", "option"),
    ("reddit_foundation", "foundation_means", "option"),
]
_SUMMARY_COLS = "condition, mean_score, mean_diff, sd_score, sd_diff, se_score, se_diff, n_rows"
_SUMMARY_SQL = "\nUNION ALL\n".join(
    f"SELECT '{exp}' AS experiment, model_id, {opt} AS option, {_SUMMARY_COLS} FROM ({REGISTRY[q][1]}) q_{i}"
    for i, (exp, q, opt) in enumerate(_EXPERIMENTS))


def _summary(spark, sf_dir):
    parts = []
    for exp, q, opt in _EXPERIMENTS:
        df = REGISTRY[q][0](spark, sf_dir)
        if opt == "'mmap'":
            df = df.withColumn("option", F.lit("mmap"))
        parts.append(df.withColumn("experiment", F.lit(exp)).select(
            "experiment", "model_id", "option", *[c.strip() for c in _SUMMARY_COLS.split(",")]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("multi_model_summary", _SUMMARY_SQL)
def q_multi_model_summary(spark, sf_dir):
    """Every experiment's condition statistics in one long table."""
    return _summary(spark, sf_dir)


ARMS = [("normbank", "m0", 1), ("normbank", "m1", 2), ("reddit_verdict", "m2", 3), ("moralchoice", "A", 4)]


@register("arm_comparison", f"""
WITH s AS ({_SUMMARY_SQL}),
arms AS (SELECT * FROM (VALUES {", ".join(f"('{e}', '{m}', {p})" for e, m, p in ARMS)}) a(experiment, model_id, position))
SELECT a.position, s.experiment, s.model_id, s.option, s.condition, s.mean_diff, s.se_diff
FROM s JOIN arms a ON s.experiment = a.experiment AND s.model_id = a.model_id
WHERE s.condition <> 'baseline'
""")
def q_arm_comparison(spark, sf_dir):
    """Ordered subset of experiment arms, change from baseline with standard errors."""
    arms = spark.createDataFrame(ARMS, "experiment string, model_id string, position int")
    s = _summary(spark, sf_dir).where(F.col("condition") != "baseline")
    j = s.join(F.broadcast(arms), ["experiment", "model_id"])
    return j.select("position", "experiment", "model_id", "option", "condition", "mean_diff", "se_diff")


@register("arm_series", f"""
WITH s AS ({_SUMMARY_SQL}),
arms AS (SELECT * FROM (VALUES {", ".join(f"('{e}', '{m}', {p})" for e, m, p in ARMS)}) a(experiment, model_id, position)),
c AS (SELECT * FROM (VALUES ('baseline', 0), ('positive', 1), ('neutral', 2), ('negative', 3)) c(condition, condition_no))
SELECT a.position, c.condition_no, s.experiment, s.model_id, s.option, s.condition, s.mean_score, s.se_score, s.n_rows
FROM s JOIN arms a ON s.experiment = a.experiment AND s.model_id = a.model_id JOIN c ON s.condition = c.condition
""")
def q_arm_series(spark, sf_dir):
    """A23, absolute: mean score of every condition, baseline included, in arm and condition order."""
    from armature.schemas import CONDITIONS
    arms = spark.createDataFrame(ARMS, "experiment string, model_id string, position int")
    j = _summary(spark, sf_dir).join(F.broadcast(arms), ["experiment", "model_id"])
    number = F.array_position(F.array(*map(F.lit, CONDITIONS)), F.col("condition")) - 1
    return j.select("position", number.cast("int").alias("condition_no"), "experiment", "model_id", "option", "condition",
                    "mean_score", "se_score", "n_rows").orderBy("position", "option", "condition_no")


# ---------------------------------------------------------------------------
# T1 random-intercept tests + Holm-Sidak over the whole report family (rows-only)
# ---------------------------------------------------------------------------
from armature.operators import mixedlm as ML  # noqa: E402


def _mixed_tests(spark, sf_dir):
    """The scores of every experiment family, unioned, then one batched fit."""
    cell = ["experiment", "model_id", "option"]
    r = _with_condition(spark, sf_dir, V.responses(spark, sf_dir))
    mm = (E.mmap_contributions(r, V.scenario_rules(spark, sf_dir)).withColumnRenamed("score", "option")
          .withColumnRenamed("baseline_id", "key").withColumn("experiment", F.lit("moralchoice")))
    parts = [mm.select("experiment", "model_id", "option", "key", "condition", "x_n", "x_s", "x_m")]
    fams = [("normbank", V.option_responses, ["good", "ok", "bad"], True, True, "_prob"),
            ("reddit_verdict", V.verdict_probs, ["esh", "yta", "nta", "nah", "info"], True, True, "_prob"),
            ("reddit_foundation", V.foundations, ["ch", "fc", "lb", "as", "pd"], False, False, "_score")]
    for exp, fn, opts, norm, dz, suf in fams:
        df = _with_condition(spark, sf_dir, fn(spark, sf_dir))
        c = E.option_contributions(df, opts, "scenario_id", norm, dz, suf)
        parts.append(c.select(F.lit(exp).alias("experiment"), "model_id", "option",
                              F.col("scenario_id").cast("string").alias("key"), "condition", "x_n", "x_s", "x_m"))
    contrib = parts[0]
    for p in parts[1:]:
        contrib = contrib.unionByName(p)
    return ML.mixed_lm_pairs(contrib, cell, ["key"])


def _family_sql(name: str, view: str, opts: list[str], suffix: str, normalise: bool, drop_zero: bool, key_cast: str) -> str:
    """CTE ``<name>``: (experiment, model_id, option, key, condition, y, times) of one option family."""
    total = " + ".join(f"coalesce({o}{suffix}, 0)" for o in opts)
    score = " ".join(f"WHEN '{o}' THEN {o}{suffix}" for o in opts)
    share = f"CASE o.option {score} END" + (f" / nullif(total, 0)" if normalise else "")
    keep = f"WHERE (model_id, scenario_id) NOT IN (SELECT (model_id, scenario_id) FROM {name}_r WHERE total = 0)" if drop_zero else ""
    return f"""
{name}_r AS (SELECT x.*, CASE WHEN x.distractor_id IS NULL THEN 'baseline' ELSE coalesce(d.sentiment, 'unknown') END AS condition, {total} AS total
  FROM {view} x LEFT JOIN v_distractors d ON x.distractor_id = d.id),
{name} AS (SELECT '{name}' AS experiment, model_id, o.option AS option, {key_cast} AS key, condition, {share} AS y,
    greatest(count(*) FILTER (WHERE condition = 'baseline') OVER (PARTITION BY model_id, scenario_id, o.option), 1) AS times
  FROM {name}_r CROSS JOIN (VALUES {", ".join(f"('{o}')" for o in opts)}) o(option) {keep})"""


_MIXED_SQL = with_views(_MMAP_BASE_SQL + f""",
moralchoice AS (SELECT 'moralchoice' AS experiment, model_id, 'mmap' AS option, baseline_id AS key, condition, mmap AS y,
    greatest(count(*) FILTER (WHERE condition = 'baseline') OVER (PARTITION BY model_id, baseline_id, rule), 1) AS times FROM t),
{_family_sql("normbank", "v_option_responses", ["good", "ok", "bad"], "_prob", True, True, "CAST(scenario_id AS VARCHAR)")},
{_family_sql("reddit_verdict", "v_verdict_probs", ["esh", "yta", "nta", "nah", "info"], "_prob", True, True, "CAST(scenario_id AS VARCHAR)")},
{_family_sql("reddit_foundation", "v_foundations", ["ch", "fc", "lb", "as", "pd"], "_score", False, False, "CAST(scenario_id AS VARCHAR)")},
contrib AS (SELECT * FROM moralchoice UNION ALL SELECT * FROM normbank UNION ALL SELECT * FROM reddit_verdict UNION ALL SELECT * FROM reddit_foundation),
{ML.mixed_lm_sql("contrib", "experiment, model_id, option", "key")}
SELECT experiment, model_id, option, pair, ref, test, round(coef, 6) AS coef, round(z, 6) AS z, round(p, 6) AS p,
  CASE WHEN p IS NOT NULL THEN round(p_adj, 6) END AS p_adj, n_obs, n_groups, edge FROM {ST.holm_sidak_sql("tst")}
""", "v_distractors", "v_scenario_rules", "v_responses", "v_option_responses", "v_verdict_probs", "v_foundations")


@register("mixed_lm_pairs", _MIXED_SQL)
def q_mixed_lm_pairs(spark, sf_dir):
    """T1 + T7: coefficient, z, p per (experiment, model, option, pair); Holm-Sidak over all."""
    t = _mixed_tests(spark, sf_dir)
    return rounded(ST.holm_sidak(t, "p", "p_adj").select(
        "experiment", "model_id", "option", "pair", "ref", "test", "coef", "z", "p", "p_adj", "n_obs", "n_groups", "edge"))


_PAIRS = ["baseline_vs_positive", "baseline_vs_neutral", "baseline_vs_negative", "positive_vs_neutral", "negative_vs_neutral",
          "positive_vs_negative"]


@register("p_value_rows", _MIXED_SQL[:_MIXED_SQL.rindex("SELECT experiment, model_id")] + f"""
, adj AS (SELECT experiment, model_id, option, pair, '$' || format('{{:.2e}}', p_adj) || '$' AS cell FROM {ST.holm_sidak_sql("tst")} WHERE p IS NOT NULL)
SELECT experiment, option, model_id, model_id || ' & ' || {" || ' & ' || ".join(f"coalesce(max(cell) FILTER (WHERE pair = '{c}'), '-')" for c in _PAIRS)} || ' \\\\' AS latex_row
FROM adj GROUP BY experiment, option, model_id
""")
def q_p_value_rows(spark, sf_dir):
    """K5: the report's p-value tables; the family is every test of the report."""
    t = ST.holm_sidak(_mixed_tests(spark, sf_dir), "p", "p_adj").where("p IS NOT NULL")
    return RP.p_value_rows(t, _PAIRS, by=["experiment", "option"])


# ---------------------------------------------------------------------------
# Baseline policy 'mean' (Q8), sorted head (L2), data-quality flag (Q14)
# ---------------------------------------------------------------------------

@register("baseline_mean_pairing", with_views(f"""
WITH r0 AS (
  SELECT x.*, CASE WHEN x.distractor_id IS NULL THEN 'baseline' ELSE coalesce(d.sentiment, 'unknown') END AS condition,
         coalesce(good_prob, 0) + coalesce(ok_prob, 0) + coalesce(bad_prob, 0) AS total
  FROM v_option_responses x LEFT JOIN v_distractors d ON x.distractor_id = d.id),
bad AS (SELECT DISTINCT model_id, scenario_id FROM r0 WHERE total = 0),
r AS (SELECT r0.* FROM r0 ANTI JOIN bad USING (model_id, scenario_id)),
l AS (SELECT model_id, scenario_id, condition, o.option,
             CASE o.option WHEN 'good' THEN good_prob WHEN 'ok' THEN ok_prob ELSE bad_prob END / nullif(total, 0) AS share
      FROM r CROSS JOIN (VALUES ('good'), ('ok'), ('bad')) o(option)),
b AS (SELECT model_id, scenario_id, option, avg(share) AS mb FROM l WHERE condition = 'baseline' GROUP BY ALL),
j AS (SELECT l.model_id, l.option, l.condition, l.share AS score, l.share - b.mb AS diff
      FROM l LEFT JOIN b USING (model_id, scenario_id, option))
SELECT model_id, option, condition, {_stats_sql('score', 'diff')}
FROM j WHERE condition <> 'unknown' GROUP BY model_id, option, condition
""", "v_distractors", "v_option_responses"))
def q_baseline_mean_pairing(spark, sf_dir):
    """A9 with each treated row paired once with its key's mean baseline share (Q8 'mean')."""
    df = _with_condition(spark, sf_dir, V.option_responses(spark, sf_dir))
    return rounded(E.paired_effects(df, ["good", "ok", "bad"], baseline="mean"))


@register("verdict_shares_head", with_views(f"""
WITH {_VR}, c AS (SELECT model_id, distractor_type, verdict, count(*) AS count FROM vr
                  WHERE verdict IS NOT NULL GROUP BY ALL)
SELECT model_id, distractor_type, verdict,
       round(count / sum(count) OVER (PARTITION BY model_id, distractor_type), 6) AS share
FROM c ORDER BY model_id, distractor_type, verdict LIMIT 15
""", "v_distractors", "v_option_responses"))
def q_verdict_shares_head(spark, sf_dir):
    """L2: the first 15 rows of the sorted share table (a top-k report; the limit is the feature)."""
    s = SH.verdict_shares(_verdict_frame(spark, sf_dir), ["model_id", "distractor_type"])
    return rounded(s.select("model_id", "distractor_type", "verdict", "share")
                   .orderBy("model_id", "distractor_type", "verdict").limit(15))


@register("replacement_chars", """
SELECT lang, count(*) AS n_docs, count(*) FILTER (WHERE contains(text, chr(65533))) AS n_flagged
FROM documents GROUP BY lang
""")
def q_replacement_chars(spark, sf_dir):
    """Q14: texts holding U+FFFD (undecodable bytes) per language."""
    d = V.table(spark, sf_dir, "documents").select("lang", "text")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"),
                                 F.count_if(F.instr("text", "�") > 0).alias("n_flagged"))


# ---------------------------------------------------------------------------
# P19 (the reference's id-based polarity) and a standalone Holm family
# ---------------------------------------------------------------------------

@register("distractor_type", with_views("""
WITH n AS (SELECT id, CASE modality WHEN 'text' THEN 'txt' ELSE 'img' END || '_' || substr(sentiment, 1, 3)
                      || '_' || CAST(id AS VARCHAR) AS distractor_name FROM v_distractors)
SELECT id, distractor_name,
       coalesce(nullif(regexp_extract(distractor_name, 'txt_(neg|neu|pos)', 1), ''), 'baseline') AS distractor_type
FROM n
""", "v_distractors"))
def q_distractor_type(spark, sf_dir):
    """Polarity parsed from reference-style distractor names; images read as baseline (Q5)."""
    d = V.distractors(spark, sf_dir)
    name = F.concat_ws("_", F.when(F.col("modality") == "text", F.lit("txt")).otherwise(F.lit("img")),
                       F.substring("sentiment", 1, 3), F.col("id").cast("string"))
    return d.select("id", name.alias("distractor_name")).withColumn(
        "distractor_type", SH.distractor_type_from_id(F.col("distractor_name")))


@register("holm_adjust", with_views(f"""
WITH {_ztest_sql(VERDICTS)}
SELECT model_id, target, comparison, round(p, 6) AS p, round(p_adj, 6) AS p_adj
FROM {ST.holm_sql('zt', 'p')}
""", "v_distractors", "v_option_responses"))
def q_holm_adjust(spark, sf_dir):
    """Holm step-down over every two-proportion test of every verdict."""
    z = _ztests(spark, sf_dir, VERDICTS)
    return rounded(ST.holm(z, "p", "p_adj").select("model_id", "target", "comparison", "p", "p_adj"))


@register("mmap_condition_means_mean_policy", with_views(_MMAP_BASE_SQL + f""",
b AS (SELECT model_id, baseline_id, rule, avg(mmap) AS mb FROM t WHERE condition = 'baseline' GROUP BY ALL),
j AS (SELECT t.model_id, t.condition, t.mmap, t.mmap - b.mb AS diff
      FROM t LEFT JOIN b ON t.model_id = b.model_id AND t.baseline_id = b.baseline_id AND t.rule = b.rule)
SELECT model_id, condition, {_stats_sql('mmap', 'diff')}
FROM j WHERE condition <> 'unknown' GROUP BY model_id, condition
""", "v_distractors", "v_scenario_rules", "v_responses"))
def q_mmap_condition_means_mean_policy(spark, sf_dir):
    """Flagship with each treated row paired once with its key's mean baseline MMAP (Q8 'mean')."""
    r = _with_condition(spark, sf_dir, V.responses(spark, sf_dir))
    return rounded(E.mmap_condition_means(r, V.scenario_rules(spark, sf_dir), baseline="mean"))
