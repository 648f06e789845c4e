"""Treated-vs-baseline effects (J5, J6, P22-P25, A4-A11) at scale.

The reference joins every treated row of a key with every baseline row of the
same key (a fan-out that is quadratic in a hot key) and then takes means,
population deviations and standard errors.  Those statistics only need
per-key sufficient statistics, so the plan is:

  1. one ``groupBy(group, key, option)`` over the raw rows (map-side partial
     aggregation, so a hot key collapses before the shuffle) producing, per
     condition: row count, non-null count, sum and centred second moment of the score;
  2. per key, combine each condition's statistics with the key's baseline
     statistics in closed form - exactly what the fan-out join would have
     produced, without emitting a single pair;
  3. one small ``groupBy(group, option, condition)``.

Second moments are kept about their own means (Spark merges them without cancellation) and
combined by merge rules, so a small deviation of large scores survives.  For a treated set T and a
baseline set B of one key (non-null counts t, b; means u, v; centred moments M, W), the t * b differences
have mean u - v and centred moment b * M + t * W, and every treated row appears max(|B|, 1) times in the left join.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armature.schemas import CONDITIONS

STAT_COLS = ["mean_score", "mean_diff", "sd_score", "sd_diff", "se_score", "se_diff", "n_rows"]


def nan_to_null(c: Column) -> Column:
    """pandas skips NaN in means; Spark averages it.  Settle NaN -> null on ingest."""
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def key_stats(df: DataFrame, by: list[str], scores: Mapping[str, Column],
              zero: Column | None = None, condition: str = "condition",
              option_col: str = "option") -> DataFrame:
    """Per-key sufficient statistics in long form: one row per (by..., option).

    Each input row is exploded into one row per score (in memory, inside the
    same stage) so the aggregate carries 4 conditions x 4 statistics whatever
    the number of options - a narrow, codegen-friendly aggregate whose partial
    step collapses a hot key before the shuffle.
    """
    entries = [F.struct(F.lit(name).alias("o"), sc.cast("double").alias("x")) for name, sc in scores.items()]
    cols = [*by, F.col(condition).alias("_c")]
    if zero is not None:
        cols.append(F.coalesce(zero, F.lit(False)).alias("_z"))
    x = df.select(*cols, F.explode(F.array(*entries)).alias("_e"))
    c, v = F.col("_c"), F.col("_e.x")
    aggs = []
    for cond in CONDITIONS:
        m = c == cond
        xv = F.when(m, v)
        aggs += [F.count_if(m).alias(f"n__{cond}"), F.count(xv).alias(f"nn__{cond}"),
                 F.sum(xv).alias(f"s__{cond}"), (F.var_pop(xv) * F.count(xv)).alias(f"m__{cond}")]
    if zero is not None:
        aggs.append(F.max(F.col("_z").cast("int")).alias("zero_any"))
    return x.groupBy(*by, F.col("_e.o").alias(option_col)).agg(*aggs)


def pair_contributions(ks: DataFrame, keep: list[str], option_col: str = "option",
                       baseline: str = "join") -> DataFrame:
    """Long table: per (keep..., option, condition) what the baseline pairing contributes.

    ``baseline='join'`` reproduces the reference's left join (a key with several
    baseline rows fans every treated row out, Q8); ``baseline='mean'`` pairs each
    treated row once with the mean of its key's baseline rows.
    """
    if baseline not in ("join", "mean"):
        raise ValueError("baseline must be 'join' or 'mean'")

    def z(name, cast="long"):
        return F.coalesce(F.col(name), F.lit(0).cast(cast))
    entries = [F.struct(
        F.lit(c).alias("condition"), z(f"n__{c}").alias("n"), z(f"nn__{c}").alias("t"),
        z(f"s__{c}", "double").alias("st"), z(f"m__{c}", "double").alias("mt"),
        z("n__baseline").alias("nb"), z("nn__baseline").alias("b"),
        z("s__baseline", "double").alias("sb"), z("m__baseline", "double").alias("mb")) for c in CONDITIONS]
    e = (ks.select(*keep, option_col, F.explode(F.array(*entries)).alias("e"))
         .select(*keep, option_col, "e.*").where(F.col("n") > 0))
    t, b = F.col("t").cast("double"), F.col("b").cast("double")
    apart = F.coalesce(F.try_divide(F.col("st"), t) - F.try_divide(F.col("sb"), b), F.lit(0.0))     # difference of means
    if baseline == "mean":
        has = F.col("b") > 0
        return e.select(
            *keep, option_col, "condition", F.col("n").alias("rows"),
            F.col("t").alias("x_n"), F.col("st").alias("x_s"), F.col("mt").alias("x_m"),
            F.when(has, F.col("t")).otherwise(F.lit(0)).alias("d_n"),
            F.when(has, t * apart).otherwise(F.lit(0.0)).alias("d_s"),
            F.when(has, F.col("mt")).otherwise(F.lit(0.0)).alias("d_m"))
    mult = F.greatest(F.col("nb"), F.lit(1))
    return e.select(
        *keep, option_col, "condition",
        (F.col("n") * mult).alias("rows"),
        (F.col("t") * mult).alias("x_n"), (F.col("st") * mult).alias("x_s"), (F.col("mt") * mult).alias("x_m"),
        (F.col("t") * F.col("b")).alias("d_n"), (t * b * apart).alias("d_s"),
        (b * F.col("mt") + t * F.col("mb")).alias("d_m"))


def _finish(v: str) -> list[Column]:
    mean = F.try_divide(F.col(f"{v}_s"), F.col(f"{v}_n").cast("double"))
    sd = F.sqrt(F.greatest(F.try_divide(F.col(f"{v}_m"), F.col(f"{v}_n").cast("double")), F.lit(0.0)))
    return [mean, sd, F.try_divide(sd, F.sqrt(F.col("rows").cast("double")))]


def summarise(contrib: DataFrame, by: list[str]) -> DataFrame:
    """Means, population deviations and standard errors per ``by``.

    Keys of equal counts merge first (their means' own centred moment), the few classes of a cell
    after that, each about the cell's mean: centred moments are never formed as differences of sums of squares.
    """
    classes = contrib.groupBy(*by, "x_n", "d_n").agg(
        F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("keys"),
        *[c for v in "xd" for c in (
            F.sum(f"{v}_s").alias(f"{v}_s"), F.sum(f"{v}_m").alias(f"{v}_m"),
            F.coalesce(F.var_pop(F.try_divide(F.col(f"{v}_s"), F.col(f"{v}_n").cast("double"))), F.lit(0.0)).alias(f"{v}_v"))])
    cell = Window.partitionBy(*by)                                  # one row per distinct pair of counts
    parts = []
    for v in "xd":
        n = (F.col(f"{v}_n") * F.col("keys")).cast("double")
        centre = F.try_divide(F.sum(f"{v}_s").over(cell), F.sum(n).over(cell))
        off = F.coalesce(F.try_divide(F.col(f"{v}_s"), n) - centre, F.lit(0.0))
        parts += [n.alias(f"{v}_w"), (F.col(f"{v}_m") + n * (F.col(f"{v}_v") + off * off)).alias(f"{v}_c")]
    g = classes.select(*by, "rows", "x_s", "d_s", *parts).groupBy(*by).agg(
        F.sum("rows").alias("rows"), *[F.sum(a).alias(b) for a, b in (
            ("x_w", "x_n"), ("x_s", "x_s"), ("x_c", "x_m"), ("d_w", "d_n"), ("d_s", "d_s"), ("d_c", "d_m"))])
    (ms, sds, ses), (md, sdd, sed) = _finish("x"), _finish("d")
    return g.select(*by, ms.alias("mean_score"), md.alias("mean_diff"), sds.alias("sd_score"),
                    sdd.alias("sd_diff"), ses.alias("se_score"), sed.alias("se_diff"),
                    F.col("rows").alias("n_rows"))


# ---------------------------------------------------------------------------
# MoralChoice: MMAP over forced-choice rules (J6 -> J4 -> A7 -> J5 -> P23 -> A4-A6)
# ---------------------------------------------------------------------------

def forced_choice(rules_long: DataFrame) -> DataFrame:
    """Rules violated by exactly one action."""
    a1, a2 = F.col("a1"), F.col("a2")
    return rules_long.where(((a1 == "No") & (a2 == "Yes")) | ((a1 == "Yes") & (a2 == "No")))


def _mmap_scores(df: DataFrame) -> dict[str, Column]:
    a1, a2 = nan_to_null(F.col("a1_prob")), nan_to_null(F.col("a2_prob"))
    return {"m1": F.try_divide(a1, a1 + a2), "m2": F.try_divide(a2, a1 + a2)}


def mmap_key_stats(responses: DataFrame, drop_invalid: bool = True) -> DataFrame:
    """Per (model, baseline_id, scenario, variant) statistics of both possible MMAP values.

    ``m1 = a1/(a1+a2)`` is the MMAP when action 1 is the good one (a1 == 'No'),
    ``m2`` otherwise; which applies is decided per rule after the key is small.
    """
    zero = (F.col("a1_prob") + F.col("a2_prob")) == 0
    ks = key_stats(responses, ["model_id", "baseline_id", "scenario_id"], _mmap_scores(responses), zero)
    if drop_invalid:                                  # J6: one zero-sum row drops the key everywhere
        ks = ks.where(F.col("zero_any") == 0)
    return ks


def _fc_rules(rules_long: DataFrame) -> DataFrame:
    """Forced-choice rules with the MMAP variant each one selects."""
    return forced_choice(rules_long).select(
        F.col("id").alias("_sid"), "rule",
        F.when(F.col("a1") == "No", F.lit("m1")).otherwise(F.lit("m2")).alias("_pick"))


def mmap_rule_stats(responses: DataFrame, rules_long: DataFrame, drop_invalid: bool = True) -> DataFrame:
    """Key statistics crossed with the scenario's forced-choice rules (J3, A7): per
    (model, baseline_id, rule) the statistics of the MMAP variant that rule selects."""
    ks = mmap_key_stats(responses, drop_invalid)
    j = ks.join(_fc_rules(rules_long),
                (F.col("scenario_id") == F.col("_sid")) & (F.col("option") == F.col("_pick")))
    return j.drop("_sid", "_pick", "option").withColumn("score", F.lit("mmap"))


def mmap_contributions(responses: DataFrame, rules_long: DataFrame, baseline: str = "join") -> DataFrame:
    rs = mmap_rule_stats(responses, rules_long)
    return pair_contributions(rs, ["model_id", "baseline_id", "rule"], option_col="score", baseline=baseline)


def mmap_condition_means(responses: DataFrame, rules_long: DataFrame, baseline: str = "join") -> DataFrame:
    """Flagship: mean MMAP and its change from baseline per (model, condition)."""
    return summarise(mmap_contributions(responses, rules_long, baseline), ["model_id", "condition"])


def mmap_by_rule(responses: DataFrame, rules_long: DataFrame) -> DataFrame:
    """Mean MMAP per (model, condition, rule) without the invalid-key filter.

    Complete grid: models x 4 conditions x rules; a cell with no forced-choice
    row is 0.0 (as the reference returns), a cell whose rows are all null is null.
    """
    from armature.schemas import RULES
    rs = mmap_rule_stats(responses, rules_long, drop_invalid=False)
    cols = [F.struct(F.lit(c).alias("condition"), F.col(f"n__{c}").alias("n"),
                     F.col(f"nn__{c}").alias("nn"), F.col(f"s__{c}").alias("s")) for c in CONDITIONS]
    long = (rs.select("model_id", "rule", F.explode(F.array(*cols)).alias("e"))
            .select("model_id", "rule", "e.*").where(F.col("n") > 0))
    agg = long.groupBy("model_id", "condition", "rule").agg(
        F.sum("n").alias("n"), F.sum("nn").alias("nn"), F.sum("s").alias("s"))
    grid = (responses.select("model_id").distinct()
            .select("model_id", F.explode(F.array(*[F.lit(c) for c in CONDITIONS])).alias("condition"))
            .select("model_id", "condition", F.explode(F.array(*[F.lit(r) for r in RULES])).alias("rule")))
    out = grid.join(agg, ["model_id", "condition", "rule"], "left")
    return out.select("model_id", "condition", "rule",
                      F.when(F.coalesce(F.col("n"), F.lit(0)) == 0, F.lit(0.0))
                      .otherwise(F.try_divide(F.col("s"), F.col("nn").cast("double"))).alias("mean_mmap"))


def _baseline_means(ks: DataFrame, keys: list[str], option_col: str = "option") -> DataFrame:
    """Per key and option: mean baseline score and the key's total row count."""
    total = sum((F.coalesce(F.col(f"n__{c}"), F.lit(0)) for c in CONDITIONS), F.lit(0))
    return ks.select(*keys, option_col,
                     F.try_divide(F.col("s__baseline"), F.col("nn__baseline").cast("double")).alias("_base"),
                     total.alias("_key_rows"))


def mmap_effect_rows(responses: DataFrame, rules_long: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """P22-P24 per response row and qualifying rule, baseline = mean of the key's baseline rows.

    The forced-choice rules are folded into the small per-key table first
    (key x rule -> chosen variant and its baseline mean), so raw rows take one
    many-to-one-per-rule join on (model, baseline_id); keys holding more than
    ``hot_rows`` rows are joined by broadcast, never shuffled (``split_hot_join``).
    """
    from armature.operators.skew import DEFAULT_HOT_ROWS, split_hot_join
    base = _baseline_means(mmap_key_stats(responses), ["model_id", "baseline_id", "scenario_id"])
    per_key = (base.join(_fc_rules(rules_long),
                         (F.col("scenario_id") == F.col("_sid")) & (F.col("option") == F.col("_pick")))
               .select("model_id", "baseline_id", "rule", "_pick", "_base", "_key_rows"))
    sc = _mmap_scores(responses)
    raw = responses.select("model_id", "baseline_id", "scenario_id", "question_ordering", "distractor_id",
                           "condition", sc["m1"].alias("_m1"), sc["m2"].alias("_m2"))
    r = split_hot_join(raw, per_key, ["model_id", "baseline_id"], "_key_rows", hot_rows or DEFAULT_HOT_ROWS)
    mmap = F.when(F.col("_pick") == "m1", F.col("_m1")).otherwise(F.col("_m2"))
    return r.select("model_id", "scenario_id", "question_ordering", "distractor_id", "condition", "rule",
                    mmap.alias("mmap"), F.col("_base").alias("mmap_base"),
                    (mmap - F.col("_base")).alias("mmap_diff"))


# ---------------------------------------------------------------------------
# Option families: NormBank options, verdict options, moral foundations
# ---------------------------------------------------------------------------

def option_scores(options: list[str], normalise: bool, suffix: str) -> dict[str, Column]:
    """P25: option share = p / sum(p), nulls count as 0 in the total."""
    cols = {o: nan_to_null(F.col(f"{o}{suffix}")) for o in options}
    if not normalise:
        return cols
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols.values()), F.lit(0.0))
    return {o: F.try_divide(c, total) for o, c in cols.items()}


def reference_points(df: DataFrame, options: list[str], suffix: str) -> dict[str, float]:
    """A score of each option from one row that has all of them (0 without such a row).

    Scores are counted from there: however large they are, what is left has the size of their spread, so means of keys and
    their differences lose no digits.  Any value serves, so the row need not be the same in every run.
    """
    cols = [nan_to_null(F.col(f"{o}{suffix}").cast("double")).alias(o) for o in options]
    row = df.select(*cols).dropna().limit(1).collect()
    return {o: float(row[0][o]) if row and abs(row[0][o]) != float("inf") else 0.0 for o in options}


def _option_key_stats(df, options, key, normalise, drop_zero, suffix, about=None):
    scores = option_scores(options, normalise, suffix)
    if about:
        scores = {o: c - F.lit(about[o]) for o, c in scores.items()}
    zero = None
    if drop_zero:
        zero = sum((F.coalesce(nan_to_null(F.col(f"{o}{suffix}")), F.lit(0.0)) for o in options),
                   F.lit(0.0)) == 0
    ks = key_stats(df, ["model_id", key], scores, zero)
    if drop_zero:
        ks = ks.where(F.col("zero_any") == 0)
    return ks, scores


def option_contributions(df: DataFrame, options: list[str], key: str = "scenario_id",
                         normalise: bool = True, drop_zero: bool = True,
                         suffix: str = "_prob", baseline: str = "join", about: Mapping[str, float] | None = None) -> DataFrame:
    """Contributions of every option; ``about`` are points that its scores are counted from (``reference_points``)."""
    ks, _ = _option_key_stats(df, options, key, normalise, drop_zero, suffix, about)
    return pair_contributions(ks, ["model_id", key], option_col="option", baseline=baseline)


def paired_effects(df: DataFrame, options: list[str], key: str = "scenario_id", normalise: bool = True,
                   drop_zero: bool = True, suffix: str = "_prob", baseline: str = "join") -> DataFrame:
    """Per (model, option, condition) statistics of score and change from baseline."""
    about = None if normalise else reference_points(df, options, suffix)
    out = summarise(option_contributions(df, options, key, normalise, drop_zero, suffix, baseline, about),
                    ["model_id", "option", "condition"])
    if not about:
        return out
    start = F.element_at(F.create_map(*[F.lit(x) for pair in about.items() for x in pair]), F.col("option"))
    return out.withColumn("mean_score", F.col("mean_score") + start)


def option_effect_rows(df: DataFrame, options: list[str], id_col: str, key: str = "scenario_id",
                       normalise: bool = True, drop_zero: bool = True, suffix: str = "_prob",
                       hot_rows: int | None = None) -> DataFrame:
    """Per row and option: share, mean baseline share of the key, difference (mean policy).

    Raw rows join the per-(key, option) baseline table on (model, key) - one
    output row per option - with hot keys broadcast (``split_hot_join``).
    """
    from armature.operators.skew import DEFAULT_HOT_ROWS, split_hot_join
    ks, scores = _option_key_stats(df, options, key, normalise, drop_zero, suffix)
    base = _baseline_means(ks, ["model_id", key])
    raw = df.select(id_col, "model_id", key, "condition", *[scores[o].alias(f"_x_{o}") for o in options])
    r = split_hot_join(raw, base, ["model_id", key], "_key_rows", hot_rows or DEFAULT_HOT_ROWS)
    share = None
    for o in options:
        share = (F.when(F.col("option") == o, F.col(f"_x_{o}")) if share is None
                 else share.when(F.col("option") == o, F.col(f"_x_{o}")))
    return r.select(id_col, "model_id", key, "condition", "option", share.alias("share"),
                    F.col("_base").alias("share_base"), (share - F.col("_base")).alias("share_diff"))
