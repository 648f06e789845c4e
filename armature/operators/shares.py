"""Shares, counts, pivots and melts over scored responses.

Every count is a partial-aggregated ``groupBy``; "group total beside each row"
(W1) is a window over the already-aggregated counts, whose partitions hold at
most a handful of rows (one per verdict), never over raw responses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armature.schemas import FOUNDATION_LABELS, VERDICTS

TYPE_OF_CONDITION = {"baseline": "baseline", "positive": "pos", "neutral": "neu", "negative": "neg"}
DISTRACTOR_TYPES = ["baseline", "pos", "neu", "neg"]


def distractor_type(condition: Column) -> Column:
    """Polarity label from the condition (Q5: taken from the registry, images included)."""
    out = None
    for c, t in TYPE_OF_CONDITION.items():
        out = (F.when(condition == c, F.lit(t)) if out is None else out.when(condition == c, F.lit(t)))
    return out


def distractor_type_from_id(distractor_id: Column) -> Column:
    """P19 as in the reference: regex on the id; no match (incl. images) -> baseline."""
    return F.coalesce(F.nullif(F.regexp_extract(distractor_id.cast("string"), r"txt_(neg|neu|pos)", 1),
                               F.lit("")), F.lit("baseline"))


def with_group_share(counts: DataFrame, by: list[str], count_col: str = "count",
                     out: str = "share") -> DataFrame:
    """Share of each row's count in its group's total."""
    w = Window.partitionBy(*by)
    return counts.withColumn(out, F.col(count_col) / F.sum(count_col).over(w))


def verdict_shares(df: DataFrame, by: list[str], verdict: str = "verdict") -> DataFrame:
    """Count and share of each verdict per ``by``; null verdicts are dropped."""
    counts = (df.where(F.col(verdict).isNotNull()).groupBy(*by, verdict)
              .agg(F.count(F.lit(1)).alias("count")))
    return with_group_share(counts, by)


#: The most distinct verdicts that a table may get columns or grid cells for; more is an error, never a cut.
MOST_VERDICTS = 10_000


def verdicts_seen(df: DataFrame, verdict: str = "verdict") -> list[str]:
    """The known verdicts in their order, then every other one in the data."""
    rows = df.where(F.col(verdict).isNotNull()).select(verdict).distinct().limit(MOST_VERDICTS + 1).collect()
    if len(rows) > MOST_VERDICTS:
        raise ValueError(f"more than {MOST_VERDICTS} distinct verdicts")
    seen = {r[0] for r in rows}
    return VERDICTS + sorted(seen - set(VERDICTS))


def share_delta(shares: DataFrame) -> DataFrame:
    """J8 + P26: treated share minus baseline share on the complete (type, verdict) grid.

    Grid = every non-baseline (model, type) present x every verdict seen anywhere, whatever its label;
    a missing share or baseline share counts as 0 (Q15: complete grid).
    """
    seen = shares.select("verdict").distinct()
    domain = F.array(*[F.lit(v) for v in verdicts_seen(shares)])
    grid = (shares.where(F.col("distractor_type") != "baseline").select("model_id", "distractor_type").distinct()
            .select("model_id", "distractor_type", F.explode(domain).alias("verdict"))
            .join(seen, "verdict", "left_semi"))
    base = (shares.where(F.col("distractor_type") == "baseline")
            .select("model_id", "verdict", F.col("share").alias("share_base")))
    g = (grid.join(shares.select("model_id", "distractor_type", "verdict", "share"),
                   ["model_id", "distractor_type", "verdict"], "left")
         .join(base, ["model_id", "verdict"], "left"))
    share = F.coalesce(F.col("share"), F.lit(0.0))
    sb = F.coalesce(F.col("share_base"), F.lit(0.0))
    return g.select("model_id", "distractor_type", "verdict", share.alias("share"), sb.alias("share_base"),
                    (share - sb).alias("delta"))


def conditional_counts(df: DataFrame, by: list[str], target: str, verdict: str = "verdict") -> DataFrame:
    """n = all rows (null verdicts included), k = rows with the target verdict."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                               F.count_if(F.col(verdict) == target).alias("k"))


def contingency(df: DataFrame, by: list[str], verdict: str = "verdict") -> DataFrame:
    """Counts pivoted to one column per verdict, zeros filled: the known verdicts and every other one seen."""
    domain = verdicts_seen(df, verdict)
    return (df.where(F.col(verdict).isNotNull()).groupBy(*by).pivot(verdict, domain)
            .agg(F.count(F.lit(1))).fillna(0, subset=[f"`{v}`" for v in domain]))


def top_foundation(score_cols: list[str] | None = None) -> Column:
    """Label of the highest score; ties -> first column; nulls and NaN skipped; none left -> null."""
    cols = score_cols or list(FOUNDATION_LABELS)
    g = F.greatest(*[_number(c) for c in cols])
    out = None
    for c in cols:
        lab = F.lit(FOUNDATION_LABELS[c])
        out = F.when(_number(c) == g, lab) if out is None else out.when(_number(c) == g, lab)
    return out


def _number(c: str) -> Column:
    return F.when(~F.isnan(F.col(c)), F.col(c))


def melt_foundations(df: DataFrame, ids: list[str]) -> DataFrame:
    """A18 melt: (ids..., foundation label, score)."""
    entries = [F.struct(F.lit(lab).alias("foundation"), F.col(c).alias("score"))
               for c, lab in FOUNDATION_LABELS.items()]
    return df.select(*ids, F.explode(F.array(*entries)).alias("e")).select(*ids, "e.foundation", "e.score")


def mean_scores(df: DataFrame, by: list[str], cols: list[str] | None = None) -> DataFrame:
    """Plain means per group (nulls and NaN skipped)."""
    cols = cols or list(FOUNDATION_LABELS)
    return df.groupBy(*by).agg(*[F.avg(_number(c)).alias(c) for c in cols])


def length_means(distractor_texts: DataFrame, scenario_texts: DataFrame, col: str = "text") -> DataFrame:
    """Mean distractor length in bytes (file sizes) and mean scenario length in characters."""
    a = distractor_texts.agg(F.avg(F.octet_length(col)).alias("mean_length"), F.count(F.lit(1)).alias("n")) \
        .select(F.lit("distractor_bytes").alias("measure"), "mean_length", "n")
    b = scenario_texts.agg(F.avg(F.length(col)).alias("mean_length"), F.count(F.lit(1)).alias("n")) \
        .select(F.lit("scenario_chars").alias("measure"), "mean_length", "n")
    return a.unionByName(b)
