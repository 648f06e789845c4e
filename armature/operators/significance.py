"""Significance tests over response tables (T2-T5), distributed end to end.

Raw rows are only ever touched by partial-aggregated ``groupBy``s; the tests
themselves then run on tables with one row per (model, cell) or per distinct
value.  The Kruskal-Wallis ranks are computed without a window over a whole
(model, foundation) group: distinct values are range-partitioned, running
counts are taken per (partition, group) slice, and each slice's offset comes
from a prefix sum over the small table of slice totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from armature.functions import stats as S
from armature.operators import shares as SH
from armature.schemas import WILSON_Z

TREATED_TYPES = ["neg", "neu", "pos"]


def two_proportion_tests(df: DataFrame, target, by: str = "model_id",
                         type_col: str = "distractor_type", verdict: str = "verdict") -> DataFrame:
    """Each treated type vs baseline, pooled two-proportion z-test on ``verdict == target``.

    ``target`` may be a list: all targets are tested in one pass.  Raw rows are
    aggregated once to (model, type, verdict) counts; n (null verdicts
    included) and k per target come from that small table.
    """
    targets = [target] if isinstance(target, str) else list(target)
    counts = df.groupBy(by, type_col, verdict).agg(F.count(F.lit(1)).alias("c"))
    cells = (counts.groupBy(by, type_col).agg(F.sum("c").alias("n"))
             .select(by, type_col, "n", F.explode(F.array(*[F.lit(t) for t in targets])).alias("target")))
    hits = counts.where(F.col(verdict).isin(targets)).select(by, type_col, F.col(verdict).alias("target"),
                                                              F.col("c").alias("k"))
    cc = cells.join(hits, [by, type_col, "target"], "left").fillna(0, subset=["k"])
    base = cc.where(F.col(type_col) == "baseline").select(by, "target", F.col("n").alias("n0"), F.col("k").alias("k0"))
    comp = cc.where(F.col(type_col).isin(TREATED_TYPES)).join(base, [by, "target"], "left")
    n0 = F.coalesce(F.col("n0"), F.lit(0))
    k0 = F.coalesce(F.col("k0"), F.lit(0))
    b = F.try_divide(k0.cast("double"), n0.cast("double"))
    c = F.try_divide(F.col("k").cast("double"), F.col("n").cast("double"))
    out = comp.select(by, "target", F.concat(F.col(type_col), F.lit(" vs baseline")).alias("comparison"),
                      b.alias("baseline"), c.alias("comp"), (c - b).alias("delta"),
                      S.pooled_z(F.col("k"), F.col("n"), k0, n0).alias("z"))
    return S.two_sided_p(out, "z", "p")


def wilson_table(df: DataFrame, target: str, by: str = "model_id", type_col: str = "distractor_type") -> DataFrame:
    """Share and 95% Wilson interval per (model, type)."""
    cc = SH.conditional_counts(df, [by, type_col], target)
    lo, hi = S.wilson_interval(F.col("k"), F.col("n"), WILSON_Z)
    return cc.select(by, type_col, F.try_divide(F.col("k").cast("double"), F.col("n").cast("double")).alias("share"),
                     lo.alias("ci_lo"), hi.alias("ci_hi"))


def chi_square_tests(df: DataFrame, by: str = "model_id", type_col: str = "distractor_type",
                     verdict: str = "verdict") -> DataFrame:
    """T4: chi-square test of independence of type x verdict per model (Yates when dof = 1).

    Grid = types present in the model x verdicts present in the model (as a
    per-model pivot table has), zero cells included.  Rows without a type (unmatched
    distractor ids) are left out of cells and margins alike.
    """
    obs = (df.where(F.col(verdict).isNotNull() & F.col(type_col).isNotNull()).groupBy(by, type_col, verdict)
           .agg(F.count(F.lit(1)).alias("o")))
    types = obs.select(by, type_col).distinct()
    verds = obs.select(by, verdict).distinct()
    grid = types.join(verds, by)
    cells = grid.join(obs, [by, type_col, verdict], "left").fillna(0, subset=["o"])
    rt = obs.groupBy(by, type_col).agg(F.sum("o").alias("rt"))
    ct = obs.groupBy(by, verdict).agg(F.sum("o").alias("ct"))
    tot = obs.groupBy(by).agg(F.sum("o").alias("nt"), F.countDistinct(type_col).alias("r"),
                              F.countDistinct(verdict).alias("c"))
    cells = cells.join(rt, [by, type_col]).join(ct, [by, verdict]).join(tot, by)
    e = F.col("rt") * F.col("ct") / F.col("nt").cast("double")
    dof = (F.col("r") - 1) * (F.col("c") - 1)
    diff = e - F.col("o")
    yates_o = F.col("o") + F.signum(diff) * F.least(F.lit(0.5), F.abs(diff))
    o_used = F.when(dof == 1, yates_o).otherwise(F.col("o").cast("double"))
    term = F.when(dof == 0, F.lit(0.0)).otherwise((o_used - e) * (o_used - e) / e)
    return (cells.groupBy(by).agg(F.sum(term).alias("chi2"), F.first(dof).alias("dof"))
            .select(by, "chi2", F.col("dof").cast("long").alias("dof")))


def with_chi2_p(df: DataFrame, stat: str, dof: str, out: str = "p") -> DataFrame:
    """Chi-square upper tail as a JVM-side expression (integer degrees of freedom)."""
    return df.withColumn(out, F.expr(S.chi2_sf_sql(stat, dof)))


def average_ranks(df: DataFrame, by: list[str], value: str, partitions: int | None = None) -> DataFrame:
    """Average (tie-aware) rank of every distinct value within ``by``, at any group size.

    Returns (by..., value, n_v, rank) with rank = number of smaller values
    + (n_v + 1) / 2 - the rank scipy's ``rankdata`` gives to tied values.

    Distinct values are range-partitioned on (by..., value) - the sampled range
    bounds split even a single huge group evenly - and checkpointed so the
    partition assignment is fixed.  Running counts use a window over
    (partition, group): each window holds one range partition's slice of a
    group, never the whole group.  The counts of earlier partitions of the same
    group come from a prefix sum over the small (partition x group) totals.
    """
    from armature.session import cut_lineage
    d = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n_v"))
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = d.repartitionByRange(n, *by, value).withColumn("_pid", F.spark_partition_id())
    s = cut_lineage(s)
    w = Window.partitionBy("_pid", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_below", F.coalesce(F.sum("n_v").over(w), F.lit(0)))
    tot = s.groupBy("_pid", *by).agg(F.sum("n_v").alias("_t"))
    wo = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.withColumn("_off", F.coalesce(F.sum("_t").over(wo), F.lit(0))).drop("_t")
    r = s.join(off, ["_pid", *by])
    return r.select(*by, value, "n_v", (F.col("_off") + F.col("_below") + (F.col("n_v") + 1) / 2.0).alias("rank"))


def kruskal_tests(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """T5: tie-corrected Kruskal-Wallis H per ``by`` across ``group``s; needs >= 2 non-empty groups."""
    x = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value)))
    ranks = average_ranks(x, by, value)
    per = x.groupBy(*by, value, group).agg(F.count(F.lit(1)).alias("n_g"))
    per = per.join(ranks.select(*by, value, "rank"), by + [value])
    rs = per.groupBy(*by, group).agg(F.sum(F.col("n_g") * F.col("rank")).alias("r_sum"),
                                     F.sum("n_g").alias("n_g"))
    tiesum = ranks.groupBy(*by).agg(
        F.sum(F.col("n_v").cast("double") ** 3 - F.col("n_v")).alias("t3"),
        F.sum("n_v").alias("n"))
    g = (rs.groupBy(*by).agg(F.sum(F.col("r_sum") * F.col("r_sum") / F.col("n_g")).alias("ssbn"),
                             F.count(F.lit(1)).alias("k"))
         .join(tiesum, by).where(F.col("k") >= 2))
    n = F.col("n").cast("double")
    h = 12.0 / (n * (n + 1)) * F.col("ssbn") - 3 * (n + 1)
    corr = 1 - F.col("t3") / (n * n * n - n)
    return g.select(*by, F.try_divide(h, corr).alias("H"), (F.col("k") - 1).alias("dof"))
