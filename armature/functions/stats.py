"""Statistical column expressions: tails, step-down corrections, intervals.

Spark SQL has no ``erf``/``erfc``.  Rather than a Python UDF, the normal tail
is a closed-form SQL expression (power series below 3, continued fraction
above), evaluated inside whole-stage codegen.  The same string runs in DuckDB,
so every p-value built from it is checked by the oracle.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SERIES_TERMS = 40      # positive-term erf series, used for x < 1.5
_CF_DEPTH = 90          # erfc continued fraction, used for x >= 1.5
_SPLIT = 1.5


def _lit(v: float) -> str:
    return f"{v:.17e}"


def _series_coeffs() -> list[float]:
    coeffs, c = [], 1.0
    for n in range(_SERIES_TERMS):
        coeffs.append(c)
        c *= 2.0 / (2 * n + 3)
    return coeffs


def erfc_sql(x: str) -> str:
    """Spark SQL expression for erfc(x), x >= 0 (``x`` a column name); relative error <= ~1e-15.

    x < 1.5:  erfc = 1 - (2/sqrt(pi)) exp(-x^2) x sum_n (2x^2)^n / (1*3*...*(2n+1))   (Horner fold)
    x >= 1.5: erfc = exp(-x^2)/sqrt(pi) / (x + (1/2)/(x + 1/(x + (3/2)/(x + ...))))  (fold from depth up)
    Both are ``aggregate`` folds over small arrays - compact plans, no deep expression trees.
    """
    co = _series_coeffs()
    arr = "array(" + ", ".join(_lit(c) for c in reversed(co[:-1])) + ")"
    horner = f"aggregate({arr}, {_lit(co[-1])}, (acc, c) -> c + ({x} * {x}) * acc)"
    series = f"(1.0e+00 - {_lit(2 / math.sqrt(math.pi))} * exp(-({x} * {x})) * {x} * {horner})"
    frac = (f"aggregate(sequence({_CF_DEPTH}, 1, -1), {x}, "
            f"(t, k) -> {x} + CAST(k AS DOUBLE) / CAST(2 AS DOUBLE) / t)")
    cf = f"(exp(-({x} * {x})) / ({_lit(math.sqrt(math.pi))} * {frac}))"
    return f"(CASE WHEN {x} < {_lit(_SPLIT)} THEN {series} ELSE {cf} END)"


def erfc_duck_sql(x: str) -> str:
    """DuckDB twin of ``erfc_sql`` (same operations in the same order)."""
    co = _series_coeffs()
    arr = "[" + ", ".join(_lit(c) for c in reversed(co[:-1])) + "]"
    horner = f"list_reduce({arr}, lambda acc, c: c + ({x} * {x}) * acc, {_lit(co[-1])})"
    series = f"(1.0e+00 - {_lit(2 / math.sqrt(math.pi))} * exp(-({x} * {x})) * {x} * {horner})"
    frac = (f"list_reduce(range({_CF_DEPTH}, 0, -1), "
            f"lambda t, k: {x} + CAST(k AS DOUBLE) / CAST(2 AS DOUBLE) / t, CAST({x} AS DOUBLE))")
    cf = f"(exp(-({x} * {x})) / ({_lit(math.sqrt(math.pi))} * {frac}))"
    return f"(CASE WHEN {x} < {_lit(_SPLIT)} THEN {series} ELSE {cf} END)"


def log1p_sql(y: str) -> str:
    return (f"(CASE WHEN abs({y}) < 1.0e-04 THEN {y} - {y}*{y}/2.0e+00 + {y}*{y}*{y}/3.0e+00 "
            f"- {y}*{y}*{y}*{y}/4.0e+00 ELSE ln(1.0e+00 + {y}) END)")


def expm1_sql(y: str) -> str:
    return (f"(CASE WHEN abs({y}) < 1.0e-05 THEN {y} + {y}*{y}/2.0e+00 + {y}*{y}*{y}/6.0e+00 "
            f"ELSE exp({y}) - 1.0e+00 END)")


def two_sided_p(df: DataFrame, z: str, out: str) -> DataFrame:
    """Two-sided normal p-value 2*sf(|z|) = erfc(|z|/sqrt 2)."""
    tmp = f"_x_{out}"
    return (df.withColumn(tmp, F.abs(F.col(z)) / F.sqrt(F.lit(2.0)))
              .withColumn(out, F.expr(erfc_sql(tmp))).drop(tmp))





# ---------------------------------------------------------------------------
# Step-down corrections (T6, T7).  They run on result tables of p-values
# (one row per test: models x cells x pairs), never on raw rows.
# ---------------------------------------------------------------------------

def _per_slice(slices: DataFrame, by: list[str]) -> DataFrame:
    """(by..., _pid, _m, _before, _above) from (by..., _pid, _n[, _top]): family size, tests in earlier slices, their greatest _top."""
    top = "_top" in slices.columns
    if by:
        w = Window.partitionBy(*by)
        earlier = w.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
        return slices.select(*by, "_pid", F.sum("_n").over(w).alias("_m"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
                             (F.max("_top").over(earlier) if top else F.lit(None).cast("double")).alias("_above"))
    rows = sorted(slices.collect(), key=lambda r: r["_pid"])            # one row per range partition
    out, before, above = [], 0, None
    for r in rows:
        out.append((r["_pid"], sum(x["_n"] for x in rows), before, above))
        before += r["_n"]
        if top:
            above = r["_top"] if above is None else max(above, r["_top"])
    return slices.sparkSession.createDataFrame(out, "_pid int, _m long, _before long, _above double")


def _with_slices(df: DataFrame, slices: DataFrame, by: list[str]) -> DataFrame:
    keys = [*by, "_pid"]
    s = slices.select(*[F.col(k).alias(f"_s_{k}") for k in keys], "_m", "_before", "_above")
    same = F.lit(True)
    for k in keys:
        same = same & df[k].eqNullSafe(s[f"_s_{k}"])
    return df.join(F.broadcast(s) if not by else s, same).drop(*[f"_s_{k}" for k in keys])


def _step_down(df: DataFrame, p: str, out: str, by: list[str], raw) -> DataFrame:
    """Running maximum of ``raw(k)`` over ascending p, k = tests of the family not yet passed; capped at 1.

    A prefix scan: tests are range-partitioned by (family, p), so a slice holds a stretch of one
    family's order whatever its size; ranks and maxima inside a slice come from windows over it, and what earlier slices
    add is one row per slice.  A missing or NaN p is no test: it stays, without result and outside the family size.
    """
    from armature.session import cut_lineage
    # read twice below, tests and missing p
    df = cut_lineage(df.withColumn(p, F.when(~F.isnan(F.col(p)), F.col(p))))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # checkpointed, so that every later pass sees the same slices
    tests = cut_lineage(df.where(F.col(p).isNotNull()).repartitionByRange(n, *by, p).withColumn("_pid", F.spark_partition_id()))
    inside = Window.partitionBy(*by, "_pid").orderBy(p)
    tests = tests.withColumn("_in", F.row_number().over(inside))
    sizes = tests.groupBy(*by, "_pid").agg(F.count(F.lit(1)).alias("_n"))
    placed = _with_slices(tests, _per_slice(sizes, by), by)
    placed = raw(placed.withColumn("_k", (F.col("_m") - F.col("_before") - F.col("_in") + 1).cast("double")))
    tops = placed.groupBy(*by, "_pid").agg(F.count(F.lit(1)).alias("_n"), F.max("_raw").alias("_top"))
    # a RANGE frame: equal p share the greatest of theirs, whichever order the join above left them in
    own = F.max("_raw").over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = placed.select(*df.columns, "_pid", own.alias("_own"))
    carried = _with_slices(ranked, _per_slice(tops, by), by)
    done = carried.select(*df.columns, F.least(F.greatest("_own", "_above"), F.lit(1.0)).alias(out))
    return done.unionByName(df.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double")))


def holm(df: DataFrame, p: str = "p", out: str = "p_adj", by: list[str] | None = None) -> DataFrame:
    """Holm step-down: running max of (m-i+1)*p over ascending p, capped at 1."""
    return _step_down(df, p, out, by or [], lambda d: d.withColumn("_raw", F.col("_k") * F.col(p)))


def holm_sidak(df: DataFrame, p: str = "p", out: str = "p_adj", by: list[str] | None = None) -> DataFrame:
    """Holm-Sidak step-down: running max of 1-(1-p)^(m-i+1), computed as -expm1(k*log1p(-p))."""
    def raw(d: DataFrame) -> DataFrame:
        d = d.withColumn("_np", -F.col(p)).withColumn("_l", F.expr(log1p_sql("_np"))).withColumn("_e", F.col("_k") * F.col("_l"))
        return d.withColumn("_raw", F.when(F.col(p) >= 1, F.lit(1.0)).otherwise(-F.expr(expm1_sql("_e"))))     # log1p(-1) has no value
    return _step_down(df, p, out, by or [], raw)


def holm_sql(table: str, p: str = "p", by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"""(SELECT *, CASE WHEN {p} IS NOT NULL THEN least(max(_raw) OVER ({part}ORDER BY {p} NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0) END AS p_adj
      FROM (SELECT *, CAST(count({p}) OVER ({part.strip()}) - row_number() OVER ({part}ORDER BY {p} NULLS LAST) + 1 AS DOUBLE) * {p} AS _raw
            FROM {table}))"""


def holm_sidak_sql(table: str, p: str = "p", by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    inner = (f"SELECT *, CAST(count({p}) OVER ({part.strip()}) - row_number() OVER ({part}ORDER BY {p} NULLS LAST) + 1 AS DOUBLE) AS _k, "
             f"CASE WHEN {p} < 1 THEN -{p} END AS _np FROM {table}")
    l1 = f"SELECT *, {log1p_sql('_np')} AS _l FROM ({inner})"
    l2 = f"SELECT *, _k * _l AS _e FROM ({l1})"
    l3 = f"SELECT *, CASE WHEN {p} >= 1 THEN 1.0 ELSE -{expm1_sql('_e')} END AS _raw FROM ({l2})"
    return (f"(SELECT *, least(max(_raw) OVER ({part}ORDER BY {p} ROWS BETWEEN UNBOUNDED PRECEDING "
            f"AND CURRENT ROW), 1.0) AS p_adj FROM ({l3}))")


# ---------------------------------------------------------------------------
# Proportions
# ---------------------------------------------------------------------------

def wilson_interval(k: Column, n: Column, z: float):
    """95% Wilson score interval for k successes in n trials -> (lo, hi)."""
    nd = n.cast("double")
    phat = F.try_divide(k.cast("double"), nd)
    z2 = z * z
    denom = 1 + z2 / nd
    centre = (phat + z2 / (2 * nd)) / denom
    half = z * F.sqrt(phat * (1 - phat) / nd + z2 / (4 * nd * nd)) / denom
    return centre - half, centre + half


def pooled_z(k1: Column, n1: Column, k0: Column, n0: Column) -> Column:
    """Two-proportion z statistic with pooled variance (null when undefined)."""
    p1 = F.try_divide(k1.cast("double"), n1.cast("double"))
    p0 = F.try_divide(k0.cast("double"), n0.cast("double"))
    pp = F.try_divide((k1 + k0).cast("double"), (n1 + n0).cast("double"))
    var = pp * (1 - pp) * (F.try_divide(F.lit(1.0), n1.cast("double")) + F.try_divide(F.lit(1.0), n0.cast("double")))
    return F.try_divide(p1 - p0, F.sqrt(var))


# ---------------------------------------------------------------------------
# Chi-square upper tail for integer degrees of freedom as SQL expressions
# (even k: Poisson sum; odd k: erfc plus half-integer gamma terms).  Spark
# folds the terms recursively with ``aggregate``; the DuckDB twin sums
# exp(log-terms) with lgamma.  ``x`` and ``k`` are column names.
# ---------------------------------------------------------------------------

def chi2_sf_sql(x: str, k: str) -> str:
    y = f"(CAST({x} AS DOUBLE) / 2.0e+00)"
    half = f"(CAST({k} AS INT) DIV 2)"
    even_sum = (f"aggregate(sequence(1, {half} - 1), named_struct('t', 1.0D, 's', 1.0D), "
                f"(acc, j) -> named_struct('t', acc.t * {y} / j, 's', acc.s + acc.t * {y} / j), acc -> acc.s)")
    even = f"(CASE WHEN {half} - 1 < 1 THEN exp(-{y}) ELSE exp(-{y}) * {even_sum} END)"
    g15 = _lit(math.sqrt(math.pi) / 2)
    step = f"(CASE WHEN j = 1 THEN sqrt({y}) / {g15} ELSE acc.t * {y} / (CAST(j AS DOUBLE) - 5.0e-01) END)"
    odd_sum = (f"aggregate(sequence(1, {half}), named_struct('t', 0.0D, 's', 0.0D), "
               f"(acc, j) -> named_struct('t', {step}, 's', acc.s + {step}), acc -> acc.s)")
    odd = (f"(CASE WHEN {half} < 1 THEN {erfc_sql(f'sqrt({y})')} "
           f"ELSE {erfc_sql(f'sqrt({y})')} + exp(-{y}) * {odd_sum} END)")
    return (f"(CASE WHEN {x} IS NULL OR {k} IS NULL OR {k} < 1 THEN NULL WHEN {x} <= 0 THEN 1.0D "
            f"WHEN CAST({k} AS INT) % 2 = 0 THEN {even} ELSE {odd} END)")


def chi2_sf_duck(x: str, k: str) -> str:
    y = f"(CAST({x} AS DOUBLE) / 2.0e+00)"
    half = f"(CAST({k} AS INTEGER) // 2)"
    even = (f"(exp(-{y}) * coalesce(list_sum(list_transform(range(0, {half}), "
            f"lambda j: exp(j * ln({y}) - lgamma(j + 1)))), 0))")
    odd = (f"({erfc_duck_sql(f'sqrt({y})')} + exp(-{y}) * coalesce(list_sum(list_transform(range(1, {half} + 1), "
           f"lambda j: exp((j - 0.5) * ln({y}) - lgamma(j + 0.5)))), 0))")
    return (f"(CASE WHEN {x} IS NULL OR {k} IS NULL OR {k} < 1 THEN NULL WHEN {x} <= 0 THEN 1.0 "
            f"WHEN CAST({k} AS INTEGER) % 2 = 0 THEN {even} ELSE {odd} END)")
