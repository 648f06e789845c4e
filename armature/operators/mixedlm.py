"""Pairwise random-intercept tests, ``score ~ condition + (1 | baseline key)``.

The model y = b0 + b1*x + u_g + e (x = 1 for the test level; u ~ N(0, lam*s2))
depends on the data only through per-group sums, and groups with the same
size n and test count s share all weights.  So:

  pass 1  groupBy(cell, key)            -> per condition: count, sum, centred moment
          (for each condition pair)     -> n, s, sy, sxy and the centred moment m of each group
  pass 2  groupBy(cell, pair, n, s)     -> G, sums, the centred moment of sy: one row per class
  fit     one optimiser for all cells at once: the profile REML criterion is an aggregate over
          the classes of a cell at each point of a grid of log lam; the best point per cell is the least
          (criterion, point) pair, finer grids follow around it, and a parabola through the last three points ends it.

With w = lam / (1 + n*lam), per class:
  A += G*[[n - w n^2, s - w n s], [., s - w s^2]],  b += [Sy - w n Sy, Sxy - w s Sy],
  c += Syy - w Sy2,  logdet += G log(1 + n lam);
  -2 REML (up to constants) = (N-2) log(c - b'A^-1 b) + logdet + log|A|.
The intercept absorbs any shift, so scores are taken about the cell's mean and large ones lose nothing.
Reference level = alphabetically first of the pair (as the formula API sorts levels).  ``edge`` marks a cell whose
criterion still falls at the upper end of the search, where the variance ratio is not identified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armature.functions.stats import erfc_duck_sql, two_sided_p
from armature.schemas import CONDITION_PAIRS, CONDITIONS
from armature.session import cut_lineage

#: The search over t = log(lam): first grid, then points around the best one at each finer step.
LOW, HIGH, STEP = -18.0, 12.0, 0.25
FINER, AROUND = (0.0125, 0.000625), 20


def group_sums(contrib: DataFrame, cell: list[str], key: list[str]) -> DataFrame:
    """Pass 1a: per (cell, key) each condition's count, sum and square sum about ``about``, one of the group's means."""
    mean = F.try_divide(F.col("x_s"), F.col("x_n").cast("double"))
    # the key first: rows are sorted by these, and cells are few, so most comparisons end at the key
    anchored = (contrib.where("x_n > 0").withColumn("_mu", mean)
                .withColumn("about", F.max("_mu").over(Window.partitionBy(*key, *cell))))
    off = F.col("_mu") - F.col("about")
    aggs = [F.min("about").alias("about")]
    for c in CONDITIONS:
        m = F.col("condition") == c
        aggs += [F.sum(F.when(m, F.col("x_n"))).alias(f"n_{c}"), F.sum(F.when(m, F.col("x_n") * off)).alias(f"s_{c}"),
                 F.sum(F.when(m, F.col("x_m") + F.col("x_n") * off * off)).alias(f"q_{c}")]
    return anchored.groupBy(*cell, *key).agg(*aggs)


def pair_groups(gs: DataFrame, cell: list[str]) -> DataFrame:
    """Pass 1b: one row per (cell, number of the condition pair, group) with n, s, sy, sxy and the centred moment m."""
    def z(c):
        return F.coalesce(F.col(c), F.lit(0))
    entries = []
    for i, (a, b) in enumerate(CONDITION_PAIRS):
        test = max(a, b)
        n, sy, sxy = z(f"n_{a}") + z(f"n_{b}"), (z(f"s_{a}") + z(f"s_{b}")).cast("double"), z(f"s_{test}").cast("double")
        entries.append(F.struct(
            F.lit(i).alias("_pair"), n.alias("n"), z(f"n_{test}").alias("s"), (n * F.col("about") + sy).alias("sy"),
            (z(f"n_{test}") * F.col("about") + sxy).alias("sxy"),
            ((z(f"q_{a}") + z(f"q_{b}")).cast("double") - F.try_divide(sy * sy, n.cast("double"))).alias("m")))
    return (gs.select(*cell, F.explode(F.array(*entries)).alias("e")).select(*cell, "e.*")
            .where(F.col("n") > 0))


def class_stats(pg: DataFrame, cell: list[str]) -> DataFrame:
    """Pass 2: groups collapse into (n, s) classes; sums are about the mean of their (cell, pair)."""
    cls = pg.groupBy(*cell, "_pair", "n", "s").agg(
        F.count(F.lit(1)).alias("G"), F.sum("sy").alias("Sy"), F.sum("sxy").alias("Sxy"),
        F.sum("m").alias("M"), (F.var_pop("sy") * F.count(F.lit(1))).alias("V"))
    whole = Window.partitionBy(*cell, "_pair")
    c0 = F.sum("Sy").over(whole) / F.sum(F.col("G") * F.col("n")).over(whole)
    sy, sxy = F.col("Sy") - F.col("G") * F.col("n") * c0, F.col("Sxy") - F.col("G") * F.col("s") * c0
    # names are given to classes, not carried by every group
    def named(names):
        return F.array(*map(F.lit, names))[F.col("_pair")]
    out = cls.select(*cell, named([f"{a}_vs_{b}" for a, b in CONDITION_PAIRS]).alias("pair"), named(map(min, CONDITION_PAIRS)).alias("ref"),
                     named(map(max, CONDITION_PAIRS)).alias("test"), F.col("n").cast("double").alias("n"), F.col("s").cast("double").alias("s"),
                     F.col("G").cast("double").alias("G"), sy.alias("Sy"), sxy.alias("Sxy"),
                     (F.col("V") + sy * sy / F.col("G")).alias("Sy2"), "M")
    return out.withColumn("Syy", F.col("M") + F.col("Sy2") / F.col("n")).drop("M")


#: The sums of the criterion at lam (SQL aggregates that both engines read).
_SUMS = {"n_obs": "sum(G * n)", "n_groups": "sum(G)",
         "a00": "sum(G * (n - lam / (1 + n * lam) * n * n))", "a01": "sum(G * (s - lam / (1 + n * lam) * n * s))",
         "a11": "sum(G * (s - lam / (1 + n * lam) * s * s))", "b0": "sum(Sy - lam / (1 + n * lam) * n * Sy)",
         "b1": "sum(Sxy - lam / (1 + n * lam) * s * Sy)", "c": "sum(Syy - lam / (1 + n * lam) * Sy2)", "ld": "sum(G * ln(1 + n * lam))"}
_DET = "(a00 * a11 - a01 * a01)"
_RSS = f"(c - (a11 * b0 * b0 - 2 * a01 * b0 * b1 + a00 * b1 * b1) / nullif({_DET}, 0))"
_CRIT = (f"CASE WHEN n_obs > 2 AND {_DET} > 1e-12 * a00 * a11 AND {_RSS} > 0 "
         f"THEN (n_obs - 2) * ln({_RSS}) + ld + ln({_DET}) END")


def criterion(classes: DataFrame, cell: list[str], points: Column) -> DataFrame:
    """(cell, pair, t, sums..., crit): the criterion of every (cell, pair) at each point of the array ``points``."""
    keys = [*cell, "pair"]
    at = classes.select("*", F.explode(points).alias("t")).withColumn("lam", F.coalesce(F.exp("t"), F.lit(0.0)))
    sums = at.groupBy(*keys, "t").agg(*[F.expr(e).alias(k) for k, e in _SUMS.items()])
    return sums.withColumn("crit", F.expr(_CRIT))


def _best(at: DataFrame, keys: list[str]) -> DataFrame:
    return at.where("crit IS NOT NULL").groupBy(*keys).agg(F.min(F.struct("crit", "t"))["t"].alias("best"))


def fit_cells(classes: DataFrame, cell: list[str]) -> DataFrame:
    """Coefficient, z, two-sided p and variance ratio of every (cell, pair); nulls where the model cannot be fitted."""
    keys = [*cell, "pair"]
    classes = cut_lineage(classes)
    labels = classes.select(*keys, "ref", "test").distinct()
    first = F.transform(F.sequence(F.lit(0), F.lit(round((HIGH - LOW) / STEP))), lambda i: i * F.lit(STEP) + F.lit(LOW))
    best = _best(criterion(classes, cell, first), keys)
    for step in FINER:
        near = F.transform(F.sequence(F.lit(-AROUND), F.lit(AROUND)), lambda i: F.col("best") + i * F.lit(step))
        best = _best(criterion(classes.join(best, keys), cell, near), keys)
    h = FINER[-1]
    near = F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: F.col("best") + i * F.lit(h))
    three = criterion(classes.join(best, keys), cell, near).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("t", "crit"))).alias("p"))
    bend = F.expr("p[0].crit - 2 * p[1].crit + p[2].crit")
    vertex = F.when(bend > 0, F.expr("p[1].t") + F.greatest(F.lit(-h), F.least(F.lit(h), h * 0.5 * F.expr("p[0].crit - p[2].crit") / bend)))
    found = three.select(*keys, F.coalesce(vertex, F.expr("p[1].t")).alias("found"))
    # the boundary lam = 0 (a null point) wins ties
    ends = criterion(classes.join(found, keys, "left"), cell, F.array_distinct(F.array(F.lit(None).cast("double"), F.col("found"))))
    least = ends.groupBy(*keys).agg(F.min(F.struct(F.coalesce("crit", F.lit(float("inf"))).alias("crit"), "t", *_SUMS)).alias("e"))
    e = least.select(*keys, "e.*").withColumn("fits", F.col("crit") < float("inf"))
    e = e.withColumn("coef", F.when(F.col("fits"), F.expr(f"(a00 * b1 - a01 * b0) / {_DET}")))
    e = e.withColumn("z", F.when(F.col("fits"), F.expr(f"coef / nullif(sqrt({_RSS} / (n_obs - 2) * a00 / {_DET}), 0)")))
    e = two_sided_p(e, "z", "p")
    return e.join(labels, keys).select(
        *keys, "ref", "test", "coef", "z", "p", F.when(F.col("fits"), F.coalesce(F.exp("t"), F.lit(0.0))).alias("lam"),
        F.col("n_obs").cast("long").alias("n_obs"), F.col("n_groups").cast("long").alias("n_groups"),
        F.coalesce(F.col("t") > HIGH - STEP, F.lit(False)).alias("edge"))


def mixed_lm_pairs(contrib: DataFrame, cell: list[str], key: list[str]) -> DataFrame:
    """T1 for every cell and the six condition pairs."""
    return fit_cells(class_stats(pair_groups(group_sums(contrib, cell, key), cell), cell), cell)


def mixed_lm_sql(contrib: str, cell: str, key: str) -> str:
    """T1 in DuckDB: CTEs after ``contrib`` (cell, key, condition, y, times: scores and how often each enters)."""
    keys = f"{cell}, pair"
    sums = ", ".join(f"{e} AS {k}" for k, e in _SUMS.items())
    pairs = ", ".join(f"('{a}_vs_{b}', '{min(a, b)}', '{max(a, b)}')" for a, b in CONDITION_PAIRS)

    def at(name: str, source: str, points: str) -> str:
        return (f"{name} AS (SELECT *, {_CRIT} AS crit FROM (SELECT {keys}, t, {sums} FROM (SELECT *, coalesce(exp(t), 0.0) AS lam "
                f"FROM (SELECT *, unnest({points}) AS t FROM {source})) GROUP BY {keys}, t))")

    def best(name: str, source: str) -> str:
        return f"{name} AS (SELECT {keys}, min({{'crit': crit, 't': t}}).t AS best FROM {source} WHERE crit IS NOT NULL GROUP BY {keys})"

    h = FINER[-1]
    joined = lambda b: f"(SELECT * FROM cls JOIN {b} USING ({keys}))"
    rounds = [at("at0", "cls", f"list_transform(range(0, {round((HIGH - LOW) / STEP) + 1}), lambda i: i * {STEP}::DOUBLE + ({LOW})::DOUBLE)"),
              best("best0", "at0")]
    for i, step in enumerate(FINER, 1):
        rounds += [at(f"at{i}", joined(f"best{i - 1}"), f"list_transform(range(-{AROUND}, {AROUND + 1}), lambda i: best + i * {step}::DOUBLE)"),
                   best(f"best{i}", f"at{i}")]
    rounds.append(at("at9", joined(f"best{len(FINER)}"), f"list_transform(range(-1, 2), lambda i: best + i * {h}::DOUBLE)"))
    bend = "(p[1].crit - 2 * p[2].crit + p[3].crit)"
    return f"""
prs AS (SELECT * FROM (VALUES {pairs}) v(pair, ref, test)),
wm AS (SELECT {cell}, pair, ref, test, sum(y * times) / sum(times) AS c0 FROM {contrib} JOIN prs ON condition IN (ref, test)
       WHERE y IS NOT NULL GROUP BY ALL),
grp AS (SELECT {cell}, pair, ref, test, {key}, sum(times) AS n, coalesce(sum(times) FILTER (WHERE condition = test), 0) AS s,
          sum((y - c0) * times) AS sy, coalesce(sum((y - c0) * times) FILTER (WHERE condition = test), 0) AS sxy, sum((y - c0) * (y - c0) * times) AS syy
        FROM {contrib} JOIN wm USING ({cell}) WHERE condition IN (ref, test) AND y IS NOT NULL GROUP BY ALL),
cls AS (SELECT {cell}, pair, ref, test, n::DOUBLE AS n, s::DOUBLE AS s, count(*)::DOUBLE AS G, sum(sy) AS Sy, sum(sxy) AS Sxy, sum(syy) AS Syy,
          sum(sy * sy) AS Sy2 FROM grp GROUP BY ALL),
{", ".join(rounds)},
tri AS (SELECT {keys}, list({{'t': t, 'crit': crit}} ORDER BY t) AS p FROM at9 GROUP BY {keys}),
fnd AS (SELECT {keys}, coalesce(CASE WHEN {bend} > 0 THEN p[2].t + greatest(-{h}, least({h}, {h} * 0.5 * (p[1].crit - p[3].crit) / {bend})) END, p[2].t) AS found FROM tri),
{at("endp", f"(SELECT cls.*, found FROM cls LEFT JOIN fnd USING ({keys}))", "CASE WHEN found IS NULL THEN [NULL::DOUBLE] ELSE [NULL, found] END")},
lst AS (SELECT * FROM endp QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY coalesce(crit, 'inf'::DOUBLE), t NULLS FIRST) = 1),
fit AS (SELECT *, CASE WHEN crit IS NOT NULL THEN (a00 * b1 - a01 * b0) / {_DET} END AS coef FROM lst),
zed AS (SELECT *, CASE WHEN crit IS NOT NULL THEN coef / nullif(sqrt({_RSS} / (n_obs - 2) * a00 / {_DET}), 0) END AS z FROM fit),
tst AS (SELECT {keys}, ref, test, coef, z, {erfc_duck_sql("x")} AS p, n_obs::BIGINT AS n_obs, n_groups::BIGINT AS n_groups, coalesce(t > {HIGH - STEP}, false) AS edge
        FROM (SELECT *, abs(z) / sqrt(2.0::DOUBLE) AS x FROM zed) JOIN (SELECT DISTINCT {keys}, ref, test FROM cls) USING ({keys}))"""
