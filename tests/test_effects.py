"""Paired effects on sufficient statistics vs a brute-force restatement of the
reference (pandas merge fan-out, np.mean / np.std / len) on small fixtures with
a hot key, duplicate baselines, nulls and zero-sum keys."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from armature.operators import effects as E

CONDS = ["baseline", "positive", "neutral", "negative"]


def _fixture(seed=0, n=400):
    rng = np.random.default_rng(seed)
    keys = np.where(rng.random(n) < 0.35, 0, rng.integers(1, 25, n))      # key 0 holds a third
    cond = rng.choice(CONDS, n, p=[0.3, 0.25, 0.25, 0.2])
    good = rng.random(n).round(3)
    ok = rng.random(n).round(3)
    bad = rng.random(n).round(3)
    good[rng.random(n) < 0.05] = np.nan
    zero = rng.random(n) < 0.02
    good[zero], ok[zero], bad[zero] = 0.0, 0.0, 0.0
    return pd.DataFrame({"model_id": rng.choice(["m1", "m2"], n), "scenario_id": keys.astype("int64"),
                         "condition": cond, "good_prob": good, "ok_prob": ok, "bad_prob": bad})


def _brute(df, options, normalise, drop_zero):
    out = []
    for m, d in df.groupby("model_id"):
        if drop_zero:
            tot = d[[f"{o}_prob" for o in options]].sum(axis=1)
            bad_keys = d.loc[tot == 0, "scenario_id"].tolist()
            d = d.loc[~d["scenario_id"].isin(bad_keys)]
        base = d[d["condition"] == "baseline"]
        for o in options:
            for c in CONDS:
                x = d[d["condition"] == c]
                if len(x) == 0:
                    continue
                j = x.merge(base[["scenario_id"] + [f"{p}_prob" for p in options]], on="scenario_id",
                            how="left", suffixes=["_d", "_b"])
                vals = {}
                for side in ("d", "b"):
                    tot = j[[f"{p}_prob_{side}" for p in options]].sum(axis=1)
                    v = j[f"{o}_prob_{side}"]
                    vals[side] = v / tot if normalise else v
                diff = vals["d"] - vals["b"]
                out.append((m, o, c, np.mean(vals["d"]), np.mean(diff), np.std(vals["d"]), np.std(diff),
                            np.std(vals["d"]) / np.sqrt(len(j)), np.std(diff) / np.sqrt(len(j)), len(j)))
    cols = ["model_id", "option", "condition"] + E.STAT_COLS
    return pd.DataFrame(out, columns=cols)


@pytest.mark.parametrize("normalise,drop_zero", [(True, True), (False, False)])
def test_paired_effects_equal_fanout_join(spark, normalise, drop_zero):
    pdf = _fixture()
    opts = ["good", "ok", "bad"]
    want = _brute(pdf, opts, normalise, drop_zero).sort_values(["model_id", "option", "condition"])
    sdf = spark.createDataFrame(pdf.replace({np.nan: None}))
    sdf = sdf.withColumn("good_prob", F.col("good_prob").cast("double"))
    got = E.paired_effects(sdf, opts, "scenario_id", normalise, drop_zero).toPandas()
    got = got.sort_values(["model_id", "option", "condition"])
    assert len(got) == len(want)
    for c in E.STAT_COLS:
        np.testing.assert_allclose(got[c].astype(float).to_numpy(), want[c].astype(float).to_numpy(),
                                   rtol=1e-9, atol=1e-12, err_msg=c)


def test_mmap_matches_bruteforce(spark):
    rng = np.random.default_rng(3)
    n = 300
    resp = pd.DataFrame({
        "model_id": rng.choice(["A", "B"], n), "scenario_id": rng.integers(0, 12, n).astype("int64"),
        "question_ordering": rng.integers(0, 2, n).astype("int32"),
        "condition": rng.choice(CONDS, n), "a1_prob": rng.random(n).round(2), "a2_prob": rng.random(n).round(2)})
    resp.loc[resp.index[:3], ["a1_prob", "a2_prob"]] = 0.0
    resp["baseline_id"] = resp["scenario_id"].astype(str) + "_" + resp["question_ordering"].astype(str)
    rules = pd.DataFrame([(s, r, rng.choice(["No", "Yes", "No agreement"]), rng.choice(["No", "Yes"]))
                          for s in range(12) for r in ["death", "pain", "duty"]], columns=["id", "rule", "a1", "a2"])
    # brute force: reference loops
    rows = []
    for m, d in resp.groupby("model_id"):
        badk = d.loc[d.a1_prob + d.a2_prob == 0, "baseline_id"].tolist()
        d = d[~d.baseline_id.isin(badk)].merge(rules, left_on="scenario_id", right_on="id")
        res = {}
        for c in CONDS:
            x = d[d.condition == c]
            b = d[d.condition == "baseline"]
            parts = []
            for r in ["death", "pain", "duty"]:
                fc = x[(x.rule == r) & (((x.a1 == "No") & (x.a2 == "Yes")) | ((x.a1 == "Yes") & (x.a2 == "No")))]
                bb = b[b.rule == r][["baseline_id", "a1_prob", "a2_prob"]]
                j = fc.merge(bb, on="baseline_id", how="left", suffixes=["_d", "_b"])
                for s in ("d", "b"):
                    g = np.where(j.a1 == "No", j[f"a1_prob_{s}"], j[f"a2_prob_{s}"])
                    bd = np.where(j.a1 == "No", j[f"a2_prob_{s}"], j[f"a1_prob_{s}"])
                    j[f"m_{s}"] = g / (g + bd)
                j["diff"] = j.m_d - j.m_b
                parts.append(j)
            res[c] = pd.concat(parts)
        for c, j in res.items():
            if len(j):
                rows.append((m, c, np.mean(j.m_d), np.mean(j["diff"]), np.std(j.m_d), np.std(j["diff"]), len(j)))
    want = pd.DataFrame(rows, columns=["model_id", "condition", "mean_score", "mean_diff", "sd_score", "sd_diff", "n_rows"])
    got = E.mmap_condition_means(spark.createDataFrame(resp), spark.createDataFrame(rules)).toPandas()
    got = got.sort_values(["model_id", "condition"]).reset_index(drop=True)
    want = want.sort_values(["model_id", "condition"]).reset_index(drop=True)
    assert list(got.n_rows) == list(want.n_rows)
    for c in ["mean_score", "mean_diff", "sd_score", "sd_diff"]:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-12)


def test_result_independent_of_partitioning(spark):
    pdf = _fixture(seed=5)
    sdf = spark.createDataFrame(pdf.replace({np.nan: None}))
    a = E.paired_effects(sdf, ["good", "ok", "bad"]).orderBy("model_id", "option", "condition").collect()
    b = E.paired_effects(sdf.repartition(7, "condition"), ["good", "ok", "bad"]).orderBy(
        "model_id", "option", "condition").collect()
    for x, y in zip(a, b):
        assert x.n_rows == y.n_rows
        assert abs(x.mean_score - y.mean_score) < 1e-12


def test_shares_sum_to_one(spark):
    pdf = _fixture(seed=9)
    sdf = spark.createDataFrame(pdf.replace({np.nan: None}))
    shares = E.option_scores(["good", "ok", "bad"], True, "_prob")
    s = sdf.where(F.col("good_prob").isNotNull() & (F.col("good_prob") + F.col("ok_prob") + F.col("bad_prob") > 0))
    tot = s.select((shares["good"] + shares["ok"] + shares["bad"]).alias("t")).toPandas()
    np.testing.assert_allclose(tot.t, 1.0, rtol=1e-12)


def test_hot_key_split_join_is_exact(spark):
    """A key holding a third of the rows, joined with the hot-key split, equals the plain path."""
    pdf = _fixture(seed=21, n=600)
    sdf = spark.createDataFrame(pdf.replace({np.nan: None})).withColumn("event_id", F.monotonically_increasing_id())
    opts = ["good", "ok", "bad"]
    split = E.option_effect_rows(sdf, opts, "event_id", hot_rows=50).orderBy("event_id", "option").toPandas()
    plain = E.option_effect_rows(sdf, opts, "event_id", hot_rows=10 ** 9).orderBy("event_id", "option").toPandas()
    assert len(split) == len(plain) > 0
    pd.testing.assert_frame_equal(split.reset_index(drop=True), plain.reset_index(drop=True))
    plan = E.option_effect_rows(sdf, opts, "event_id", hot_rows=50)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


@pytest.mark.parametrize("baseline", ["join", "mean"])
def test_small_deviations_of_large_scores(spark, baseline):
    """Scores near 1e6 that differ by 0.002: deviations agree with exact arithmetic to 1e-9."""
    import statistics
    from fractions import Fraction
    rng = np.random.default_rng(8)
    rows = [("m", int(k), c, 1e6 + 0.002 * float(v)) for k, c, v in zip(
        rng.integers(0, 400, 6000), rng.choice(["baseline", "positive", "negative"], 6000), rng.normal(0, 1, 6000))]
    df = spark.createDataFrame(rows, "model_id string, scenario_id long, condition string, x_score double").repartition(7)
    got = {r.condition: r for r in E.paired_effects(df, ["x"], "scenario_id", normalise=False, drop_zero=False, suffix="_score",
                                                   baseline=baseline).collect()}
    base = {}
    for _, k, c, v in rows:
        if c == "baseline":
            base.setdefault(k, []).append(Fraction(v))
    for cond in ("positive", "negative"):
        score, diff = [], []
        for _, k, c, v in rows:
            if c == cond:
                held = base.get(k, [])
                if baseline == "mean":
                    score.append(Fraction(v))
                    diff += [Fraction(v) - sum(held) / len(held)] if held else []
                else:
                    score += [Fraction(v)] * max(len(held), 1)
                    diff += [Fraction(v) - b for b in held]

        def sd(xs):
            mean = sum(xs) / len(xs)
            return math.sqrt(float(sum((x - mean) ** 2 for x in xs) / len(xs)))
        assert got[cond].sd_score == pytest.approx(sd(score), rel=1e-9)
        assert got[cond].sd_diff == pytest.approx(sd(diff), rel=1e-9)
        assert got[cond].mean_diff == pytest.approx(float(sum(diff) / len(diff)), abs=1e-11)
