"""Inputs in the experiment's own shapes: keys, header order, string ids, NaN, unmatched arms."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from armature.functions import probability as PR
from armature.functions import stats as S
from armature.operators import design as DS
from armature.operators import hooks as HK
from armature.operators import report as RP
from armature.operators import shares as SH
from armature.operators import significance as SG
from armature.sinks import writers as W
from armature.sources import files as FS

KEYS = ("experiment string, dataset string, model_id string, question_format string, scenario_id string, "
        "distractor_id string, question_ordering int, status string")


def _row(e, o, status):
    return (e, "d", "m", "ab", "s1", None, o, status)


def test_resume_keeps_other_experiments_and_retries_failures(spark, tmp_dir):
    store = os.path.join(tmp_dir, "store")
    W.append_results(spark.createDataFrame([_row("e1", 0, "ok"), _row("e1", 1, "failed")], KEYS), store)
    again = spark.createDataFrame([_row("e1", 0, "ok"), _row("e1", 1, "ok"), _row("e1", 1, "failed"),
                                   _row("e2", 0, "ok"), _row("e2", 1, "ok")], KEYS)
    W.append_results(again, store)
    got = sorted((r.experiment, r.question_ordering, r.status) for r in spark.read.parquet(store).collect())
    assert got == [("e1", 0, "ok"), ("e1", 1, "failed"), ("e1", 1, "ok"), ("e2", 0, "ok"), ("e2", 1, "ok")]


def test_pending_keys_follow_the_columns(spark):
    d = spark.createDataFrame([_row("e2", 0, "ok")], KEYS)
    done = spark.createDataFrame([_row("e1", 0, "ok")], KEYS)
    assert DS.pending(d, done).count() == 1 and DS.pending(d, d).count() == 0


def test_string_registry_ids(spark):
    scen = spark.createDataFrame([("s1", "c")], "scenario_id string, context string")
    dist = spark.createDataFrame([("img_pos_1", "image", "f")], "id string, modality string, file_path string")
    got = {r.distractor_id for r in DS.design(scen, dist, ["ab"]).collect()}
    assert got == {None, "img_pos_1"}


def test_readers_go_by_header_name(spark, tmp_dir):
    schema = T.StructType([T.StructField("model_id", T.StringType()), T.StructField("a1_prob", T.DoubleType())])
    p = os.path.join(tmp_dir, "r.csv")
    pd.DataFrame({"a1_prob": [0.6], "model_id": ["m"]}).to_csv(p)                 # index column, other order
    assert tuple(FS.read_result_csv(spark, p, schema).first()) == ("m", 0.6)
    assert tuple(FS.read_scenarios_csv(spark, "file://" + p, schema).first()) == ("m", 0.6)
    with pytest.raises(ValueError):
        FS.read_result_csv(spark, p, T.StructType([T.StructField("nope", T.StringType())]))


def test_model_csvs_with_different_headers_and_uri(spark, tmp_dir):
    d = os.path.join(tmp_dir, "runs")
    os.makedirs(d)
    a = {"model_id": ["a"], "distractor_id": ["txt_neg_3"], "ch_score": ["0.5"], "fc_score": ["NaN"]}
    pd.DataFrame(a).to_csv(os.path.join(d, "a.csv"), index=False)
    pd.DataFrame({k: ["b" if k == "model_id" else a[k][0]] for k in reversed(a)}).to_csv(os.path.join(d, "b.csv"))
    got = sorted((r.model, r.distractor_type, r.ch_score, r.fc_score) for r in FS.read_model_csvs(spark, "file://" + d).collect())
    assert got == [("a", "neg", 0.5, None), ("b", "neg", 0.5, None)]
    with pytest.raises(FileNotFoundError):
        FS.read_model_csvs(spark, os.path.join(tmp_dir, "none"))


def test_nan_is_no_score_and_no_p(spark):
    cols = ["ch_score", "fc_score", "lb_score", "as_score", "pd_score"]
    df = spark.createDataFrame([("m", float("nan"), 0.2, 0.1, None, 0.0), ("m", 0.4, 0.0, 0.0, 0.0, 0.0)],
                               "model string, " + ", ".join(f"{c} double" for c in cols))
    tops = [r[0] for r in df.select(SH.top_foundation(cols)).collect()]
    assert tops[0] == SH.FOUNDATION_LABELS["fc_score"] and tops[1] == SH.FOUNDATION_LABELS["ch_score"]
    assert SH.mean_scores(df, ["model"]).first().ch_score == 0.4
    p = spark.createDataFrame([(1, 0.01), (2, float("nan")), (3, None), (4, 0.04)], "i int, p double")
    for adjust, first in ((S.holm, 0.02), (S.holm_sidak, 1 - 0.99 ** 2)):
        got = {r.i: r.p_adj for r in adjust(p).collect()}
        assert got[2] is None and got[3] is None
        assert abs(got[1] - first) < 1e-12 and abs(got[4] - 0.04) < 1e-12


def test_unmatched_arms_stay_out_of_chi_square(spark):
    rows = [("m", t, v) for t, n in (("neg", 30), ("pos", 20)) for v in (["NTA"] * n + ["YTA"] * (50 - n))]
    schema = "model_id string, distractor_type string, verdict string"
    plain = SG.chi_square_tests(spark.createDataFrame(rows, schema)).first()
    more = SG.chi_square_tests(spark.createDataFrame(rows + [("m", None, "NTA")] * 40, schema)).first()
    assert tuple(plain) == tuple(more)


def test_hook_keeps_missing_answers(spark):
    prompts = spark.createDataFrame([("p1", "s", "u"), ("p2", "s", None)], "prompt_id string, system_prompt string, user_prompt string")
    make = lambda: lambda b: pd.DataFrame({"answer_raw": [None if pd.isna(u) else " x " for u in b["user_prompt"]]})
    got = {r.prompt_id: (r.answer_raw, r.answer, r.status) for r in HK.respond(prompts, make).collect()}
    assert got == {"p1": (" x ", "x", "ok"), "p2": (None, None, "failed")}


def test_own_token_sequences(spark):
    pos = [[("Ver", -0.1)], [("dict:", -0.2)], [(" N", -0.3)], [("TA", -0.4)]]
    df = spark.createDataFrame([(pos,)], "positions array<array<struct<token:string,logprob:double>>>")
    variants = spark.createDataFrame([("NTA", ["Ver", "dict:", " N", "TA"]), ("NTA", ["Ver"]), ("YTA", ["No"])], "label string, token_seq array<string>")
    r = PR.answer_probs(df, "positions", ["NTA", "YTA"], variants=variants).first()
    e = 2.718281828459045
    assert abs(r.nta_prob - (e ** -1.0 + e ** -0.1)) < 1e-12 and r.yta_prob == 0.0


def test_softmax_is_stable_in_one_pass(spark):
    df = spark.createDataFrame([([1000.0, 1001.0, -1e9],)], "v array<double>")
    got = df.select(F.expr(PR.softmax_logprob_sql("v", "2")).alias("p")).first().p
    assert abs(got + 0.31326168751822286) < 1e-12


def test_p_value_rows(spark):
    t = spark.createDataFrame([("m", "a-b", 0.0183), ("m", "a-c", None)], "model_id string, pair string, p_adj double")
    assert RP.p_value_rows(t, ["a-b", "a-c", "b-c"]).first().latex_row == "m & $1.83e-02$ & - & - \\\\"
