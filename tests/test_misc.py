"""Smaller operators: answer slicing, quality flags, CSV head, stats sink, P10 symmetry,
plan shape of the design product, dataset specs and report assembly."""

import os

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from armature.functions import text as TX
from armature.operators import design as DS
from armature.operators import report as RP
from armature.operators import scoring as SC
from armature.operators.spec import spec
from armature.schemas import MORALCHOICE_SCENARIO
from armature.sinks import writers as W
from armature.sources import files as FS


def test_answer_after_prompt_and_quality_flag(spark):
    df = spark.createDataFrame([("Q? A: yes", "Q? A:"), ("ok�", "")], "raw string, prompt string")
    got = df.select(TX.answer_after_prompt(F.col("raw"), F.col("prompt")).alias("a"),
                    TX.has_replacement_char(F.col("raw")).alias("bad")).collect()
    assert [(r.a, r.bad) for r in got] == [(" yes", False), ("ok�", True)]


def test_csv_head_by_file_order_and_multiline(spark, tmp_dir):
    rows = [{"id": f"s{i}", "context": f"line one\nline two {i}", "action1": "a", "action2": "b"} for i in range(5)]
    p = os.path.join(tmp_dir, "mc.csv")
    pd.DataFrame(rows).to_csv(p, index=False)
    schema = T.StructType(MORALCHOICE_SCENARIO.fields[:4])       # the columns this file has
    head = FS.read_scenarios_csv(spark, p, schema, max_rows=3).collect()
    assert [r.id for r in head] == ["s0", "s1", "s2"] and head[0].context == "line one\nline two 0"
    assert FS.read_scenarios_csv(spark, p, schema).count() == 5


def test_stats_sink_keeps_full_precision_and_rounds_the_text(spark, tmp_dir):
    out = os.path.join(tmp_dir, "stats")
    W.write_stats(spark.createDataFrame([("m", 3.9e-21)], "model string, p double"), out)
    assert float(spark.read.option("header", True).csv(out).first().p) == 3.9e-21
    assert float(spark.read.option("header", True).option("sep", "\t").csv(out + "_text").first().p) == 0.0


def test_answer_to_action_swaps_with_ordering(spark):
    df = spark.createDataFrame([(0, 0.7, 0.2), (1, 0.7, 0.2)], "question_ordering int, p_first double, p_second double")
    got = SC.answer_to_action(df).orderBy("question_ordering").collect()
    assert (got[0].a1_prob, got[0].a2_prob) == (0.7, 0.2)
    assert (got[1].a1_prob, got[1].a2_prob) == (0.2, 0.7)


def test_design_plan_has_no_cartesian(spark):
    s = spark.range(100).select(F.col("id").alias("scenario_id"))
    d = spark.range(1, 9).select(F.col("id"), F.lit("text").alias("modality"), F.lit("p").alias("file_path"))
    plan = DS.design(s, d, ["ab"])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert DS.design(s, d, ["ab"]).count() == 100 * 9


def test_dataset_spec_render_and_score(spark):
    mc = spec("moralchoice_high_ambiguity")
    rows = spark.createDataFrame([("s1", "Ctx", "go", "stay", None, None, None, 1)],
                                 "scenario_id string, context string, action1 string, action2 string, "
                                 "distractor_id long, distractor_modality string, distractor_text string, "
                                 "question_ordering int")
    prompts = mc.render(rows).collect()
    assert prompts[0].prompt_id == "s1_none_1_ab" and "\nA. stay \nB. go" in prompts[0].user_prompt
    resp = spark.createDataFrame([(1, [[("A", -0.5), (" A", -1.0)]])],
                                 "question_ordering int, positions array<array<struct<token:string,logprob:double>>>")
    scored = mc.score(resp).first()
    # A (first label) names action 2 when the ordering is 1
    # and both its spellings count: "A" and " A", one token each
    assert abs(scored.a2_prob - (2.718281828459045 ** -0.5 + 2.718281828459045 ** -1)) < 1e-12 and scored.a1_prob == 0.0
    try:
        spec("unknown")
        raise AssertionError("expected KeyError")
    except KeyError:
        pass


def test_latex_table_and_union(spark):
    rows = spark.createDataFrame([("m1", "m1 & 1.00\\% \\\\")], "model_id string, latex_row string")
    t = RP.latex_table(rows, ["Model", "Baseline"], "cap", "tab:x")
    assert t.splitlines()[3] == "\\begin{tabular}{lc}" and "m1 & 1.00\\% \\\\" in t
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    b = spark.createDataFrame([(2, 0.5)], "a int, c double")
    u = FS.union_results([a, b]).orderBy("a").collect()
    assert u[0].c is None and u[1].b is None


def test_workflows_end_to_end(spark):
    import json

    from armature.plans import workflows as WF
    from armature.sources import tables as V
    sf = "/root/testdata/sf0.001"
    scen = V.scenarios(spark, sf).select(F.col("id").alias("scenario_id"), "context", "action1", "action2").limit(5)
    dist = V.distractors(spark, sf).limit(3)
    texts = spark.createDataFrame([("asset/1", "A storm.")], "file_path string, body string")
    req = WF.evaluation_requests(scen, dist, texts, "moralchoice_high_ambiguity", "m-x")
    lines = [json.loads(r.line) for r in req.collect()]
    assert len(lines) == 5 * (1 + 3) * 2 and lines[0]["body"]["temperature"] == 1.0
    out = WF.moralchoice_analysis(V.responses(spark, sf), V.distractors(spark, sf), V.scenario_rules(spark, sf))
    assert out["means"].count() > 0 and out["report_rows"].count() == out["means"].select("model_id").distinct().count()
    t = out["tests"].collect()
    assert t and all(0 <= r.p_adj <= 1 for r in t if r.p_adj is not None)


def test_result_store_read_filters_and_csv_round_trip(spark, tmp_dir):
    from armature.schemas import RESULTS_MORALCHOICE
    rows = spark.createDataFrame(
        [("e", "d", "m", "ab", "s1", None, None, "ok"), ("e", "d", "m", "ab", "s1", "7", "text", "ok"),
         ("e", "d", "m", "ab", "s1", "9", "image", "ok")],
        "experiment string, dataset string, model_id string, question_format string, scenario_id string, "
        "distractor_id string, distractor_modality string, status string")
    store = os.path.join(tmp_dir, "store")
    W.append_results(rows, store, keys=("model_id", "question_format", "scenario_id", "distractor_id"))
    ids = lambda df: sorted(str(r.distractor_id) for r in df.collect())
    assert ids(FS.read_results(spark, store, "text")) == ["7", "None"]          # Q6: baseline kept
    assert ids(FS.read_results(spark, store, "text", include_baseline=False)) == ["7"]
    assert ids(FS.read_results(spark, store, "all", include_baseline=False)) == ["7", "9"]
    # K6 write + S9 typed read
    res = spark.createDataFrame([("m", "ab", 0, "s", "u", "top_p", 1.0, 1.0, "s1", None, "raw", "A", 0.6, 0.4)],
                                RESULTS_MORALCHOICE)
    out = os.path.join(tmp_dir, "res_csv")
    W.write_table_csv(res, out)
    back = FS.read_result_csv(spark, out, RESULTS_MORALCHOICE).first()
    assert back.a1_prob == 0.6 and back.question_ordering == 0 and back.distractor_id is None


def test_scenario_loader_dispatch(spark, tmp_dir):
    import pytest
    p = os.path.join(tmp_dir, "r.csv")
    pd.DataFrame({"submission_id": ["a"], "selftext": [" t "]}).to_csv(p, index=False)
    assert [(r.id, r.selftext) for r in FS.load_scenarios(spark, "reddit", p).collect()] == [("a", "t")]
    with pytest.raises(KeyError):
        FS.load_scenarios(spark, "nope", p)
    with pytest.raises(ValueError):
        FS.load_scenarios(spark, "normbank", p)


def test_registry_dimensions(spark):
    from armature.sources import registry as RG
    assert RG.templates_df(spark).count() == 6
    v = RG.variants_df(spark)
    assert v.select("label").distinct().count() == 12
    assert v.where("label = 'YES'").count() == 14 and v.where("label = 'GOOD'").count() == 8
    assert RG.models_df(spark).count() == 19
    d = {r.dataset: r for r in RG.datasets_df(spark).collect()}
    assert d["reddit"].default_temperature == 0.2 and d["moralchoice_low_ambiguity"].formats == ["ab"]
    assert RG.sampling_defaults("normbank", top_p=0.5) == (0.2, 0.5)
    sys_prompt, pieces = RG.template_parts("compare_moralchoice")
    assert len(pieces) == 4 and sys_prompt.endswith("\n\n")


def test_global_positions_across_partitions(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = FS.global_positions(df, ["k"], "pos", partitions=7).collect()
    assert sorted((r.k, r.pos) for r in got) == [(i, i) for i in range(1000)]


def test_timestamp_stamp_format(spark):
    import re
    stamp = spark.range(1).select(TX.timestamp_now().alias("t")).first().t
    assert re.fullmatch(r"\d{4}-\d{2}-\d{2}_\d{2}:\d{2}:\d{2}", stamp)
