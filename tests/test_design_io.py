"""Design, resumption, batch round trip, file readers, sinks and streaming."""

import json
import os

import pandas as pd
from pyspark.sql import functions as F

from armature.operators import batch as BT
from armature.operators import design as DS
from armature.operators import hooks as HK
from armature.operators import render as RD
from armature.sinks import writers as W
from armature.sources import files as FS
from armature.sources.registry import sampling_defaults


def stub_model():
    """Deterministic stand-in: answers a verdict chosen from the prompt length."""
    labels = ["YTA", "NTA", "ESH", "NAH", "INFO"]

    def model(b):
        return pd.DataFrame({"answer_raw": [f" Verdict: {labels[len(p) % 5]}\nReasoning: length {len(p)}. " for p in b["user_prompt"].fillna("")]})
    return model


def zero_scorer():
    """Stand-in classifier returning zeros."""
    return lambda texts: [None if t is None else dict.fromkeys(HK.FOUNDATION_CODES, 0.0) for t in texts]



def _scen(spark):
    return spark.createDataFrame([("s1", "Ctx one", "act A", "act B"), ("s 2", "Ctx two", "x", "y")],
                                 "scenario_id string, context string, action1 string, action2 string")


def _dist(spark):
    return spark.createDataFrame([(1, "positive", "t/a.txt", "text"), (2, "negative", "i/b.png", "image")],
                                 "id long, sentiment string, file_path string, modality string")


def test_design_counts_and_pending_idempotent(spark, tmp_dir):
    d = DS.design(_scen(spark), _dist(spark), ["ab"])
    assert d.count() == 2 * (1 + 2)
    assert d.where(F.col("distractor_id").isNull()).count() == 2
    rows = DS.expand_models(d, ["m1"]).withColumn("status", F.lit("ok"))
    store = os.path.join(tmp_dir, "results")
    first = W.append_results(rows, store, keys=("model_id", "scenario_id", "distractor_id"))
    assert first.count() == 6
    again = W.append_results(rows, store, keys=("model_id", "scenario_id", "distractor_id"))
    assert again.count() == 0                                  # nothing pending the second time
    assert spark.read.parquet(store).count() == 6
    pend = DS.pending(rows.select("model_id", "scenario_id", "distractor_id"),
                      spark.read.parquet(store).where(F.col("distractor_id").isNull()),
                      keys=("model_id", "scenario_id", "distractor_id"))
    assert pend.count() == 4                                   # null-safe: baselines matched


def test_prompt_ids_orderings_and_render(spark):
    s = _scen(spark)
    o = DS.option_orderings(s.withColumnRenamed("scenario_id", "id")).orderBy("id", "question_ordering").collect()
    assert (o[0].option_a, o[0].option_b, o[1].option_a) == ("x", "y", "y")
    rows = DS.design(s, _dist(spark), ["ab"]).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("question_ordering"))
    texts = spark.createDataFrame([("t/a.txt", " Storm came. \n")], "file_path string, body string")
    r = RD.render_choice(RD.attach_distractor_text(rows, texts)).where("scenario_id = 's1'")
    got = {x.prompt_id: x.user_prompt for x in r.collect()}
    assert got["s1_none_0_ab"].startswith("Question: Ctx one Which of the following")
    assert "Storm came. Later, ctx one" in got["s1_1_1_ab"] and "\nA. act B \nB. act A" in got["s1_1_1_ab"]
    assert got["s1_2_0_ab"].startswith("Question: You see the scene in the image. Ctx one")
    key = spark.createDataFrame([("s 2", None)], "a string, b long").select(
        DS.result_file_key(F.col("a"), F.col("b"))).first()[0]
    assert key == "s_s_2_d_none"


def test_eligibility(spark):
    rows = spark.createDataFrame([("m1", 2, "image"), ("m2", 2, "image"), ("m1", None, None)],
                                 "model_id string, distractor_id long, distractor_modality string")
    cap = spark.createDataFrame([("m1", False), ("m2", True)], "model_id string, accepts_images boolean")
    got = {(r.model_id, r.distractor_id): r.status for r in DS.eligibility(rows, cap).collect()}
    assert got == {("m1", 2): "ineligible", ("m2", 2): "eligible", ("m1", None): "eligible"}


def test_batch_request_and_response_round_trip(spark, tmp_dir):
    prompts = spark.createDataFrame([("p1", "sys", "user one"), ("p2", "sys", "user two")],
                                    "prompt_id string, system_prompt string, user_prompt string")
    t, p = sampling_defaults("normbank")
    req = BT.batch_requests(prompts, "gpt-4.1", 200, t, p)
    out = os.path.join(tmp_dir, "batch")
    BT.write_requests(req, out)
    lines = [json.loads(r.value) for r in spark.read.text(out).collect()]
    assert {x["custom_id"] for x in lines} == {"p1", "p2"}
    assert lines[0]["body"]["top_logprobs"] == 20 and lines[0]["body"]["temperature"] == 0.2
    # response file: p1 twice (the later line wins), p2 missing
    resp = os.path.join(tmp_dir, "resp")
    os.makedirs(resp)

    def line(cid, content):
        pos = [{"token": "Verdict:", "logprob": -0.1, "top_logprobs": [{"token": "Verdict:", "logprob": -0.1}]},
               {"token": " NTA", "logprob": -0.2, "top_logprobs": [{"token": " NTA", "logprob": -0.2},
                                                                   {"token": "YTA", "logprob": -2.0}]}]
        return json.dumps({"custom_id": cid, "response": {"status_code": 200, "body": {"choices": [
            {"message": {"content": content}, "logprobs": {"content": pos}}]}}})
    with open(os.path.join(resp, "out.jsonl"), "w") as f:
        f.write(line("p1", "old") + "\n" + line("p1", " Verdict: NTA\nReasoning: new ") + "\n")
    r = BT.keep_last(BT.read_responses(spark, resp))
    j = BT.join_responses(prompts, r.select("custom_id", "content", "positions")).orderBy("prompt_id").collect()
    assert [x.status for x in j] == ["ok", "missing"]
    assert j[0].content.strip() == "Verdict: NTA\nReasoning: new"
    from armature.functions import probability as PR
    pr = r.select(PR.chain_prob("positions", "Verdict: NTA").alias("p")).first().p
    assert abs(pr - pow(2.718281828459045, -0.3)) < 1e-12


def test_file_readers(spark, tmp_dir):
    d = os.path.join(tmp_dir, "csv")
    os.makedirs(d)
    pd.DataFrame({"submission_id": ["a", "b", None, "d"], "selftext": [" x ", None, "  ", "yz"],
                  "other": [1, 2, 3, 4]}).to_csv(os.path.join(d, "r.csv"), index=False)
    red = FS.read_reddit_scenarios(spark, d, max_rows=3).orderBy("id").collect()
    assert [(r.id, r.selftext) for r in red] == [("a", "x")]          # limit before the blank filter
    idx = FS.with_file_row_index(spark.read.option("header", True).csv(d)).orderBy("row_no").collect()
    assert [r.row_no for r in idx] == [0, 1, 2, 3] and idx[3].submission_id == "d"
    dist = os.path.join(tmp_dir, "d.csv")
    pd.DataFrame({"id": ["txt_pos_1", "img_neg_1"], "sentiment": ["positive", "negative"],
                  "file_path": ["a", "a"], "modality": ["text", "image"]}).to_csv(dist, index=False)
    assert FS.load_distractors(spark, dist, "none") is None
    assert FS.load_distractors(spark, dist, "text").count() == 1
    assert FS.duplicate_paths(FS.load_distractors(spark, dist, "all")).first().n_refs == 2
    root = os.path.join(tmp_dir, "assets")
    for m, s_, f in [("text", "positive", "a.txt"), ("image", "negative", "b.png")]:
        os.makedirs(os.path.join(root, m, s_), exist_ok=True)
        with open(os.path.join(root, m, s_, f), "w") as fh:
            fh.write("body " + f)
    reg = FS.registry_from_directory(spark, root).orderBy("id").collect()
    assert [(r.id, r.modality, r.sentiment, r.file_path) for r in reg] == [
        (0, "image", "negative", "b.png"), (1, "text", "positive", "a.txt")]
    bodies = {r.file_path: r.body for r in FS.read_distractor_texts(spark, root).collect()}
    assert bodies["text/positive/a.txt"] == "body a.txt"


def test_multi_csv_and_model_csv_sink(spark, tmp_dir):
    d = os.path.join(tmp_dir, "runs")
    os.makedirs(d)
    for i, m in enumerate(["org/model-a", "org/sub/model-b"]):
        pd.DataFrame({"Unnamed: 0": [0, 1], "model_id": [m, m], "distractor_id": ["txt_neg_3", None],
                      "ch_score": ["0.5", "bad"], "fc_score": [0.1, 0.2], "lb_score": [0.1, 0.2],
                      "as_score": [0.1, 0.2], "pd_score": [0.1, 0.2]}).to_csv(os.path.join(d, f"f{i}.csv"), index=False)
    df = FS.read_model_csvs(spark, d)
    assert "Unnamed: 0" not in df.columns
    got = sorted((r.distractor_type, r.ch_score) for r in df.collect())
    assert got == [("baseline", None), ("baseline", None), ("neg", 0.5), ("neg", 0.5)]
    out = os.path.join(tmp_dir, "per_model")
    W.write_per_model_csv(df.drop("source_file"), out)
    assert {x for x in os.listdir(out) if x.startswith("model_dir=")} == {"model_dir=org_model-a",
                                                                          "model_dir=org_model-b"}


def test_hooks_and_incremental_collection(spark, tmp_dir):
    prompts = spark.createDataFrame([("p1", "s", "abc"), ("p2", "s", "abcd")],
                                    "prompt_id string, system_prompt string, user_prompt string")
    ans = {r.prompt_id: r.answer for r in HK.respond(prompts, stub_model).collect()}
    assert ans["p1"].startswith("Verdict: ")
    sc = HK.score_texts(spark.createDataFrame([("a", "txt"), ("b", None)], "k string, t string"), "t",
                        zero_scorer, ["k"]).orderBy("k").collect()
    assert sc[0].ch_score == 0.0 and sc[1].ch_score is None
    from armature.streaming.incremental import collect_responses, collected
    src = os.path.join(tmp_dir, "incoming")
    os.makedirs(src)
    rec = {"custom_id": "c1", "response": {"body": {"choices": [{"message": {"content": "hi"}}]}}}
    with open(os.path.join(src, "a.jsonl"), "w") as f:
        f.write(json.dumps(rec) + "\n")
    store, ck = os.path.join(tmp_dir, "store"), os.path.join(tmp_dir, "ck")
    collect_responses(spark, src, store, ck).awaitTermination(120)
    rec["response"]["body"]["choices"][0]["message"]["content"] = "later"
    with open(os.path.join(src, "b.jsonl"), "w") as f:
        f.write(json.dumps(rec) + "\n" + json.dumps({**rec, "custom_id": "c2"}) + "\n")
    collect_responses(spark, src, store, ck).awaitTermination(120)
    got = sorted((r.custom_id, r.content) for r in collected(spark, store).collect())
    assert got == [("c1", "later"), ("c2", "later")]            # c1 once, its later line
