"""Callables are called once per distinct input, and a head of files opens few of them."""

import os

import pandas as pd

from armature.operators import hooks as HK
from armature.sources import files as FS
from pyspark.sql import types as T


def _counting_scorer(log):
    def make():
        def score(texts):
            with open(log, "a") as f:
                f.writelines(t + "\n" for t in texts)
            return [dict(zip(HK.FOUNDATION_CODES, [len(t) / 10, 0.0, None, 1.0, 2.0])) for t in texts]
        return score
    return make


def test_repeated_reasoning_is_scored_once(spark, tmp_dir):
    log, memo = os.path.join(tmp_dir, "log"), os.path.join(tmp_dir, "memo")
    rows = [(i, 7 * i, f"text {i % 5}" if i % 11 else None) for i in range(200)] + [(500, 1, "")]
    df = spark.createDataFrame(rows, "id long, text long, reasoning string").repartition(6)
    got = {r.id: r for r in HK.score_texts(df, "reasoning", _counting_scorer(log), ["id", "text"], memo).collect()}
    assert sorted(open(log).read().split("\n")[:-1]) == ["", "text 0", "text 1", "text 2", "text 3", "text 4"]
    assert len(got) == 201 and got[0].ch_score is None and got[1].ch_score == 0.6 and got[500].ch_score == 0.0
    assert got[3].text == 21 and got[3].lb_score is None and got[3].pd_score == 2.0
    more = df.unionByName(spark.createDataFrame([(900, 0, "new one"), (901, 0, "text 1")], df.schema))
    again = HK.score_texts(more, "reasoning", _counting_scorer(log), ["id"], memo)
    assert {r.id: r.ch_score for r in again.collect()}[901] == 0.6
    assert open(log).read().count("text 1\n") == 1 and open(log).read().count("new one\n") == 1


def test_sampling_and_status_are_carried_and_failures_asked_again(spark, tmp_dir):
    log, memo = os.path.join(tmp_dir, "log"), os.path.join(tmp_dir, "memo")
    prompts = spark.createDataFrame([("p1", "s", "good"), ("p2", "s", "good"), ("p3", "s", "bad"), ("p4", None, "good")],
                                    "prompt_id string, system_prompt string, user_prompt string")

    def make(temperature, top_p, max_tokens):
        def model(b):
            with open(log, "a") as f:
                f.writelines(f"{u} {temperature}\n" for u in b["user_prompt"])
            return pd.DataFrame({"answer_raw": [None if u == "bad" else f" {u} at {temperature} of {max_tokens} " for u in b["user_prompt"]]})
        return model
    run = lambda t: {r.prompt_id: r for r in HK.respond(prompts, make, memo=memo, temperature=t, top_p=1.0, max_tokens=9).collect()}
    got = run(0.2)
    assert got["p1"].answer == got["p2"].answer == "good at 0.2 of 9" and got["p1"].temperature == 0.2 and got["p1"].max_tokens == 9
    assert got["p3"].status == "failed" and got["p3"].answer is None
    run(0.2)
    run(0.7)
    calls = open(log).read().split("\n")[:-1]
    assert calls.count("good 0.2") == 2 and calls.count("bad 0.2") == 2 and calls.count("good 0.7") == 2
    plain = HK.respond(prompts, make, temperature=0.1, top_p=1.0, max_tokens=9).collect()
    assert len(plain) == 4 and open(log).read().count("good 0.1\n") == 3


def test_head_of_many_files_opens_few(spark, tmp_dir):
    folder = os.path.join(tmp_dir, "csv")
    os.makedirs(folder)
    for i in range(60):
        pd.DataFrame({"b": [f"t {10 * i + j}" for j in range(10)], "a": range(10 * i, 10 * i + 10)}).to_csv(
            os.path.join(folder, f"f{i:03d}.csv"), index=False)
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    opened = FS.first_files(spark, folder, 25)
    assert [os.path.basename(p) for p in opened] == ["f000.csv", "f001.csv", "f002.csv"]
    got = FS.read_scenarios_csv(spark, folder, schema, max_rows=25)
    assert sorted(r.a for r in got.collect()) == list(range(25))
    assert FS.read_scenarios_csv(spark, folder, schema).count() == 600
    assert FS.read_scenarios_csv(spark, folder, schema, max_rows=10_000).count() == 600
    texts = FS.read_reddit_scenarios(spark, folder, max_rows=12, id_col="a", text_col="b")
    assert {r.id for r in texts.collect()} == {str(i) for i in range(12)}


def test_a_fresh_checkpoint_keeps_what_the_store_holds(spark, tmp_dir):
    import json
    from armature.streaming.incremental import collect_responses, collected
    src, store = os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "store")
    os.makedirs(src)

    def put(name, **answers):
        with open(os.path.join(src, name), "w") as f:
            for k, v in answers.items():
                f.write(json.dumps({"custom_id": k, "response": {"body": {"choices": [{"message": {"content": v}}]}}}) + "\n")

    def drain(checkpoint):
        q = collect_responses(spark, src, store, os.path.join(tmp_dir, checkpoint))
        assert q.awaitTermination(120)
    put("a.json", p1="old", p2="two")
    drain("c1")
    put("b.json", p3="three")
    drain("c1")                                                 # the same run goes on
    os.makedirs(os.path.join(tmp_dir, "in2"))
    src = os.path.join(tmp_dir, "in2")
    put("c.json", p1="new")
    drain("c2")                                                 # a fresh checkpoint, epoch 0 again
    assert {r.custom_id: r.content for r in collected(spark, store).collect()} == {"p1": "new", "p2": "two", "p3": "three"}
    assert len([d for d in os.listdir(store) if d.startswith("run=")]) == 2
