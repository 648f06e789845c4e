"""Resumption: bitmaps of finished prompts against a plain set difference, and the product grid."""

import random

import pytest
from pyspark.sql import functions as F

from armature.operators import design as DS
from armature.operators import grid
from armature.operators.resume import resume_pending
from armature.plans import workflows as WF

STORE = ("experiment string, dataset string, model_id string, question_format string, scenario_id long, "
         "distractor_id long, question_ordering long, status string")


def _tables(spark, scenarios=7, distractors=40):
    s = spark.createDataFrame([(i, f"context {i}", "a", "b") for i in range(scenarios)],
                              "scenario_id long, context string, action1 string, action2 string")
    d = spark.createDataFrame([(3 * i + 1, "positive", "text" if i % 2 else "image", f"p{i}") for i in range(distractors)],
                              "id long, sentiment string, modality string, file_path string")
    return s, d


@pytest.mark.parametrize("block_arms", [8, 1024])
def test_pending_is_the_complement(spark, block_arms):
    r = random.Random(block_arms)
    s, d = _tables(spark)
    ids = [None] + [3 * i + 1 for i in range(40)]
    every = [(e, ds, m, f, i, a, o) for e in ("main", "pilot") for ds in ("x", "y") for m in ("A", "B", "C") for f in ("ab", "compare")
             for i in range(7) for a in ids for o in range(3)]
    stored = [(*k, r.choice(["ok", "failed"])) for k in r.sample(every, 6000)]
    stored += stored[:50] + [("main", "x", "A", "ab", 2, 999, 0, "ok"), ("main", "x", "A", "ab", 99, 1, 0, "ok")]
    got = resume_pending(s, d, ["ab", "compare"], spark.createDataFrame(stored, STORE), experiment="main", dataset="x",
                         models=["A", "B"], orderings=3, block_arms=block_arms, target_rows=100).select(*DS.RESULT_KEY).collect()
    ok = {k[:-1] for k in stored if k[-1] == "ok"}
    cols = ("experiment", "dataset", "model_id", "question_format", "scenario_id", "distractor_id", "question_ordering")
    want = {k for k in every if k[0] == "main" and k[1] == "x" and k[2] in "AB" and k not in ok}
    rows = [tuple(x[c] for c in cols) for x in got]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_a_row_of_another_experiment_drops_nothing(spark):
    s, d = _tables(spark, 2, 2)
    texts = spark.createDataFrame([("p0", "body")], "file_path string, body string")
    name, model = "moralchoice_high_ambiguity", "google/gemma-3-4b-it"
    all_ids = {x.custom_id for x in WF.evaluation_requests(s, d, texts, name, model).collect()}
    assert len(all_ids) == 2 * 3 * 2
    other = [("pilot", name, model, "ab", 0, None, 0, "ok"), ("main", "moralchoice_low_ambiguity", model, "ab", 0, None, 0, "ok"),
             ("main", name, model, "ab", 0, None, 1, "failed"), ("main", name, "other", "ab", 0, None, 0, "ok")]
    assert {x.custom_id for x in WF.evaluation_requests(s, d, texts, name, model, spark.createDataFrame(other, STORE)).collect()} == all_ids
    own = [("main", name, model, "ab", 0, None, 1, "ok")]
    left = {x.custom_id for x in WF.evaluation_requests(s, d, texts, name, model, spark.createDataFrame(own, STORE)).collect()}
    assert all_ids - left == {"0_none_1_ab"}
    with pytest.raises(ValueError):
        WF.evaluation_requests(s, d, texts, name, model, spark.createDataFrame(own, STORE).drop("dataset"))


def test_image_prompts_only_for_models_that_take_them(spark):
    s, d = _tables(spark, 2, 4)
    texts = spark.createDataFrame([("p0", "body")], "file_path string, body string")
    lines = WF.evaluation_requests(s, d, texts, "moralchoice_high_ambiguity", "Qwen/Qwen3-4B").collect()
    assert {x.custom_id.split("_")[1] for x in lines} == {"none", "4", "10"}          # distractors 1 and 7 are images
    assert all('"model":"Qwen3-4B"' in x.line for x in lines)


def test_pending_needs_the_same_key_on_both_sides(spark):
    rows = spark.createDataFrame([(1, "m", "x")], "scenario_id long, model_id string, dataset string")
    with pytest.raises(ValueError):
        DS.pending(rows, spark.createDataFrame([(1, "m")], "scenario_id long, model_id string"))


def test_nothing_is_exchanged_above_the_product(spark):
    s, d = _tables(spark)
    done = spark.createDataFrame([("main", "x", "A", "ab", 1, 4, 0, "ok")], STORE)
    plan = resume_pending(s, d, ["ab"], done, experiment="main", dataset="x", models=["A"], orderings=2)
    text = plan._jdf.queryExecution().sparkPlan().toString()
    assert "Exchange" not in text.split("ShuffledHashJoin")[0]
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_stored_rows_and_scenarios_are_exchanged_once(spark):
    """Bitmaps are made in the cells: no exchange by scenario besides the one to the cells of each side of the product."""
    s, d = _tables(spark)
    done = spark.createDataFrame([("main", "x", "A", "ab", 1, 4, 0, "ok")], STORE)
    plan = resume_pending(s, d, ["ab"], done, experiment="main", dataset="x", models=["A", "B"], orderings=2)
    lines = [x for x in plan._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x]
    assert sum("REPARTITION_BY_NUM" in x for x in lines) == 2
    assert not [x for x in lines if "ENSURE_REQUIREMENTS" in x and ("scenario_id" in x or "_l#" in x)]


def test_scenarios_meet_stored_rows_of_another_type(spark):
    """Ids of other types meet as in a join; null ids never do; scenarios, models and stored rows may come twice."""
    s = spark.createDataFrame([(1,), (1,), (2,), (None,)], "scenario_id int")
    d = spark.createDataFrame([(7,), (8,)], "id int")
    done = [("e", "x", "A", "ab", 1, 7, 1, "ok"), ("e", "x", "A", "ab", 1, 7, 1, "ok"), ("e", "x", "B", "compare", 2, None, None, "ok"),
            ("e", "x", "A", "ab", None, 8, 0, "ok"), ("e", "x", "A", "ab", 2, 8, 2, "ok"), ("e", "x", None, "ab", 2, 8, 0, "ok")]
    got = resume_pending(s, d, ["ab", "compare"], spark.createDataFrame(done, STORE), experiment="e", dataset="x",
                         models=["A", "B", "A"], orderings=2)
    assert dict(got.dtypes)["scenario_id"] == "int" and "distractor_modality" not in got.columns
    gone = {("A", "ab", 1, 7, 1), ("B", "compare", 2, None, 0)}
    want = [(m, f, i, a, o) for i in (1, 1, 2, None) for m in "ABA" for f in ("ab", "compare") for a in (None, 7, 8) for o in (0, 1)
            if (m, f, i, a, o) not in gone]
    rows = [tuple(r) for r in got.select("model_id", "question_format", "scenario_id", "distractor_id", "question_ordering").collect()]
    assert sorted(map(str, rows)) == sorted(map(str, want))


def test_pending_models_never_moves_the_product(spark):
    """design_pending: the pairs with their missing models come from bitmaps; nothing is exchanged above the product."""
    s, d = spark.createDataFrame([(1,), (2,), (2,), (3,)], "scenario_id long"), _tables(spark)[1]
    arms = [None, *[r.id for r in d.select("id").collect()]]
    done = [("A", 1, None), ("A", 1, arms[1]), ("A", 1, arms[1]), ("B", 2, arms[-1]), ("C", 3, None), ("B", 3, -5), (None, 3, None), ("A", None, None)]
    got = DS.pending_models(s, d, spark.createDataFrame(done, "model_id string, scenario_id long, distractor_id long"), ["A", "B"])
    want = [(m, i, x) for i in (1, 2, 2, 3) for x in arms for m in ("A", "B") if (m, i, x) not in done]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert "Exchange" not in got._jdf.queryExecution().sparkPlan().toString().split("ShuffledHashJoin")[0]


def test_a_cell_is_unfolded_tile_by_tile(spark):
    """Few values over and over: no left row runs over more right rows than a tile has, so files stay small."""
    from itertools import groupby
    got = grid.cross(spark.range(256).toDF("x"), spark.range(256).toDF("y"))
    parts = got.rdd.glom().collect()
    assert sum(map(len, parts)) == 256 * 256 == len({tuple(r) for p in parts for r in p})
    assert max(len(list(run)) for p in parts for _, run in groupby(p, lambda r: r.x)) == grid.TILE


def test_arms_carry_the_columns_of_their_registry(spark):
    s, d = _tables(spark, 3, 5)
    got = DS.design(s.select("scenario_id"), d.select("id", "modality"), ["ab", "compare"])
    assert got.columns == ["scenario_id", "distractor_id", "distractor_modality", "question_format"]
    want = {(i, a, m, f) for i in range(3) for f in ("ab", "compare") for a, m in [(None, None), *[(r.id, r.modality) for r in d.collect()]]}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_grid_of_given_blocks(spark):
    """A cell pairs its left rows with one block: the left side is cut for the rows of one block."""
    left = spark.range(600).selectExpr("id AS x", "explode(array(0, 1, 2)) AS block")
    right = spark.range(60).selectExpr("id AS y", "CAST(id % 3 AS int) AS block")
    got = grid.cross(left, right, 600, 60, 600, right_block="block", blocks=3, per_left={"twice": F.col("x") * 2})
    assert got.rdd.getNumPartitions() == 60                                          # 36,000 rows out, 600 a cell
    assert got.where("twice = 2 * x AND block = y % 3").agg(F.count("*"), F.countDistinct("x", "y")).first()[:] == (36_000, 36_000)
    assert grid.cell_rows(10 ** 6) == 1 << 20 and grid.cell_rows(10 ** 11) == 1 << 24


def test_grid_follows_the_rows_out(spark):
    assert grid.sides(1000, 10, 1 << 20) == (2, 1)
    a, b = grid.sides(10_000_000, 10, 1 << 20)
    assert b == 1 and 90 <= a <= 100                                                 # tasks grow with the scenarios
    a, b = grid.sides(100_000, 100_000, 1 << 20)
    assert abs(a - b) <= 2 and 9_000 <= a * b <= 10_500                              # neither side is copied to every cell
    left, right = spark.range(300).toDF("x"), spark.range(70).toDF("y")
    got = grid.cross(left, right, target=500)
    assert got.rdd.getNumPartitions() >= 40
    assert got.agg(F.count("*"), F.countDistinct("x", "y")).first()[:] == (21_000, 21_000)
    assert grid.cross(left.limit(0), right).count() == 0


def test_retrieve_and_collect(spark, tmp_dir):
    """Returned lines become scored rows of the store; a missing response stays pending and is filled in later."""
    import json
    import os

    from armature.operators import results as RS
    s, d = _tables(spark, 2, 2)
    texts = spark.createDataFrame([("p0", "body"), ("p1", "more")], "file_path string, body string")
    name, model = "moralchoice_high_ambiguity", "google/gemma-3-4b-it"
    from armature.operators.spec import spec
    prompts = spec(name).render(WF._with_texts(WF.pending_prompts(s, d, name, [model]), texts))
    ids = sorted(r.prompt_id for r in prompts.collect())
    assert len(ids) == 12

    def lines(some):
        top = [{"token": "A", "logprob": -0.25}, {"token": "B", "logprob": -1.5}]
        return "".join(json.dumps({"custom_id": i, "response": {"status_code": 200, "body": {"choices": [
            {"message": {"content": " A "}, "logprobs": {"content": [{"token": "A", "logprob": -0.25, "top_logprobs": top}]}}]}}}) + "\n" for i in some)
    store, path = os.path.join(tmp_dir, "store"), os.path.join(tmp_dir, "out")
    os.makedirs(path)
    with open(os.path.join(path, "a.jsonl"), "w") as f:
        f.write(lines(ids[:9]))
    assert RS.retrieve(spark, prompts, path, store, name).where("status = 'ok'").count() == 9
    done = spark.read.parquet(store)
    left = WF.pending_prompts(s, d, name, [model], done)
    again = spec(name).render(WF._with_texts(left, texts))
    assert sorted(r.prompt_id for r in again.collect()) == ids[9:]
    with open(os.path.join(path, "b.jsonl"), "w") as f:
        f.write(lines(ids[9:]))
    RS.retrieve(spark, again, path, store, name)
    got = RS.collect_results(spark, store, "main", name)
    assert got.count() == 12 and WF.pending_prompts(s, d, name, [model], spark.read.parquet(store)).count() == 0
    row = got.where("question_ordering = 1").first()
    assert row.answer == "A" and abs(row.a2_prob - 2.718281828459045 ** -0.25) < 1e-9 and abs(row.a1_prob - 2.718281828459045 ** -1.5) < 1e-9
    assert RS.collect_results(spark, store, "main", name, "none").count() == 4
    assert RS.collect_results(spark, store, "main", name, "image").count() == 4
    assert RS.collect_results(spark, store, "pilot", name).count() == 0


def test_rows_without_a_text_do_not_share_a_key(spark, monkeypatch):
    """Bodies too large to broadcast: untreated rows spread over many join keys, results as ever."""
    from armature.operators import conditions as C
    from armature.operators import render as RD
    rows = spark.range(3000).select(F.col("id").alias("scenario_id"), F.when(F.col("id") % 10 == 0, F.lit("p1")).alias("distractor_file_path"))
    texts = spark.createDataFrame([("p1", "  body "), ("p2", "x" * 100), (None, "nothing")], "file_path string, body string")
    assert "BroadcastHashJoin" in RD.attach_distractor_text(rows, texts)._jdf.queryExecution().sparkPlan().toString()
    monkeypatch.setattr(C.small_side, "__defaults__", (C.MAX_BROADCAST_ROWS, 50))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = RD.attach_distractor_text(rows, texts)
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().sparkPlan().toString()
        got = out.groupBy(F.col("distractor_text")).count().collect()
        assert {r[0]: r[1] for r in got} == {"body": 300, None: 2700}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
