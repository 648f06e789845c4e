"""Spelling tries and logits in chunks against plain Python and numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from armature.functions import probability as PR
from armature.operators.spec import spec
from armature.sources.registry import VARIANT_FAMILIES, byte_level_cut, variants_df

POSITIONS = "id long, model_id string, positions array<array<struct<token:string,logprob:double>>>"


def _chain(positions, seq):
    if positions is None or len(seq) > len(positions):
        return 0.0
    total = 0.0
    for top, token in zip(positions, seq):
        last = {t: lp for t, lp in top or []}.get(token)
        if last is None:
            return 0.0
        total += last
    return math.exp(total)


def test_trie_equals_the_chain_rule_per_spelling(spark):
    r = random.Random(3)
    tokens = ["a", " b", "c'", "\\", "d\n", "é"]
    seqs = {m: {lab: [[r.choice(tokens) for _ in range(r.randint(0 if lab == "Z" else 1, 5))] for _ in range(12)] for lab in ("X", "Y", "Z")}
            for m in ("m1", "m2")}
    rows = []
    for i in range(300):
        p = [[(r.choice(tokens), r.choice([-0.1, -0.7, -2.5, None])) for _ in range(r.randint(0, 8))] for _ in range(r.randint(0, 6))]
        rows.append((i, r.choice(["m1", "m2", "m3"]), None if i == 0 else p))
    variants = spark.createDataFrame([(m, lab, s) for m, by in seqs.items() for lab, v in by.items() for s in v],
                                     "model_id string, label string, token_seq array<string>")
    got = PR.answer_probs(spark.createDataFrame(rows, POSITIONS), "positions", ["X", "Y", "Z"], variants=variants).collect()
    for x, (_, model, p) in zip(sorted(got, key=lambda x: x.id), rows):
        for lab in ("X", "Y", "Z"):
            want = sum(_chain(p, s) for s in seqs[model][lab]) if model in seqs else 0.0
            if p is None:                                        # no response at all
                want = 0.0
            assert abs(x[f"{lab.lower()}_prob"] - want) < 1e-12
    trie = PR.VariantTrie(seqs["m1"])
    assert sum(map(len, trie.levels)) < sum(len(s) for v in seqs["m1"].values() for s in v)      # shared prefixes once


def test_registry_table_reaches_the_dataset_specs(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    cut = byte_level_cut(tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    table = variants_df(spark, cut)
    assert table.where(F.concat_ws("", "token_seq") != F.col("variant")).count() == 0
    assert cut("Verdict: NTA") == ["Ver", "dict", ":", " N", "TA"]
    top = [[(t, -0.5)] for t in cut("Verdict: NTA")]
    df = spark.createDataFrame([(1, "Verdict: NTA", "", top)], "id long, answer string, answer_raw string, positions array<array<struct<token:string,logprob:double>>>")
    scored = spec("reddit").score(df, table).first()
    assert abs(scored.nta_prob - math.exp(-2.5)) < 1e-12 and scored.yta_prob == 0.0
    assert set(VARIANT_FAMILIES["reddit"]) == {c[:-5].upper() for c in scored.asDict() if c.endswith("_prob")}


@pytest.mark.parametrize("width", [8_000, 256_000])
def test_logits_in_chunks(spark, width):
    r = np.random.default_rng(width)
    logits = r.normal(0, 30, (3, width))
    logits[:, ::3] = -np.inf
    logits[0, 0] = logits[1, :5000] = -np.inf                    # a masked beginning, a wholly masked chunk
    nulls = r.choice(width, 50, replace=False)
    seqs = [[5001, 7, 1], [5001, 7, 4], [int(nulls[0])], [3], [5001, 5002, 7, 8], [5003]]
    rows, step = [], 4000
    for p in range(3):
        for at in range(0, width, step):
            part = [None if at + i in set(nulls) else float(v) for i, v in enumerate(logits[p, at:at + step])] if any(at <= n < at + step for n in nulls) \
                else logits[p, at:at + step].tolist()
            rows.append((1, p + 1, at, part))
    chunks = spark.createDataFrame(rows, "id long, pos int, offset int, logits array<double>").repartition(5)
    variants = spark.createDataFrame([(f"L{i}", [str(t) for t in s]) for i, s in enumerate(seqs)], "label string, token_seq array<string>")
    labels = [f"L{i}" for i in range(len(seqs))]
    wanted = PR.VariantTrie(PR.token_seqs(labels, variants)).tokens()
    got = PR.answer_probs(PR.logit_positions(chunks, ["id"], wanted), "positions", labels, variants=variants).first()
    live = logits.copy()
    live[:, nulls] = -np.inf
    top = live.max(axis=1, keepdims=True)
    lp = live - top - np.log(np.exp(live - top).sum(axis=1, keepdims=True))
    for i, s in enumerate(seqs):
        want = 0.0 if len(s) > 3 else math.exp(sum(lp[j, t] for j, t in enumerate(s)))
        assert got[f"l{i}_prob"] == pytest.approx(want, rel=1e-9, abs=1e-300)


def test_softmax_pick_with_masked_and_null_logits(spark):
    df = spark.createDataFrame([([float("-inf"), 1.0, None, 2.0, float("nan")],), ([float("-inf")] * 2,), ([1000.0, 0.0],)], "v array<double>")
    got = [x.p for x in df.select(F.expr(PR.softmax_logprob_sql("v", "2")).alias("p")).collect()]
    assert got[0] == pytest.approx(1 - math.log(math.exp(1) + math.exp(2)), rel=1e-12)
    assert got[1] is None or math.isnan(got[1]) or got[1] == float("-inf")
    assert got[2] == pytest.approx(-1000.0)
