"""Text operators: the reference's prompter unit cases as behaviour, plus a
plain-Python restatement of the verdict / reasoning rules checked on edge cases."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from armature.functions import text as TX
from armature.sources.registry import TEMPLATES

# --- plain Python restatement of the reference's extraction rules -----------
_V = re.compile(r"(?i)\bVerdict\b\s*[:\-]\s*(YTA|NTA|ESH|NAH|INFO)\b")
_R = re.compile(r"(?is)\b(?:Reasoning|Reason|Explanation)\b\s*[:\-]\s*(.+)")


def py_extract(text):
    t = (text or "").strip()
    if not t:
        return None, None
    verdict, end = None, None
    m = _V.search(t)
    if m:
        verdict, end = m.group(1).upper(), m.end()
    else:
        for lab in ("YTA", "NTA", "ESH", "NAH", "INFO"):
            f = re.search(rf"\b{lab}\b", t, re.IGNORECASE)
            if f:
                verdict, end = lab, f.end()
                break
    m = _R.search(t)
    if m:
        snip = m.group(1).strip()
        cut = re.split(r"\n\s*(?:Verdict|Reasoning|Reason|Explanation|Summary)\s*[:\-]", snip, maxsplit=1)[0].strip()
        return verdict, cut or None
    if end is not None and end < len(t):
        rem = t[end:].strip()
        return verdict, rem or None
    return verdict, None


EDGE = [
    "Verdict: YTA\nReasoning: You ignored everyone.",
    "verdict - nta because reasons", "I think NTA, not YTA", "unsure", "", "   ",
    "Reasoning: first\nSummary: second", "Verdict:ESH\nExplanation - it was\n  Verdict: NTA later",
    "éNTA is not a word but NTA is", "Verdicts: YTA", "xVerdict: YTA then NAH", "INFO\n",
    "Reason: short", "Reasons: plural then NAH.", "Verdict: INFO\n\nReasoning:   \n", "NTA  ",
    "Résumé: nah ça va NAH", "Verdict : NAH\nReasoning :\tfine\n Reason: x",
    "Explanation: a\nVerdict - YTA\nmore", "yta", "nTa!", "ESH\nReasoning: both\n\nSummary: done",
]


def _spark_extract(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, a string")
    d = df.select("i", TX.response_text(F.col("a")).alias("t"))
    rows = TX.extract_verdict_reasoning(d, "t", "v", "r").orderBy("i").collect()
    return [(r.v, r.r) for r in rows]


def test_extraction_matches_python_rules_on_edge_cases(spark):
    assert _spark_extract(spark, EDGE) == [py_extract(t) for t in EDGE]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from(list("VerdictYTANHSIFOReasonxé:- \n\t.,") + ["Verdict: ", "NTA", "Reasoning: ", "\nSummary: "]),
                min_size=1, max_size=12).map("".join))
def test_extraction_property(spark, text):
    assert _spark_extract(spark, [text]) == [py_extract(text)]


def test_reference_unit_cases(spark):
    # answer "Verdict: YTA\nReasoning: You ignored everyone." -> YTA + reasoning
    v, r = _spark_extract(spark, ["Verdict: YTA\nReasoning: You ignored everyone."])[0]
    assert v == "YTA" and "ignored everyone" in r
    # text distractor before the system prompt; image instruction
    df = spark.createDataFrame([("text", "You are a soldier in war."), ("image", None), (None, None)],
                               "m string, t string")
    out = df.select(TX.inject_system_side(F.lit(TEMPLATES["reddit"][0]), F.col("m"), F.col("t")).alias("s")).collect()
    assert out[0].s.startswith("You are a soldier in war.")
    assert "Later, you are a tool for evaluating moral dilemmas." in out[0].s
    assert "You see the scene in the image." in out[1].s
    assert out[2].s == TEMPLATES["reddit"][0].strip()


def test_lower_first_alpha_and_injection(spark):
    df = spark.createDataFrame([("  12) Hello",), ("123",), ("Émile",), ("",)], "s string")
    got = [r.x for r in df.select(TX.lower_first_alpha(F.col("s")).alias("x")).collect()]
    assert got == ["  12) hello", "123", "émile", ""]
    d2 = spark.createDataFrame([("Ctx here", "text", "Body"), ("Ctx", "text", ""), ("Ctx", "image", "x")],
                               "c string, m string, t string")
    got = [r.x for r in d2.select(TX.inject_scenario_side(F.col("c"), F.col("m"), F.col("t")).alias("x")).collect()]
    assert got == ["Body Later, ctx here", "Ctx", "You see the scene in the image. Ctx"]


def test_safe_identifier_and_markers(spark):
    df = spark.createDataFrame([("a b/ç-1_x",), (None,)], "s string")
    assert [r.x for r in df.select(TX.safe_identifier(F.col("s")).alias("x")).collect()] == ["a_b_ç-1_x", "none"]
    d = spark.createDataFrame([("sys assistant hi assistant  final ",), ("no marker ",)], "s string")
    got = [r.x for r in d.select(TX.answer_after_marker(F.col("s"), "assistant").alias("x")).collect()]
    assert got == ["final", "no marker"]


def test_strip_is_python_strip(spark):
    s = "　\t x y  \n\x1c"
    assert spark.createDataFrame([(s,)], "s string").select(TX.strip(F.col("s"))).first()[0] == s.strip()


@pytest.mark.parametrize("text,expected", [("I say NTA, not YTA", "YTA"), ("nah and esh", "ESH")])
def test_fallback_uses_priority_not_position(spark, text, expected):
    assert _spark_extract(spark, [text])[0][0] == expected
