"""Declared schemas and domain constants of the experiment tables."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the published experiment's for equal results)
# ---------------------------------------------------------------------------
CONDITIONS = ["baseline", "positive", "neutral", "negative"]
SENTIMENTS = ["positive", "neutral", "negative"]
MODALITIES = ["text", "image"]
IMAGE_POSITIONS = ["before_system", "after_system", "before_user", "after_user"]
RULES = ["death", "pain", "disable", "freedom", "pleasure", "deceive", "cheat",
         "break_promise", "break_law", "duty"]
VERDICTS = ["YTA", "NTA", "ESH", "NAH", "INFO"]          # fallback priority order
VERDICT_OPTIONS = ["esh", "yta", "nta", "nah", "info"]
NORMBANK_OPTIONS = ["good", "ok", "bad"]
FOUNDATIONS = ["ch", "fc", "lb", "as", "pd"]
FOUNDATION_LABELS = {
    "ch_score": "Care/Harm",
    "fc_score": "Fairness/Cheating",
    "lb_score": "Loyalty/Betrayal",
    "as_score": "Authority/Subversion",
    "pd_score": "Purity/Degradation",
}
# pairwise comparisons reported for every cell
CONDITION_PAIRS = [("baseline", "positive"), ("baseline", "neutral"), ("baseline", "negative"),
                   ("positive", "neutral"), ("negative", "neutral"), ("positive", "negative")]
TIMESTAMP_FORMAT = "yyyy-MM-dd_HH:mm:ss"
WILSON_Z = 1.959963984540054
TOP_LOGPROBS = 20
# ---------------------------------------------------------------------------

# Python's str.isspace() set, built from the rule rather than listed: the
# reference strips with str.strip(), which removes exactly these characters.
PY_WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

DISTRACTORS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("sentiment", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("modality", T.StringType()),
])

MORALCHOICE_SCENARIO = T.StructType(
    [T.StructField(c, T.StringType()) for c in ["id", "context", "action1", "action2"]]
    + [T.StructField(f"a{i}_{r}", T.StringType()) for r in RULES for i in (1, 2)]
)

NORMBANK_SCENARIO = T.StructType([T.StructField("id", T.StringType()),
                                  T.StructField("context", T.StringType())])

REDDIT_SOURCE = T.StructType([T.StructField("submission_id", T.StringType()),
                              T.StructField("selftext", T.StringType())])

MORALBENCH_SCENARIO = T.StructType([T.StructField(c, T.StringType()) for c in [
    "scenario_id", "distractor_id", "ambiguity", "generation_type", "generation_rule",
    "context", "action1", "action2"]])

_TOP = T.ArrayType(T.StructType([T.StructField("token", T.StringType()),
                                 T.StructField("logprob", T.DoubleType())]))
BATCH_RESPONSE = T.StructType([
    T.StructField("custom_id", T.StringType()),
    T.StructField("response", T.StructType([
        T.StructField("status_code", T.LongType()),
        T.StructField("body", T.StructType([
            T.StructField("choices", T.ArrayType(T.StructType([
                T.StructField("message", T.StructType([T.StructField("content", T.StringType())])),
                T.StructField("logprobs", T.StructType([
                    T.StructField("content", T.ArrayType(T.StructType([
                        T.StructField("token", T.StringType()),
                        T.StructField("logprob", T.DoubleType()),
                        T.StructField("top_logprobs", _TOP),
                    ])))])),
            ]))),
        ])),
    ])),
])

RESULTS_MORALCHOICE = T.StructType([
    T.StructField("model_id", T.StringType()), T.StructField("question_format", T.StringType()),
    T.StructField("question_ordering", T.IntegerType()), T.StructField("system_prompt", T.StringType()),
    T.StructField("user_prompt", T.StringType()), T.StructField("eval_technique", T.StringType()),
    T.StructField("eval_top_p", T.DoubleType()), T.StructField("eval_temperature", T.DoubleType()),
    T.StructField("scenario_id", T.StringType()), T.StructField("distractor_id", T.StringType()),
    T.StructField("answer_raw", T.StringType()), T.StructField("answer", T.StringType()),
    T.StructField("a1_prob", T.DoubleType()), T.StructField("a2_prob", T.DoubleType()),
])

REDDIT_SCORE_COLS = [f"{f}_score" for f in FOUNDATIONS]
