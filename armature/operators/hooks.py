"""User extension hooks (X1, X2, X4): model calls and text scorers as Arrow-batched maps.

Model inference and the moral-foundation classifier are not data work; the engine fixes *where* they
run (inside ``mapInPandas``, the user's callable made once per task and fed Arrow batches of
``spark.sql.execution.arrow.maxRecordsPerBatch`` rows) and *how often*: calls are content-addressed.
Inputs are named by a 128-bit digest, each distinct input is passed to the callable once, and the outputs are
joined back, however many rows share it.  With a ``memo`` folder the outputs are also kept for later runs, which
call only for inputs that the folder does not hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOUNDATION_CODES = ["CH", "FC", "LB", "AS", "PD"]
SCORE_FIELDS = ", ".join(f"{c.lower()}_score double" for c in FOUNDATION_CODES)

Responder = Callable[[pd.DataFrame], pd.DataFrame]
Scorer = Callable[[list], list]


def digest(*inputs: Column) -> Column:
    """128 bits of the inputs' lengths and values; a null differs from an empty text."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in inputs]
    return F.unhex(F.md5(F.concat_ws("|", *parts).cast("binary")))


def once(df: DataFrame, inputs: dict[str, Column], call: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
         fields: str, memo: str | None = None, kept: Column | None = None) -> DataFrame:
    """``df`` with the columns ``fields`` that ``call`` gives for each distinct value of ``inputs``.

    ``call`` maps batches (_digest, inputs...) to batches (_digest, fields...).  ``memo``: a Parquet folder of earlier
    outputs; new ones with ``kept`` true are added to it, so calls that failed are made again by a later run.
    """
    spark = df.sparkSession
    asked = df.withColumns({f"_in_{n}": c for n, c in inputs.items()}).withColumn("_digest", digest(*inputs.values()))
    todo = asked.groupBy("_digest").agg(*[F.min(f"_in_{n}").alias(n) for n in inputs])
    names = [f.split()[0] for f in fields.split(",")]
    held = None
    if memo is not None:
        from armature.session import cut_lineage
        from armature.sinks.writers import exists
        if exists(spark, memo):
            held = spark.read.schema(f"_digest binary, {fields}").parquet(memo)
            todo = todo.join(held.select("_digest"), "_digest", "left_anti")
    out = todo.mapInPandas(call, f"_digest binary, {fields}")
    if memo is not None:
        out = cut_lineage(out)                  # called once, though written and joined
        known = out if held is None else cut_lineage(held).unionByName(out)
        (out if kept is None else out.where(kept)).write.mode("append").parquet(memo)
        out = known.dropDuplicates(["_digest"])
    return asked.join(out, "_digest", "left").select(*df.columns, *names)


def respond(prompts: DataFrame, make_model: Callable[..., Responder], id_col: str = "prompt_id",
            memo: str | None = None, **sampling: float) -> DataFrame:
    """(prompt_id, system_prompt, user_prompt) -> (prompt_id, sampling..., answer_raw, answer, status, timestamp).

    ``sampling`` (max_tokens, temperature, top_p) goes to ``make_model``, called once per task, and to the result.  The
    returned callable maps a pandas batch of prompts to a batch with ``answer_raw``; a null answer stays null, with status
    ``failed``.  With a ``memo`` equal prompts under equal sampling share one answer; without one every row is its own call.
    """
    from armature.functions.text import timestamp_now
    own = [] if memo is not None else [id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model(**sampling)
        for b in batches:
            given = b if own else b.assign(**{id_col: [d.hex() for d in b["_digest"]]})
            out = model(given[[id_col, "system_prompt", "user_prompt"]])
            raw = [None if pd.isna(a) else str(a) for a in out["answer_raw"]]
            yield pd.DataFrame({"_digest": b["_digest"], "answer_raw": raw,
                                "answer": [None if a is None else a.strip() for a in raw],
                                "status": ["failed" if a is None else "ok" for a in raw]})
    named = {k: F.lit(float(v) if k != "max_tokens" else int(v)) for k, v in sampling.items()}
    rows = prompts.select(F.col(id_col).cast("string").alias(id_col), "system_prompt", "user_prompt").withColumns(named)
    inputs = {c: F.col(c) for c in (*own, "system_prompt", "user_prompt", *named)}
    done = once(rows, inputs, run, "answer_raw string, answer string, status string", memo, F.col("status") == "ok")
    return done.drop("system_prompt", "user_prompt").withColumn("timestamp", timestamp_now())


def score_texts(df: DataFrame, text_col: str, make_scorer: Callable[[], Scorer], keep: list[str],
                memo: str | None = None) -> DataFrame:
    """``keep`` and five foundation scores per row; each distinct text is scored once, a null text has null scores."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for b in batches:
            texts = [None if t is None or t != t else t for t in b["text"].tolist()]
            found = iter(scorer([t for t in texts if t is not None]))
            scores = [None if t is None else next(found) for t in texts]
            yield pd.DataFrame({"_digest": b["_digest"], **{f"{c.lower()}_score": [None if s is None else s.get(c) for s in scores]
                                                            for c in FOUNDATION_CODES}})
    return once(df, {"text": F.col(text_col).cast("string")}, run, SCORE_FIELDS, memo).select(
        *keep, *[f"{c.lower()}_score" for c in FOUNDATION_CODES])
