"""Scoring result rows (P10 and the scoring side of A1-A3).

``p_first`` / ``p_second`` are the marginal probabilities (A1) of the first
and second answer label of the question format: A/B for ``ab*`` formats,
YES/NO otherwise.  The first label names the option shown first, which is
action ``o`` for ordering ``o``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armature.functions import probability as PR
from armature.sources.registry import VARIANT_FAMILIES


def answer_labels(question_format: str) -> tuple[str, str]:
    fam = "ab" if question_format.startswith("ab") else "compare"
    first, second = VARIANT_FAMILIES[fam]
    return first, second


def pick_answers(df: DataFrame, suffix: str = "_prob") -> DataFrame:
    """P10, first half: ``p_first`` / ``p_second`` of rows of any choice format from the label columns of both families."""
    ab = F.col("question_format").startswith("ab")
    first, second = (F.when(ab, F.col(f"{x.lower()}{suffix}")).otherwise(F.col(f"{y.lower()}{suffix}"))
                     for x, y in zip(answer_labels("ab"), answer_labels("compare")))
    return df.withColumn("p_first", first).withColumn("p_second", second)


def answer_to_action(df: DataFrame, ordering: str = "question_ordering") -> DataFrame:
    """P10: A/YES -> action ``o``, B/NO -> action ``1 - o`` (a1/a2 are action 1 and 2)."""
    o0 = F.col(ordering) == 0
    return df.withColumn("a1_prob", F.when(o0, F.col("p_first")).otherwise(F.col("p_second"))) \
             .withColumn("a2_prob", F.when(o0, F.col("p_second")).otherwise(F.col("p_first")))


def score_choice(df: DataFrame, positions: str, question_format: str, variants: DataFrame | None = None) -> DataFrame:
    """A1 + P10 for a choice question: answer-label marginals, then map to actions.

    ``variants``: the models' token sequences (``probability.token_seqs``).
    """
    first, second = answer_labels(question_format)
    probs = PR.answer_probs(df, positions, [first, second], suffix="_p", variants=variants)
    return answer_to_action(probs.withColumnRenamed(f"{first.lower()}_p", "p_first")
                                 .withColumnRenamed(f"{second.lower()}_p", "p_second"))


def score_options(df: DataFrame, positions: str, family: str, variants: DataFrame | None = None) -> DataFrame:
    """A1 for every label of an option family (normbank: good/ok/bad; reddit: five verdicts)."""
    return PR.answer_probs(df, positions, VARIANT_FAMILIES[family], variants=variants)
