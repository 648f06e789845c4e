"""A dataset spec ties a registry entry to its DataFrame -> DataFrame stages.

The reference extends behaviour by subclassing a prompter with pre/post
processing hooks; here a dataset is a small value object whose ``render``
turns design rows into prompts and whose ``score`` turns responses (text +
token positions) into result rows - both plain DataFrame transforms.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armature.functions import text as TX
from armature.operators import render as RD
from armature.operators import scoring as SC
from armature.sources.registry import DATASETS


@dataclass(frozen=True)
class DatasetSpec:
    name: str
    render: Callable[[DataFrame], DataFrame]
    #: (responses, models' token sequences or None) -> scored responses
    score: Callable[[DataFrame, DataFrame | None], DataFrame]
    formats: list[str] = field(default_factory=list)
    orderings: int = 1


def _score_choice(fmt: str):
    def score(df: DataFrame, variants: DataFrame | None = None) -> DataFrame:
        return SC.score_choice(df, "positions", fmt, variants)
    return score


def _score_normbank(df: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    return SC.score_options(df, "positions", "normbank", variants)


def _score_reddit(df: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    t = df.withColumn("response_text", TX.response_text(F.col("answer"), F.col("answer_raw")))
    t = TX.extract_verdict_reasoning(t, "response_text")
    return SC.score_options(t, "positions", "reddit", variants)


def spec(dataset: str) -> DatasetSpec:
    """Spec for a registered dataset; an unknown name is an error (as the reference)."""
    cfg = DATASETS.get(dataset)
    if cfg is None:
        raise KeyError(f"unknown dataset {dataset!r}")
    fmt = cfg["formats"][0]
    if dataset.startswith("moralchoice"):
        return DatasetSpec(dataset, lambda d: RD.render_choice(d, fmt), _score_choice(fmt), cfg["formats"], 2)
    if dataset == "normbank":
        return DatasetSpec(dataset, RD.render_system_injected, _score_normbank, cfg["formats"])
    return DatasetSpec(dataset, RD.render_verdict, _score_reddit, cfg["formats"])
