"""J4 + condition derivation, and the size-checked broadcast helper."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A registry side is broadcast only after these bounds are verified on the data.
MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 256 << 20
# (plan hash, input files, bound) -> verified small; the check is a job, so it runs once per plan
_SMALL: dict = {}


def _bytes(df: DataFrame):
    """About how many bytes a row takes: texts by their length, other values as 16."""
    sized = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) if f.dataType.typeName() in ("string", "binary") else F.lit(16)
             for f in df.schema.fields]
    return sum(sized, F.lit(0)).cast("long")


def small_side(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast-hint ``df`` only when it provably holds at most ``max_rows`` rows and about ``max_bytes`` bytes.

    The check reads at most ``max_rows + 1`` rows - it stops early on a
    large input.  Above a bound no hint is given: the planner falls back to a
    shuffle join (and AQE may still broadcast at run time from real sizes).
    """
    try:
        memo_key = (df.semanticHash(), tuple(sorted(df.inputFiles())), max_rows, max_bytes)
    except Exception:  # noqa: BLE001 - plans without a stable hash are checked every time
        memo_key = None
    small = _SMALL.get(memo_key) if memo_key is not None else None
    if small is None:
        found = df.limit(max_rows + 1).select(_bytes(df).alias("_b")).agg(F.count(F.lit(1)), F.sum("_b")).first()
        small = found[0] <= max_rows and (found[1] or 0) <= max_bytes
        if memo_key is not None:
            _SMALL[memo_key] = small
    return F.broadcast(df) if small else df


def attach_condition(df: DataFrame, distractors: DataFrame, id_col: str = "distractor_id",
                     strict: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Left-join the distractor registry and derive ``condition``.

    ``condition`` is ``baseline`` when the row has no distractor, else the
    distractor's sentiment.  An id missing from the registry is ``unknown``
    (``strict=False`` reproduces the reference, which calls it baseline).
    ``keep`` names further registry columns to carry (e.g. ``modality``).
    """
    d = distractors.select(F.col("id").alias("_d_id"), F.col("sentiment").alias("_d_sentiment"),
                           *[F.col(k).alias(f"distractor_{k}") for k in keep])
    joined = df.join(small_side(d), F.col(id_col) == F.col("_d_id"), "left")
    miss = F.lit("unknown") if strict else F.lit("baseline")
    cond = (F.when(F.col(id_col).isNull(), F.lit("baseline"))
            .when(F.col("_d_sentiment").isNull(), miss)
            .otherwise(F.col("_d_sentiment")))
    return joined.withColumn("condition", cond).drop("_d_id", "_d_sentiment")


def unmatched_arms(df: DataFrame, distractors: DataFrame, id_col: str = "distractor_id") -> DataFrame:
    """Q1: (model_id, distractor_id, n): stored rows whose distractor the registry does not have.

    Such rows are condition ``unknown`` and enter no condition's statistics; rows are counted before the
    registry is joined, so a frequent id collapses map-side.
    """
    counts = df.where(F.col(id_col).isNotNull()).groupBy("model_id", id_col).agg(F.count(F.lit(1)).alias("n"))
    known = small_side(distractors.select(F.col("id").alias("_known")))
    return counts.join(known, F.col(id_col) == F.col("_known"), "left_anti")
