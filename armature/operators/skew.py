"""Hot-key aware many-to-one join.

Row-level outputs pair every raw row with a small per-key table (the key's
baseline mean).  If one key holds a third of all rows, a plain shuffle join
sends that third to one task.  The per-key table already carries the key's
row count, so the heaviest keys are split off:

  * hot keys: the ``max_hot_keys`` keys with the most rows above ``hot_rows``.
    The broadcast side is bounded by construction (a top-k ``limit``), and the
    hot raw rows are never shuffled;
  * every other key - including any over-threshold key beyond the top k - goes
    through the ordinary shuffle join, so the result is exact.

The union of the two joins is exactly the plain inner join.  The per-key table
is checkpointed once (it feeds four branches); the raw side is read twice
(hot rows, other rows) and only the non-hot rows are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_HOT_ROWS = 5_000_000
DEFAULT_MAX_HOT_KEYS = 10_000


def split_hot_join(big: DataFrame, per_key: DataFrame, keys: list[str], count_col: str,
                   hot_rows: int = DEFAULT_HOT_ROWS, max_hot_keys: int = DEFAULT_MAX_HOT_KEYS) -> DataFrame:
    """Inner join ``big`` with ``per_key`` (``count_col`` = rows of the key in ``big``).

    ``per_key`` is referenced by every branch, so it is checkpointed once into the
    shared checkpoint folder (reliable; a lost executor does not recompute it).
    """
    from armature.session import cut_lineage
    per_key = cut_lineage(per_key)
    key_counts = per_key.select(*keys, count_col).distinct()
    hot_keys = (key_counts.where(F.col(count_col) > hot_rows)
                .orderBy(F.col(count_col).desc(), *keys).limit(max_hot_keys).select(*keys))
    hot_side = per_key.join(F.broadcast(hot_keys), keys, "left_semi").drop(count_col)
    cold_side = per_key.join(F.broadcast(hot_keys), keys, "left_anti").drop(count_col)
    big_hot = big.join(F.broadcast(hot_keys), keys, "left_semi")
    big_cold = big.join(F.broadcast(hot_keys), keys, "left_anti")
    return (big_hot.join(F.broadcast(hot_side), keys, "inner")
            .unionByName(big_cold.join(cold_side, keys, "inner")))
