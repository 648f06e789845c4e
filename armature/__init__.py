"""armature: paired-condition experiment analytics on Spark DataFrames.

Scenario tables are crossed with treatment (distractor) tables into an
experiment design; model responses are scored as column expressions; every
treated condition is compared with its untreated baseline through grouped
aggregates, windows and joins that Catalyst plans and AQE re-plans at run time.

Sub-packages:
  sources    readers for experiment tables and the driver-table views
  sinks      partitioned / resumable writers
  functions  column-expression builders (text, probability, statistics)
  operators  DataFrame -> DataFrame transforms (design, effects, shares, tests)
  plans      registered end-to-end queries and their SQL twins
  streaming  incremental collection of arriving response files
"""

from armature.session import get_session, checkpoint_dir, cut_lineage  # noqa: F401

__all__ = ["get_session", "checkpoint_dir", "cut_lineage"]
