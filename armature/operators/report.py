"""Report tables (A21, K5): min/max flags across conditions and LaTeX row strings.

These run on result tables (one row per model x condition).  Number formatting
uses Python's formatter in an Arrow-batched UDF: Java's ``%.2f`` rounds from
the shortest decimal string (half-up), Python and C round the exact binary
value, and the published tables were written by Python.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from armature.schemas import CONDITIONS

# LaTeX colour macros used by the published tables.
MAX_COLOUR, MIN_COLOUR = "mygreen", "red"


@pandas_udf(StringType())
def fmt_pct(v: pd.Series) -> pd.Series:
    """'63.83\\%' (two decimals, Python rounding)."""
    return pd.Series([None if x != x else f"{x * 100:.2f}\\%" for x in v.astype(float)])


@pandas_udf(StringType())
def fmt_sci(v: pd.Series) -> pd.Series:
    """'1.83e-02'."""
    return pd.Series([None if x != x else f"{x:.2e}" for x in v.astype(float)])


def minmax_flags(df: DataFrame, by: list[str], value: str = "mean_score") -> DataFrame:
    """flag = 'max' where the value is the group's maximum (ties: all of them),
    else 'min' at the minimum, else ''."""
    w = Window.partitionBy(*by)
    v = F.col(value)
    return df.withColumn("flag", F.when(v == F.max(value).over(w), F.lit("max"))
                         .when(v == F.min(value).over(w), F.lit("min")).otherwise(F.lit("")))


def latex_cells(flagged: DataFrame, value: str = "mean_score") -> DataFrame:
    s = fmt_pct(F.col(value))
    return flagged.withColumn("cell", F.when(F.col("flag") == "max", F.concat(F.lit(f"\\textcolor{{{MAX_COLOUR}}}{{"), s, F.lit("}")))
                              .when(F.col("flag") == "min", F.concat(F.lit(f"\\textcolor{{{MIN_COLOUR}}}{{"), s, F.lit("}")))
                              .otherwise(s))


def latex_rows(cells: DataFrame, row_key: str = "model_id", col_key: str = "condition",
               order: list[str] = CONDITIONS) -> DataFrame:
    """K5: one LaTeX body row per ``row_key``: 'label & c1 & c2 ... \\\\' in ``order``."""
    wide = cells.groupBy(row_key).pivot(col_key, order).agg(F.first("cell"))
    parts = [F.col(row_key)] + [F.coalesce(F.col(c), F.lit("-")) for c in order]
    return wide.select(row_key, F.concat(F.concat_ws(" & ", *parts), F.lit(" \\\\")).alias("latex_row"))


# Fixed value: the layout of the published tables.
TABLE = r"""\begin{table*}[!h]
\centering
\small
\begin{tabular}{@columns}
\toprule
@titles \\
\midrule
@rows
\bottomrule
\end{tabular}
\caption{@caption}
\label{@label}
\end{table*}"""


def latex_table(rows: DataFrame, headers: list[str], caption: str, label: str,
                row_col: str = "latex_row") -> str:
    """K5: the published layout filled from a report frame (one row per model, so it may be collected)."""
    lines = rows.select(row_col).orderBy(row_col).toPandas()[row_col]
    fill = {"@columns": "l".ljust(len(headers), "c"), "@titles": " & ".join(r"\textbf{%s}" % t for t in headers),
            "@rows": "\n".join(lines), "@caption": caption, "@label": label}
    out = TABLE
    for place, text in fill.items():
        out = out.replace(place, text)
    return out


def p_value_rows(tests: DataFrame, pairs: list[str], row_key: str = "model_id", by: list[str] | None = None,
                 p: str = "p_adj") -> DataFrame:
    """K5: one LaTeX row of adjusted p-values per (``by``, ``row_key``), a column per pair in the given order, '-' where untested.

    ``by`` names the columns that tell the report's tables apart (experiment, option); the family that ``p`` was
    corrected over is the caller's, usually the whole report.
    """
    by = by or []
    cells = tests.withColumn("cell", F.concat(F.lit("$"), fmt_sci(F.col(p)), F.lit("$")))
    wide = cells.groupBy(*by, row_key).pivot("pair", pairs).agg(F.first("cell", ignorenulls=True))
    parts = [F.col(row_key)] + [F.coalesce(F.col(f"`{c}`"), F.lit("-")) for c in pairs]
    return wide.select(*by, row_key, F.concat(F.concat_ws(" & ", *parts), F.lit(" \\\\")).alias("latex_row"))
