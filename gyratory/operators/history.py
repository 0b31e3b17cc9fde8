"""History of the congestion state per series.

A series is a camera side (view, ID type) ordered by segment. The formulas: slope is the least-squares
slope of the severity on the row number over the last rows; acceleration is the slope of the newer half
less the slope of the older half; persistence counts the rows since the state last changed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyratory.functions import ordered

SERIES = ["view_label", "ID_type"]
ORDER = ["time_segment_id", "ID"]


def trends(df: DataFrame, span: int = 15, half: int = 7, short: int = 5, value: str = "severity") -> DataFrame:
    """Slope, acceleration, rolling statistics and change flags in one window pass."""

    def step(frame: DataFrame, w) -> DataFrame:
        numbered = frame.withColumn("_row", F.row_number().over(w).cast("double"))
        v, x = F.col(value).cast("double"), F.col("_row")
        full = w.rowsBetween(1 - span, 0)
        out = {
            "trend_slope": F.regr_slope(v, x).over(full),
            "acceleration": F.regr_slope(v, x).over(w.rowsBetween(1 - half, 0))
            - F.regr_slope(v, x).over(w.rowsBetween(1 - 2 * half, -half)),
        }
        for size in (short, span):
            recent = w.rowsBetween(1 - size, 0)
            out[f"mean_{size}"] = F.avg(v).over(recent)
            out[f"max_{size}"] = F.max(value).over(recent)
            out[f"min_{size}"] = F.min(value).over(recent)
            out[f"volatility_{size}"] = F.stddev_samp(v).over(recent)
        before = F.lag(value).over(w)
        out["changed"] = (F.col(value) != before).cast("int")
        out["worsening"] = (F.col(value) > before).cast("int")
        out["improving"] = (F.col(value) < before).cast("int")
        return numbered.withColumns(out).drop("_row")

    return ordered.framed(df, SERIES, ORDER, max(span, 2 * half), 0, step)


def persistence(df: DataFrame, value: str = "severity") -> DataFrame:
    """Rows since the state last changed, 0 on the row of the change and at the start of a series."""

    def step(frame: DataFrame, w) -> DataFrame:
        before = F.lag(F.coalesce(F.col(value), F.lit(-1))).over(w)
        same = before == F.coalesce(F.col(value), F.lit(-1))
        return frame.withColumn("_new", ~F.coalesce(same, F.lit(False)))

    numbered = ordered.position(df, SERIES, ORDER, "_row")
    marked = ordered.framed(numbered, SERIES, ["_row"], 1, 0, step, "_row")
    marked = marked.withColumn("_mark", F.when(F.col("_new"), F.col("_row")))
    filled = ordered.running_last(marked, SERIES, ["_row"], "_mark", "_since", "_row")
    return filled.withColumn("persistence", F.col("_row") - F.col("_since")).drop("_row", "_mark", "_since", "_new")


def direction_imbalance(rows: DataFrame, enter: str, leave: str, keys: Sequence[str]) -> DataFrame:
    """Severity of entering less severity of leaving."""
    return rows.select(*keys, (F.col(enter) - F.col(leave)).alias("direction_imbalance"))
