"""Sequences, horizons and leakage-free splits over window tables.

The ordered windows here run over rows that are already one per time window and video, so a day or a video
has at most a few thousand of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyratory.constants import DIRECTIONS
from gyratory.functions import ordered
from gyratory.operators.prep import known

ENTRY_TARGETS = [f"{d}_entry_congestion" for d in DIRECTIONS]
ALL_TARGETS = [f"{d}_{side}_congestion" for d in DIRECTIONS for side in ("entry", "exit")]


def sequences(
    df: DataFrame, features: Sequence[str], targets: Sequence[str] = ENTRY_TARGETS, size: int = 6, stride: int = 1,
    min_valid: int = 3, max_gap: int = 600,
) -> DataFrame:
    """Full runs of `size` windows inside one date, with the targets of the last window.

    Columns: sequence_id (numbered over dates), date, start/end timestamp, n_windows, valid_targets,
    max_time_gap_sec, x (array of window vectors) and y (array of labels).
    """
    rows = df.withColumn("date", F.to_date("video_ts"))
    day = Window.partitionBy("date").orderBy("video_ts", "window_idx")
    ahead = day.rowsBetween(0, size - 1)
    gap = (F.unix_micros("video_ts") - F.unix_micros(F.lag("video_ts").over(day))) / 1e6
    vector = F.array(*[F.col(c).cast("double") for c in features])
    labels = F.array(*[F.col(c) for c in targets])
    built = rows.withColumns(
        {"_gap": gap, "_valid": known(targets), "_x": vector, "_y": labels, "_i": F.row_number().over(day) - 1}
    ).withColumns(
        {
            "_n": F.count(F.lit(1)).over(ahead),
            "start_timestamp": F.col("video_ts"),
            "end_timestamp": F.last("video_ts").over(ahead),
            "max_time_gap_sec": F.coalesce(F.max("_gap").over(day.rowsBetween(1, size - 1)), F.lit(0.0)),
            "valid_targets": F.last("_valid").over(ahead),
            "x": F.collect_list("_x").over(ahead),
            "y": F.last("_y").over(ahead),
        }
    )
    kept = built.filter(
        (F.col("_n") == size) & (F.col("_i") % stride == 0) & (F.col("max_time_gap_sec") <= max_gap)
        & (F.col("valid_targets") >= min_valid)
    )
    per_day = kept.groupBy("date").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    per_day = per_day.withColumn("_start", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows")
    inside = F.row_number().over(Window.partitionBy("date").orderBy("_i")) - 1
    return kept.join(per_day, "date").select(
        (F.col("_start") + inside).alias("sequence_id"), "date", "start_timestamp", "end_timestamp",
        F.lit(size).alias("n_windows"), "valid_targets", "max_time_gap_sec", "x", "y",
    )


def sequence_cells(seq: DataFrame, features: Sequence[str]) -> DataFrame:
    """(sequence_id, step, feature, value) rows of the sequence tensors."""
    names = F.array(*[F.lit(f) for f in features])
    return (
        seq.select("sequence_id", F.posexplode("x").alias("step", "_v"))
        .select("sequence_id", "step", F.posexplode("_v").alias("_f", "value"))
        .select("sequence_id", "step", names[F.col("_f")].alias("feature"), "value")
    )


def _share(position: Column, total: Column, fraction: float) -> Column:
    return position <= F.floor(total * F.lit(fraction))


def temporal_split(seq: DataFrame, test: float = 0.2) -> DataFrame:
    """The first part by end time trains, the rest tests; column `part`."""
    rows = ordered.chronological_position(seq, "end_timestamp", ["sequence_id"], "_pos", "_total")
    part = F.when(_share(F.col("_pos"), F.col("_total"), 1 - test), "train").otherwise("test")
    return rows.withColumn("part", part).drop("_pos", "_total")


def embargo_sequences(
    df: DataFrame, features: Sequence[str], targets: Sequence[str] = ALL_TARGETS,
    inputs: int = 3, embargo: int = 1, outputs: int = 1,
) -> DataFrame:
    """Per video, `inputs` windows side by side and the targets after the embargo.

    Rows near the end, for which the whole span does not fit, are left out.
    """
    w = Window.partitionBy("video_ts").orderBy("window_idx")
    ahead = inputs + embargo
    cols = {f"{c}_t{k}": F.lead(c, k).over(w) for c in features for k in range(inputs)}
    cols |= {f"y_{t}": F.lead(t, ahead).over(w) for t in targets}
    cols |= {
        "input_start_time": F.col("start_time"),
        "input_end_time": F.lead("end_time", inputs - 1).over(w),
        "output_start_time": F.lead("start_time", ahead).over(w),
        "output_end_time": F.lead("end_time", ahead).over(w),
        "_fits": F.lead("window_idx", ahead + outputs - 1).over(w).isNotNull(),
    }
    return df.withColumns(cols).filter("_fits").select(
        "video_ts", "window_idx", *[c for c in cols if c != "_fits"]
    )


def recent_aggregates(df: DataFrame, features: Sequence[str], span: int = 3) -> DataFrame:
    """Current value, mean, deviation, momentum, acceleration, minimum and maximum of the last windows."""
    w = Window.partitionBy("video_ts").orderBy("window_idx")
    recent = w.rowsBetween(1 - span, 0)
    out = {}
    for c in features:
        before, first = F.lag(c, 1).over(w), F.lag(c, span - 1).over(w)
        second = F.lag(c, span - 2).over(w)
        out |= {
            f"current_{c}": F.col(c),
            f"avg_15min_{c}": F.avg(c).over(recent),
            f"std_15min_{c}": F.stddev_samp(c).over(recent),
            f"momentum_{c}": F.col(c) - first,
            f"accel_{c}": (F.lag(c, span - 3).over(w) - second if span > 3 else F.col(c) - before) - (second - first),
            f"min_15min_{c}": F.min(c).over(recent),
            f"max_15min_{c}": F.max(c).over(recent),
        }
    context = [c for c in ("hour_of_day", "is_rush_hour", "day_of_week", "is_weekend") if c in df.columns]
    full = F.count(F.lit(1)).over(recent) == span
    return (
        df.withColumns(out).withColumn("_full", full).filter("_full")
        .select("video_ts", "window_idx", *context, *out)
    )


def horizon_targets(
    df: DataFrame, steps: Sequence[int] = (3, 4, 5, 6, 7, 8), targets: Sequence[str] = ALL_TARGETS
) -> DataFrame:
    """Labels k windows ahead, `{target}_t{k}`."""
    w = Window.partitionBy("video_ts").orderBy("window_idx")
    return df.withColumns({f"{t}_t{k}": F.lead(t, k).over(w) for t in targets for k in steps})


def split_three_ways(df: DataFrame, train: float = 0.6, validation: float = 0.8) -> DataFrame:
    """Chronological 60/20/20 split by row."""
    rows = ordered.chronological_position(df, "video_ts", ["window_idx"], "_pos", "_total")
    return _three_ways(rows, train, validation)


def group_split(df: DataFrame, train: float = 0.6, validation: float = 0.8) -> DataFrame:
    """The same split by whole videos, so that no video is cut."""
    videos = df.select("video_ts").distinct()
    parts = _three_ways(ordered.chronological_position(videos, "video_ts", ["video_ts"], "_pos", "_total"), train, validation)
    return df.join(parts, "video_ts")


def _three_ways(rows: DataFrame, train: float, validation: float) -> DataFrame:
    pos, total = F.col("_pos"), F.col("_total")
    part = F.when(_share(pos, total, train), "train").when(_share(pos, total, validation), "validation").otherwise("test")
    return rows.withColumn("part", part).drop("_pos", "_total")


def leave_one_day_out(df: DataFrame) -> DataFrame:
    """Fold number = rank of the date; only the distinct dates are ranked."""
    rows = df.withColumn("date", F.to_date("video_ts"))
    days = rows.select("date").distinct().withColumn("fold", F.row_number().over(Window.orderBy("date")))
    return rows.join(days, "date")


def daytype_split(df: DataFrame, train: float = 0.8) -> DataFrame:
    """Weekdays and weekends each split in time."""
    typed = df.withColumn("day_type", F.when(F.weekday("video_ts") >= 5, "weekend").otherwise("weekday"))
    rows = ordered.chronological_position(typed, "video_ts", ["window_idx"], "_pos", "_total", ["day_type"])
    part = F.when(_share(F.col("_pos"), F.col("_total"), train), "train").otherwise("test")
    return rows.withColumn("part", part).drop("_pos", "_total")
