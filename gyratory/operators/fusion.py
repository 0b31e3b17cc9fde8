"""Multi-camera fusion.

Cameras stay in long form until one groupBy pivots them; the spreads across cameras come out of the same
aggregation. A group is the (at most four) cameras of one time window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyratory.constants import CAMERA_DIRECTIONS, DIRECTIONS, FUSED_FEATURES, TIME_FEATURES
from gyratory.functions.scalars import direction_of, row_mean, safe_ratio

KEY = ["video_ts", "window_idx"]
_SPANS = ["start_time", "end_time", "window_duration"]


def merge_cameras(features: DataFrame, cameras: int = len(CAMERA_DIRECTIONS)) -> DataFrame:
    """One row per window that every camera has, with `{direction}_{feature}` columns."""
    names = [f for f in FUSED_FEATURES if f in features.columns]
    names += [c for c in features.columns if "_lag_" in c or "_rolling_" in c]
    columns = set(features.columns)
    shared = [f"max(`{c}`) FILTER (WHERE camera_id = 1) AS `{c}`" for c in [*_SPANS, *TIME_FEATURES] if c in columns]
    wide = [f"max(`{c}`) FILTER (WHERE _direction = '{d}') AS `{d}_{c}`" for d in DIRECTIONS for c in names]
    spread = [
        "stddev_samp(entry_flow_rate) AS entry_flow_imbalance",
        "var_samp(entry_flow_rate) AS entry_flow_variance",
        "stddev_samp(exit_flow_rate) AS exit_flow_imbalance",
        "stddev_samp(circulating_occupancy_avg) AS occupancy_imbalance",
    ]
    return (
        features.withColumn("_direction", direction_of("camera_id"))
        .filter(F.col("_direction").isNotNull())
        .groupBy(*KEY)
        .agg(F.count(F.lit(1)).alias("_cameras"), *[F.expr(e) for e in (*shared, *wide, *spread)])
        .filter(F.col("_cameras") == cameras)
        .drop("_cameras")
    )


def _over_cameras(feature: str) -> list[Column]:
    return [F.col(f"{d}_{feature}") for d in DIRECTIONS]


def _total(feature: str) -> Column:
    a, b, c, d = _over_cameras(feature)
    return a + b + c + d


def roundabout_totals(df: DataFrame) -> DataFrame:
    """Sums over the cameras (null if any is null), speeds over the known ones, flow balance."""
    speeds = _over_cameras("speed_avg_km_h")
    entry, exit_ = _total("entry_count"), _total("exit_count")
    return df.withColumns(
        {
            "total_entry_count": entry,
            "total_exit_count": exit_,
            "total_entry_flow_rate": _total("entry_flow_rate"),
            "total_exit_flow_rate": _total("exit_flow_rate"),
            "total_circulating_occupancy": _total("circulating_occupancy_avg"),
            "avg_circulating_occupancy": _total("circulating_occupancy_avg") / 4.0,
            "avg_speed_km_h": row_mean(speeds),
            "min_speed_km_h": F.least(*speeds),
            "max_speed_km_h": F.greatest(*speeds),
            "system_flow_balance": safe_ratio(entry - exit_, entry + exit_, 0.0),
        }
    )


def opposite_pairs(df: DataFrame) -> DataFrame:
    """E5: north against south and east against west."""
    out = {}
    for name, a, b in (("NS", "north", "south"), ("EW", "east", "west")):
        x, y = F.col(f"{a}_entry_flow_rate"), F.col(f"{b}_entry_flow_rate")
        out[f"{name}_entry_diff"] = F.abs(x - y)
        out[f"{name}_entry_balance"] = safe_ratio(x - y, x + y, 0.0)
    return df.withColumns(out)


def directional(df: DataFrame) -> DataFrame:
    """The two axes against each other; a through flow is the mean of the two entry counts."""
    n, e, s, w = _over_cameras("entry_flow_rate")
    cn, ce, cs, cw = _over_cameras("entry_count")
    speeds = _over_cameras("speed_avg_km_h")
    return df.withColumns(
        {
            "NS_total_entry": n + s,
            "EW_total_entry": e + w,
            "NS_EW_imbalance": safe_ratio(n + s - (e + w), n + s + (e + w), 0.0),
            "NS_through_flow": (cn + cs) / 2.0,
            "EW_through_flow": (ce + cw) / 2.0,
            "speed_range": F.greatest(*speeds) - F.least(*speeds),
        }
    )


def target_placeholders(df: DataFrame) -> DataFrame:
    """The eight label columns, empty."""
    return df.withColumns(
        {f"{d}_{side}_congestion": F.lit(None).cast("string") for d in DIRECTIONS for side in ("entry", "exit")}
    )


def fuse(features: DataFrame) -> DataFrame:
    """E1-E6 in one go."""
    return directional(opposite_pairs(roundabout_totals(merge_cameras(features))))


def alignment_check(features: DataFrame, rtol: float = 1e-3, atol: float = 1e-8) -> DataFrame:
    """Windows per camera, and how many start off the first camera's window of the same index."""
    reference = features.filter("camera_id = 1").select(*KEY, F.col("start_time").alias("_reference"))
    gap = F.abs(F.col("_reference") - F.col("start_time"))
    return (
        features.select(*KEY, "camera_id", "start_time")
        .join(reference, KEY, "left")
        .groupBy("video_ts", "camera_id")
        .agg(
            F.count(F.lit(1)).alias("windows"),
            F.count_if(F.col("_reference").isNull()).alias("without_reference"),
            F.count_if(gap > atol + rtol * F.abs("start_time")).alias("misaligned"),
        )
    )


def camera_interactions(df: DataFrame) -> DataFrame:
    """First camera's entries less the third's; second camera's exit flow per fourth's."""
    return df.withColumns(
        {
            "cam1_cam3_entry_diff": F.col("north_entry_count") - F.col("south_entry_count"),
            "cam2_cam4_flow_ratio": F.col("east_exit_flow_rate") / (F.col("west_exit_flow_rate") + 1),
        }
    )
