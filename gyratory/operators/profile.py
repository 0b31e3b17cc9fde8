"""Profiling and reporting queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from gyratory.constants import DIRECTIONS
from gyratory.functions import ordered
from gyratory.functions.gram import correlation_matrix
from gyratory.functions.quantiles import exact_quantiles
from gyratory.functions.scalars import severity

CAMERA_METRICS = ["entry_count", "exit_count", "entry_flow_rate", "circulating_occupancy_avg"]


def missing_values(df: DataFrame, top: int | None = None) -> DataFrame:
    """Columns with nulls, most first."""
    names = df.columns
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    long = counts.unpivot(["_n"], names, "column_name", "missing").filter("missing > 0").select(
        "column_name", "missing", (F.col("missing") * 100.0 / F.col("_n")).alias("percent")
    )
    return long if top is None else long.orderBy(F.desc("missing"), "column_name").limit(top)


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, minimum, exact quartiles and maximum, two decimals; one row of each column reaches the driver."""
    columns = list(columns)
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    kinds = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    whole = df.agg(*[f(F.col(c).cast("double")).alias(f"{k}|{i}") for i, c in enumerate(columns) for k, f in kinds.items()]).first()
    rows = [(c, whole[f"count|{i}"], *(whole[f"{k}|{i}"] for k in ("mean", "std", "min")), *quartiles[i], whole[f"max|{i}"]) for i, c in enumerate(columns)]
    names = ["mean", "std", "min", "q25", "q50", "q75", "max"]
    stats = df.sparkSession.createDataFrame(rows, "feature string, count long, " + ", ".join(f"{n} double" for n in names))
    return stats.select("feature", "count", *[F.round(c, 2).alias(c) for c in names])


def hour_distribution(df: DataFrame) -> DataFrame:
    """I4: windows per hour of day, with the share of rush-hour windows overall."""
    counts = df.groupBy("hour_of_day").agg(F.count(F.lit(1)).alias("n"), F.sum("is_rush_hour").alias("_rush"))
    whole = Window.partitionBy()  # at most 24 rows
    share = F.sum("_rush").over(whole) * 100.0 / F.sum("n").over(whole)
    return counts.withColumn("rush_percent", share).drop("_rush")


def flow_balance(df: DataFrame) -> DataFrame:
    """Entries, exits, net flow and mean rates."""
    return df.agg(
        F.sum("total_entry_count").alias("total_entries"), F.sum("total_exit_count").alias("total_exits"),
        (F.sum("total_entry_count") - F.sum("total_exit_count")).alias("net_flow"),
        F.avg("total_entry_flow_rate").alias("avg_entry_rate"), F.avg("total_exit_flow_rate").alias("avg_exit_rate"),
    )


def camera_comparison(df: DataFrame, metrics: Sequence[str] = CAMERA_METRICS) -> DataFrame:
    """Mean of each metric per direction, from the wide table in one pass."""
    means = df.agg(*[F.avg(f"{d}_{m}").alias(f"{m}|{d}") for m in metrics for d in DIRECTIONS])
    long = means.unpivot([], means.columns, "_k", "mean_value")
    return long.select(
        F.split_part("_k", F.lit("|"), F.lit(1)).alias("metric"),
        F.split_part("_k", F.lit("|"), F.lit(2)).alias("direction"), "mean_value",
    )


def directional_asymmetry(df: DataFrame) -> DataFrame:
    """I7"""
    return df.agg(*[F.avg(c).alias(c) for c in ("NS_total_entry", "EW_total_entry", "NS_EW_imbalance")])


def target_distribution(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """I8: value counts per target."""
    return (
        df.unpivot([], list(targets), "target", "label").filter("label is not null")
        .groupBy("target", "label").agg(F.count(F.lit(1)).alias("n"))
    )


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns that hold numbers."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def correlations(df: DataFrame, features: Sequence[str] | None, target: str) -> DataFrame:
    """Absolute correlation of every feature, of all numeric columns if none are named, with the severity of a target label."""
    features = numeric_columns(df) if features is None else list(features)
    # the matrix has a pair once, the first of the columns first
    pairs = correlation_matrix(df.select(*features, severity(target).cast("double").alias("_severity")), [*features, "_severity"])
    return pairs.filter("b = '_severity'").select(F.col("a").alias("feature"), F.abs("correlation").alias("correlation"))


def top_correlations(df: DataFrame, features: Sequence[str] | None, target: str, top: int = 10) -> DataFrame:
    """The strongest of them; equal to nine digits, the first by name."""
    found = correlations(df, features, target).filter("correlation is not null")
    return found.orderBy(F.desc(F.round("correlation", 9)), "feature").limit(top)


def gap_analysis(df: DataFrame, ts: str = "video_ts") -> DataFrame:
    """Range, distinct timestamps and the gaps between consecutive rows in time.

    Rows that share a timestamp have gap 0 between them, so only distinct timestamps are compared: first
    inside each day, then across days on the (one row per day) table of first and last timestamps.
    """
    stamps = df.groupBy(ts).agg(F.count(F.lit(1)).alias("_n")).withColumn("_day", F.date_trunc("day", ts))

    def gap(after: Column, before: Column) -> Column:
        return (F.unix_micros(after) - F.unix_micros(before)) / 1e6

    inside = ordered.framed(
        stamps, ["_day"], [ts], 1, 0, lambda frame, w: frame.withColumn("_gap", gap(F.col(ts), F.lag(ts).over(w)))
    )
    days = stamps.groupBy("_day").agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    across = days.withColumn("_gap", gap(F.col("_first"), F.lag("_last").over(Window.orderBy("_day"))))
    gaps = (
        inside.select("_gap", F.lit(1).cast("bigint").alias("_n"))
        .unionByName(across.select("_gap", F.lit(1).cast("bigint").alias("_n")))
        .unionByName(stamps.select(F.lit(0.0).alias("_gap"), (F.col("_n") - 1).alias("_n")))
        .filter((F.col("_n") > 0) & F.col("_gap").isNotNull())
        .groupBy("_gap").agg(F.sum("_n").alias("_n"))
    )
    stats = gaps.agg(
        F.min("_gap").alias("min_gap"), F.max("_gap").alias("max_gap"),
        F.max_by("_gap", F.struct("_n", -F.col("_gap"))).alias("most_common_gap"),
    )
    span = stamps.agg(
        F.min(ts).alias("earliest"), F.max(ts).alias("latest"), F.sum("_n").alias("records"),
        F.count(F.lit(1)).alias("distinct_timestamps"),
    )
    both = span.unionByName(stats, allowMissingColumns=True)  # one row each, folded into one
    return both.agg(*[F.max(c).alias(c) for c in both.columns]).withColumn("range_seconds", gap(F.col("latest"), F.col("earliest")))


def daily_counts(summary: DataFrame) -> DataFrame:
    """Vehicles per date."""
    return summary.groupBy(F.to_date("video_ts").alias("date")).agg(F.sum("total_vehicles_tracked").alias("vehicles"))


def camera_totals(summary: DataFrame) -> DataFrame:
    """Vehicles and videos per camera, and over all cameras."""
    return summary.rollup("camera_id").agg(
        F.sum("total_vehicles_tracked").alias("vehicles"), F.count(F.lit(1)).alias("videos"),
        F.avg("total_vehicles_tracked").alias("mean_vehicles"), F.countDistinct("camera_id").alias("cameras"),
    )


def prefix_unpivot(df: DataFrame, keys: Sequence[str], prefixes: Sequence[str]) -> DataFrame:
    """The columns of each prefix as (family, key, value) rows; a column belongs to the longest prefix that it starts with."""
    names = [c for c in df.columns if any(c.startswith(p) for p in prefixes)]
    cast = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in names])
    long = cast.unpivot(list(keys), names, "_c", "value")
    # one entry per column of the table, known from its schema
    family = {c: max((p for p in prefixes if c.startswith(p)), key=len) for c in names}
    known = F.create_map(*[F.lit(x) for c in names for x in (c, family[c])])[F.col("_c")]
    return long.withColumn("family", known).select(*keys, "family", F.expr("substring(_c, length(family) + 1)").alias("key"), "value")


def duration_histogram(vehicles: DataFrame, bins: int = 20) -> DataFrame:
    """Vehicles per visible-duration bin; the last bin includes the maximum."""
    visible = vehicles.select((F.col("last_seen_time") - F.col("first_seen_time")).alias("_d"))
    bounds = visible.agg(F.struct(F.min("_d").alias("low"), F.max("_d").alias("high"))).scalar()
    low, high = bounds["low"], bounds["high"]
    width = (high - low) / bins
    spot = F.when(width > 0, F.least(F.floor((F.col("_d") - low) / width), F.lit(bins - 1))).otherwise(0)
    return visible.groupBy(spot.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("vehicles"))


def mean_by(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Group means."""
    return df.groupBy(key).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])


def high_traffic(summary: DataFrame, camera: int, more_than: int = 50) -> DataFrame:
    """Busy videos of one camera."""
    return summary.filter((F.col("camera_id") == camera) & (F.col("total_vehicles_tracked") > more_than))


def dataset_stats(df: DataFrame) -> DataFrame:
    """I16: rows, columns, distinct timestamps, cameras and phases."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("video_ts").alias("timestamps"),
        F.countDistinct("camera_id").alias("cameras"), F.countDistinct("cycle_phase").alias("phases"),
    ).withColumn("n_columns", F.lit(len(df.columns)))


def class_totals(summary: DataFrame) -> DataFrame:
    """Vehicles per class over all videos."""
    long = prefix_unpivot(summary, ["video_ts", "camera_id"], ["vehicle_class_"])
    return long.groupBy("key").agg(F.sum("value").cast("bigint").alias("vehicles"))
