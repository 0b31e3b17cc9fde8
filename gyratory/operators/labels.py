"""Time-interval joins with human labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyratory.constants import DIRECTIONS
from gyratory.functions.ordered import checked_broadcast
from gyratory.functions.scalars import decode_congestion, severity

WINDOW = ["video_ts", "window_idx"]
LABEL_SUFFIXES = ("_congestion", "_label_count", "_signaling")


def with_bounds(windows: DataFrame) -> DataFrame:
    """Absolute window bounds: video time plus offsets in seconds."""

    def at(offset: str) -> Column:
        return F.timestamp_micros(F.unix_micros("video_ts") + (F.col(offset) * 1_000_000).cast("bigint"))

    return windows.withColumns({"window_start": at("start_time"), "window_end": at("end_time")})


def by_direction(windows: DataFrame) -> DataFrame:
    """One row per window and approach (four of each)."""
    return windows.withColumn("direction", F.explode(F.array(*[F.lit(d) for d in DIRECTIONS])))


def _nodes(start: str, end: str, size: Column) -> Column:
    """Every node of that size, in microseconds, that [start, end) touches."""
    first = F.floor(F.unix_micros(start) / size)
    return F.explode(F.sequence(first, F.greatest(first, F.floor((F.unix_micros(end) - 1) / size))))


def interval_nodes(intervals: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """`intervals` with `_level` and `_node`: one or two rows of each.

    Nodes of a level are width * 2^level seconds long. An interval lies in the lowest level whose nodes are no shorter than itself, so it touches
    two of them at most, whatever its length.
    """
    micros = width * 1_000_000
    length = (F.unix_micros(end) - F.unix_micros(start)) / micros
    leveled = intervals.withColumn("_level", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(length, F.lit(1.0))))).cast("int"))
    return leveled.withColumn("_node", _nodes(start, end, _size(width)))


def _size(width: int) -> Column:
    return F.call_function("shiftleft", F.lit(width * 1_000_000).cast("long"), F.col("_level"))


def overlap_join(windows: DataFrame, labels: DataFrame, width: int, how: str = "left") -> DataFrame:
    """windows and labels of the same direction whose half-open intervals intersect.

    Labels lie in one or two nodes of a dyadic tree over time. A window looks its own nodes up in every level that has labels, at most one for each
    doubling of the longest label. So the join is an equi-join on (direction, level, node) with the exact overlap test as a filter, and a pair
    that shares two nodes is kept only in the first one both sides touch. The pairs come from an inner join, which adaptive execution may split
    where a node is hot.
    """
    lab = interval_nodes(labels, "datetime_start", "datetime_end", width)
    # one array of at most 64 levels
    levels = lab.agg(F.array_sort(F.collect_set("_level")).alias("levels")).scalar()
    w = windows.withColumn("_levels", levels).withColumn("_level", F.explode("_levels")).drop("_levels")
    w = w.withColumn("_node", _nodes("window_start", "window_end", _size(width)))
    first = F.greatest(F.floor(F.unix_micros("window_start") / _size(width)), F.floor(F.unix_micros("datetime_start") / _size(width)))
    shared = [c for c in labels.columns if c in windows.columns and c != "direction"]
    pairs = (
        w.join(lab.drop(*shared), ["direction", "_level", "_node"])
        .filter((F.col("datetime_start") < F.col("window_end")) & (F.col("datetime_end") > F.col("window_start")))
        .filter(F.col("_node") == first)
        .drop("_level", "_node")
    )
    if how == "inner":
        return pairs
    # Windows without labels are added, not outer-joined: a window with very many labels then never has to
    # meet all of them in one task.
    key = [*WINDOW, "direction"]
    alone = windows.join(pairs.select(*key).distinct(), key, "left_anti")
    return pairs.unionByName(alone, allowMissingColumns=True)


def label_aggregates(aggregation: str) -> list[Column]:
    """How the labels of a window become one label.

    mode: most frequent, alphabetically first on ties; max: worst; last: latest start.
    """
    if aggregation not in ("mode", "max", "last"):
        raise ValueError(f"unknown aggregation: {aggregation}")

    def one(column: str) -> Column:
        if aggregation == "mode":
            return F.mode(column, deterministic=True)
        if aggregation == "max":
            return decode_congestion(F.max(severity(column)))
        return F.max_by(column, F.struct("datetime_start", "label_id"))

    return [
        one("congestion_enter_rating").alias("entry_congestion"),
        one("congestion_exit_rating").alias("exit_congestion"),
        F.count("label_id").alias("label_count"),
        F.mode("signaling", deterministic=True).alias("signaling"),
    ]


def window_labels(windows: DataFrame, labels: DataFrame, width: int, aggregation: str = "mode") -> DataFrame:
    """One aggregated label per window and direction that has any."""
    pairs = overlap_join(by_direction(windows), labels, width, "inner")
    return pairs.groupBy(*WINDOW, "direction").agg(*label_aggregates(aggregation))


def window_videos(windows: DataFrame, labels: DataFrame, width: int) -> DataFrame:
    """the label records of a window by source file; counted, not listed, so a busy window stays small."""
    pairs = overlap_join(by_direction(windows), labels, width, "inner")
    return pairs.groupBy(*WINDOW, "direction", "videos").agg(F.count(F.lit(1)).alias("records"))


def _widen(per_direction: DataFrame, keys: list[str]) -> DataFrame:
    return per_direction.groupBy(*keys).agg(
        *[
            F.expr(f"max({c}) FILTER (WHERE direction = '{d}') AS {d}_{c}")
            for d in DIRECTIONS
            for c in ("entry_congestion", "exit_congestion", "label_count", "signaling")
        ]
    )


def _attach(features: DataFrame, wide: DataFrame, keys: list[str]) -> DataFrame:
    return features.join(wide, keys, "left").fillna(0, [f"{d}_label_count" for d in DIRECTIONS])


def attach_labels(features: DataFrame, labels: DataFrame, width: int, aggregation: str = "mode") -> DataFrame:
    """label columns of all four directions for every window, empty where no label overlaps."""
    bounds = with_bounds(features.select(*WINDOW, "start_time", "end_time"))
    return _attach(features, _widen(window_labels(bounds, labels, width, aggregation), WINDOW), WINDOW)


def hour_match_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    """labels by direction and hour of day alone, always by mode; at most 24 rows to look up."""
    by_hour = labels.withColumn("hour_of_day", F.hour("datetime_start")).groupBy("direction", "hour_of_day")
    wide = _widen(by_hour.agg(*label_aggregates("mode")), ["hour_of_day"])
    return _attach(features, checked_broadcast(wide, 24), ["hour_of_day"])


def containment_join(windows: DataFrame, labels: DataFrame) -> DataFrame:
    """F8: labels of the same video and camera that start inside the window.

    A label start lies in exactly one window of its video, so the window index is computed from the
    window length of the video instead of searched.
    """
    spans = windows.groupBy("video_ts", "camera_id").agg(F.max("window_duration").alias("_w"))
    offset = (F.unix_micros("datetime_start") - F.unix_micros("video_ts")) / 1e6
    placed = labels.join(spans, ["video_ts", "camera_id"]).withColumn(
        "window_idx", F.floor(offset / F.col("_w")).cast("int")
    )
    return placed.drop("_w").join(
        windows.select("video_ts", "camera_id", "window_idx", "start_time", "end_time"),
        ["video_ts", "camera_id", "window_idx"],
    )


def join_features_on_timestamp(rows: DataFrame, features: DataFrame, window_idx: int | None = None) -> DataFrame:
    """every row with every window of its video; window_idx keeps one window per video."""
    side = features if window_idx is None else features.filter(F.col("window_idx") == window_idx)
    shared = [c for c in side.columns if c in rows.columns and c != "video_ts"]
    return rows.join(side.drop(*shared), "video_ts", "left")


def add_test_metadata(features: DataFrame, segments: DataFrame, columns: list[str]) -> DataFrame:
    """distinct metadata rows of a video beside its windows."""
    meta = segments.select("video_ts", *columns).dropDuplicates()
    return features.join(meta, "video_ts", "left")


def label_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.endswith("_congestion")]


def coverage_report(df: DataFrame) -> DataFrame:
    """share of filled cells per label column and overall, and the share of each class."""
    long = df.unpivot([], label_columns(df), "column_name", "label")
    counts = long.groupBy("column_name", "label").agg(F.count(F.lit(1)).alias("n"))
    per_column = counts.groupBy("column_name").agg(
        F.sum("n").alias("total"), F.sum(F.when(F.col("label").isNotNull(), F.col("n")).otherwise(0)).alias("filled")
    )
    overall = per_column.agg(F.sum("total").alias("total"), F.sum("filled").alias("filled")).select(
        F.lit("(all)").alias("column_name"), "total", "filled"
    )
    coverage = per_column.unionByName(overall).select(
        "column_name", F.lit("(any)").alias("label"), F.col("filled").alias("n"),
        F.when(F.col("total") > 0, F.col("filled") * 100.0 / F.col("total")).alias("percent"),
    )
    classes = (
        counts.filter("label is not null")
        .join(per_column, "column_name")
        .select("column_name", "label", "n", (F.col("n") * 100.0 / F.col("filled")).alias("percent"))
    )
    return coverage.unionByName(classes)


def null_diagnostics(raw: DataFrame, processed: DataFrame) -> DataFrame:
    """null shares before and after processing, mean label count and windows without labels."""

    def nulls(df: DataFrame, columns: list[str], stage: str) -> DataFrame:
        long = df.unpivot([], columns, "column_name", "label")
        return long.groupBy("column_name").agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(F.col("label").isNull()).alias("nulls"),
            (F.count_if(F.col("label").isNull()) * 100.0 / F.count(F.lit(1))).alias("percent"),
        ).withColumn("stage", F.lit(stage))

    counts = [f"{d}_label_count" for d in DIRECTIONS if f"{d}_label_count" in processed.columns]
    labels = processed.unpivot([], counts, "column_name", "n").groupBy("column_name").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("n") == 0).alias("nulls"), F.avg("n").alias("percent")
    ).withColumn("stage", F.lit("label_count"))
    return (
        nulls(raw, ["congestion_enter_rating", "congestion_exit_rating"], "raw")
        .unionByName(nulls(processed, label_columns(processed), "processed"))
        .unionByName(labels)
        .withColumnsRenamed({"rows": "n_rows", "nulls": "n_empty", "percent": "percent_or_mean"})
    )


def relabel(features: DataFrame, labels: DataFrame, width: int, aggregation: str = "mode") -> DataFrame:
    """drop every label column and attach fresh ones."""
    return attach_labels(features.drop(*[c for c in features.columns if c.endswith(LABEL_SUFFIXES)]), labels, width, aggregation)


def id_set_diff(ours: DataFrame, wanted: DataFrame, column: str = "ID") -> DataFrame:
    """ids missing from ours and ids that do not belong."""
    a, b = ours.select(column), wanted.select(column)
    missing = b.join(a, column, "left_anti").distinct().withColumn("side", F.lit("missing"))
    extra = a.join(b, column, "left_anti").distinct().withColumn("side", F.lit("extra"))
    return missing.unionByName(extra)
