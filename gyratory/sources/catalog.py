"""Queries over file listings and label timestamps (A9-A13). A listing has path, size and seq (list order)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyratory.constants import VIDEO_ENDINGS
from gyratory.functions.scalars import extract_timestamp

ALL = "(all)"


def _camera(cameras: Sequence[str]) -> Column:
    """Name of the first camera that occurs in the path."""
    out = F.lit(None).cast("string")
    for name in reversed(cameras):
        out = F.when(F.contains("path", F.lit(name)), name).otherwise(out)
    return out


def _is_video() -> Column:
    out = F.lit(False)
    for ending in VIDEO_ENDINGS:
        out = out | F.contains(F.lower("path"), F.lit(ending))
    return out


def catalog_size(listing: DataFrame, cameras: Sequence[str], camera: str | None = None, prefix: str | None = None) -> DataFrame:
    """Files and bytes per camera and in total; empty files do not count, the total includes other files."""
    rows = listing.filter("size > 0")
    if camera:
        rows = rows.filter(F.contains("path", F.lit(camera)))
    if prefix:
        rows = rows.filter(F.startswith("path", F.lit(prefix)))
    cam = F.col("_camera")
    sums = rows.withColumn("_camera", _camera(cameras)).agg(
        *[F.count_if(cam == c).alias(f"n{i}") for i, c in enumerate(cameras)],
        *[F.coalesce(F.sum(F.when(cam == c, F.col("size"))), F.lit(0)).alias(f"b{i}") for i, c in enumerate(cameras)],
        F.count(F.lit(1)).alias("n_all"), F.coalesce(F.sum("size"), F.lit(0)).alias("b_all"),
    )
    cells = [
        F.struct(F.lit(c).alias("camera"), F.col(f"n{i}").alias("files"), F.col(f"b{i}").alias("bytes"))
        for i, c in enumerate(cameras)
    ]
    total = F.struct(F.lit(ALL).alias("camera"), F.col("n_all").alias("files"), F.col("b_all").alias("bytes"))
    return sums.select(F.explode(F.array(*cells, total)).alias("c")).select("c.*")


def catalog_filter(
    listing: DataFrame, camera: str | None = None, start: str | None = None, end: str | None = None
) -> DataFrame:
    """A10: video files of a camera and date range, both ends included; a path without a date passes."""
    rows = listing.filter(_is_video())
    if camera:
        rows = rows.filter(F.contains("path", F.lit(camera)))
    day = F.nullif(F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    if start:
        rows = rows.filter(day.isNull() | (day >= start))
    if end:
        rows = rows.filter(day.isNull() | (day <= end))
    return rows


def complete_video_sets(listing: DataFrame, cameras: Sequence[str]) -> DataFrame:
    """Per timestamp the video of every camera (the last listed wins) and whether all are there."""
    rows = listing.filter(_is_video()).withColumns({"_camera": _camera(cameras), "video_timestamp": extract_timestamp("path")})
    cam = F.col("_camera")
    rows = rows.filter(cam.isNotNull() & F.col("video_timestamp").isNotNull())
    paths = [F.max_by("path", F.when(cam == c, F.col("seq"))).alias(f"path_{i}") for i, c in enumerate(cameras, 1)]
    found = sum((F.col(f"path_{i}").isNotNull().cast("int") for i in range(2, len(cameras) + 1)),
                F.col("path_1").isNotNull().cast("int"))
    return rows.groupBy("video_timestamp").agg(*paths).withColumn("cameras", found).withColumn(
        "complete", F.col("cameras") == len(cameras)
    )


def select_timestamps(
    labels: DataFrame, start: str | None = None, end: str | None = None, limit: int | None = None
) -> DataFrame:
    """Distinct known timestamps in a date range (inclusive), in order, the first `limit`."""
    rows = labels.select("video_timestamp").filter("video_timestamp is not null").distinct()
    day = F.substring("video_timestamp", 1, 10)
    if start:
        rows = rows.filter(day >= start)
    if end:
        rows = rows.filter(day <= end)
    return rows if limit is None else rows.orderBy("video_timestamp").limit(limit)


def pending_timestamps(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Timestamps without a result yet."""
    return wanted.join(done, "video_timestamp", "left_anti")
