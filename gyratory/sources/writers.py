"""Sinks (A7, A8, A14)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyratory.functions.scalars import TIMESTAMP_FORMAT, parse_video_ts


def write_features(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One partition per video timestamp; only the timestamps written are replaced.

    The rebalance hint merges small and splits large partitions before the write.
    """
    stamped = df.withColumn("video_timestamp", F.date_format("video_ts", TIMESTAMP_FORMAT)).drop("video_ts")
    writer = (
        stamped.hint("rebalance", F.col("video_timestamp")).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("video_timestamp")
    )
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def combine_results(spark: SparkSession, path: str, timestamps: DataFrame | None = None) -> DataFrame:
    """Results of all (or the listed) timestamps in one scan; timestamps without result are skipped."""
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    rows = rows.withColumn("video_timestamp", F.col("video_timestamp").cast("string"))
    rows = rows.withColumn("video_ts", parse_video_ts("video_timestamp"))
    if timestamps is not None:
        rows = rows.join(timestamps.select("video_timestamp").distinct(), "video_timestamp", "left_semi")
    return rows


def written_timestamps(spark: SparkSession, path: str) -> DataFrame:
    """Timestamps that already have a result."""
    return spark.read.parquet(path).select(F.col("video_timestamp").cast("string").alias("video_timestamp")).distinct()


def write_sequences(split: DataFrame, path: str, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Sequences by part (train/test) with encoded targets, the column lists, and a one-row summary."""
    from gyratory.constants import CONGESTION
    from gyratory.functions.scalars import encode_congestion

    spark = split.sparkSession
    encoded = split.withColumn("y_encoded", F.transform("y", lambda v: encode_congestion(v, "missing")))
    encoded.write.mode("overwrite").partitionBy("part").parquet(f"{path}/sequences")
    for name, values in (("feature_columns", features), ("target_columns", targets), ("encoding_map", CONGESTION)):
        spark.createDataFrame([(i, v) for i, v in enumerate(values)], "position int, name string").write.mode(
            "overwrite").json(f"{path}/{name}")
    info = dataset_info(read_sequences(spark, path), len(features), len(targets))
    info.write.mode("overwrite").json(f"{path}/dataset_info")
    return info


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/sequences")


def dataset_info(split: DataFrame, n_features: int, n_targets: int) -> DataFrame:
    """Sizes and time ranges of the two parts."""

    def when(part: str, column: str):
        return F.when(F.col("part") == part, F.col(column))

    return split.agg(
        F.count_if(F.col("part") == "train").alias("n_train_sequences"),
        F.count_if(F.col("part") == "test").alias("n_test_sequences"),
        F.max("n_windows").alias("window_size"),
        F.lit(n_features).alias("n_features"),
        F.lit(n_targets).alias("n_targets"),
        F.min(when("train", "start_timestamp")).alias("train_from"), F.max(when("train", "end_timestamp")).alias("train_to"),
        F.min(when("test", "start_timestamp")).alias("test_from"), F.max(when("test", "end_timestamp")).alias("test_to"),
    )
