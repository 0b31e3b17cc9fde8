"""Domain tables derived from the test tables (events, lineitem, embeddings, pages)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyratory.constants import (
    CIRCULATING_LEFT, CIRCULATING_RIGHT, COUNTED_CLASSES, CONGESTION, ENTER, EXIT, JOURNEY_PATTERNS,
)
from gyratory.functions import ordered
from gyratory.functions.scalars import decode_congestion, direction_of

DAY_WINDOW = 3600.0
PERIOD_WINDOW = 21600.0
PERIOD_START = "2024-01-01 00:00:00"

# Metres between zones; scaled up because the synthetic journeys last hours.
DISTANCES = {
    "circulating_left_to_circulating_right": 185000.0,
    "circulating_left_to_exit": 220000.0,
    "enter_to_circulating_right": 200000.0,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index, values):
    out = F.lit(None).cast("string")
    for i, value in enumerate(values):
        out = F.when(index == i, value).otherwise(out)
    return out


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def zone_events_of(events: DataFrame) -> DataFrame:
    video = F.date_trunc("day", F.col("ts"))
    eid = F.col("event_id")
    return events.select(
        video.alias("video_ts"),
        (F.col("user_id") % 4 + 1).cast("int").alias("camera_id"),
        F.col("user_id").alias("tracker_id"),
        eid.alias("seq"),
        ((F.unix_micros("ts") - F.unix_micros(video)) / 1e6).alias("t_sec"),
        _pick(eid % 4, [ENTER, EXIT, CIRCULATING_LEFT, CIRCULATING_RIGHT]).alias("zone_name"),
        F.when(F.floor(eid / 4) % 2 == 0, "enter").otherwise("exit").alias("event_type"),
        _pick(F.col("user_id") % 5, [*COUNTED_CLASSES, "bicycle"]).alias("class_name"),
    )


def zone_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day is a video, a user is a vehicle, the user number chooses the camera."""
    return zone_events_of(_events(spark, sf_dir))


def vehicles(events: DataFrame) -> DataFrame:
    # a vehicle has one class, so the class may be a grouping column (text buffers would force a sort)
    return events.groupBy("video_ts", "camera_id", "tracker_id", "class_name").agg(
        F.min("t_sec").alias("first_seen_time"),
        F.max("t_sec").alias("last_seen_time"),
    )


def sightings(events: DataFrame) -> DataFrame:
    """Every event as a sighting, for the length of the videos."""
    return events.select("video_ts", "camera_id", F.col("t_sec").alias("last_seen_time"))


def trip_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four events of a user make one trip; a camera's whole period is one video."""
    rows = _events(spark, sf_dir).select("event_id", "user_id", "ts")
    rows = ordered.position(rows, ["user_id"], ["event_id"], "_n")
    trip, pos = F.floor((F.col("_n") - 1) / 4), (F.col("_n") - 1) % 4
    rows = rows.withColumn("_trip", trip).withColumn("_pos", pos)
    pattern = (F.col("_trip") + F.col("user_id")) % 3
    at_start = (F.col("_pos") < 2) != (F.col("_trip") % 11 == 10)
    start = F.to_timestamp(F.lit(PERIOD_START))
    return rows.select(
        start.alias("video_ts"),
        (F.col("user_id") % 4 + 1).cast("int").alias("camera_id"),
        (F.col("user_id") * 100000 + F.col("_trip")).alias("tracker_id"),
        F.col("event_id").alias("seq"),
        ((F.unix_micros("ts") - F.unix_micros(start)) / 1e6).alias("t_sec"),
        F.when(at_start, _pick(pattern, [a for a, _ in JOURNEY_PATTERNS]))
        .otherwise(_pick(pattern, [b for _, b in JOURNEY_PATTERNS])).alias("zone_name"),
        F.when(F.col("_pos") % 2 == 0, "enter").otherwise("exit").alias("event_type"),
        _pick(F.col("user_id") % 5, [*COUNTED_CLASSES, "bicycle"]).alias("class_name"),
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human labels: one per event, 59 seconds long, numbered per camera in time order."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = _events(spark, sf_dir).select(
        F.col("event_id").alias("label_id"),
        (F.col("user_id") % 4 + 1).cast("int").alias("camera_id"),
        F.col("ts").alias("datetime_start"),
        F.timestamp_micros(F.unix_micros("ts") + 59_000_000).alias("datetime_end"),
        F.when(F.col("event_type") == "view", CONGESTION[0])
        .when(F.col("event_type") == "click", CONGESTION[1])
        .when(F.col("event_type") == "error", CONGESTION[2])
        .when(F.col("event_type") == "purchase", CONGESTION[3]).alias("congestion_enter_rating"),
        decode_congestion(k % 4).alias("congestion_exit_rating"),
        _pick(k % 3, ["none", "low", "high"]).alias("signaling"),
    )
    rows = ordered.position(rows, ["camera_id"], ["datetime_start", "label_id"], "_n")
    sizes = rows.groupBy("camera_id").agg(F.count(F.lit(1)).alias("_m"))
    rows = rows.join(ordered.checked_broadcast(sizes, 1000), "camera_id")
    view = F.concat(F.lit("Camera #"), F.col("camera_id").cast("string"))
    ident = F.concat(F.lit("time_segment_"), F.col("_n").cast("string"), F.lit("_"), view)
    return rows.select(
        "label_id", "camera_id", direction_of("camera_id").alias("direction"), view.alias("view_label"),
        "datetime_start", "datetime_end", F.col("datetime_start").alias("video_time"),
        F.date_trunc("day", "datetime_start").alias("video_ts"),
        F.concat(F.lit("camera"), F.col("camera_id").cast("string"), F.lit("/camera"),
                 F.col("camera_id").cast("string"), F.lit("_"),
                 F.date_format(F.date_trunc("day", "datetime_start"), "yyyy-MM-dd-HH-mm-ss"),
                 F.lit(".mp4")).alias("videos"),
        "congestion_enter_rating", "congestion_exit_rating", "signaling",
        F.col("_n").cast("int").alias("time_segment_id"),
        F.when(F.col("_n") <= F.floor(F.col("_m") * 0.8), "train")
        .when(F.col("_n") <= F.floor(F.col("_m") * 0.95), "test_input_15")
        .otherwise("test_output_5").alias("cycle_phase"),
        F.concat(ident, F.lit("_congestion_enter_rating")).alias("ID_enter"),
        F.concat(ident, F.lit("_congestion_exit_rating")).alias("ID_exit"),
    )


# Zone outlines of the synthetic camera picture (fixed values, one list of corners per zone).
ZONES = {
    "enter": [[20, 20], [60, 20], [60, 70], [20, 70]],
    "exit": [[50, 50], [90, 50], [90, 100], [50, 100]],
    "circulating_left": [[0, 0], [30, 0], [45, 25], [30, 50], [0, 50]],
    "circulating_right": [[60, 0], [100, 0], [100, 40], [80, 55], [60, 40]],
}


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier is a tracked vehicle, each of its line items one frame; the box stands on (x, y)."""
    rows = table(spark, sf_dir, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
    rows = rows.select("l_suppkey", "l_discount", *order)
    rows = ordered.position(rows, ["l_suppkey"], order, "_n")
    x, y = F.col("l_quantity") * 2, F.col("l_discount") * 1000
    return rows.select(
        (F.col("l_suppkey") % 4 + 1).cast("int").alias("camera_id"),
        F.concat(F.lit("camera"), (F.col("l_suppkey") % 4 + 1).cast("string")).alias("video_name"),
        F.col("l_suppkey").alias("tracker_id"),
        F.col("_n").cast("int").alias("frame_num"),
        (F.col("_n") / 30.0).alias("timestamp_s"),
        (F.col("l_linenumber") % 5).cast("int").alias("class_id"),
        _pick(F.col("l_linenumber") % 5, [*COUNTED_CLASSES, "bicycle"]).alias("class_name"),
        (x - 1).alias("x1"), (y - 2).alias("y1"), (x + 1).alias("x2"), y.alias("y2"),
    )


def predictions(spark: SparkSession, sf_dir: str, first: int = 0) -> DataFrame:
    """Class probabilities from four embedding entries, true class from the label, every 7th unknown."""
    e = [F.abs(F.col("embedding")[first + i].cast("double")) for i in range(4)]
    total = e[0] + e[1] + e[2] + e[3]
    camera = (F.col("vec_id") % 4 + 1).cast("int")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sequence_id"),
        camera.alias("camera_id"),
        direction_of(camera).alias("direction"),
        F.when(F.col("vec_id") % 7 == 0, -1).otherwise(F.col("label") % 4).alias("y_true"),
        F.array(*[v / total for v in e]).alias("probs"),
    )


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object listing: the pages, spread over four cameras, every fifth without one."""
    cam = F.col("page_id") % 5
    folder = F.when(cam < 4, F.concat(F.lit("camera"), (cam + 1).cast("string"))).otherwise("other")
    stamp = F.concat(F.lit("2025-10-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"))
    clock = F.concat(F.lpad((F.floor(F.col("page_id") / 140) % 24).cast("string"), 2, "0"), F.lit("-00-00"))
    ending = F.when(F.col("page_id") % 11 == 10, ".txt").otherwise(".mp4")
    return table(spark, sf_dir, "pages").select(
        F.concat(folder, F.lit("/"), folder, F.lit("_"), stamp, F.lit("-"), clock, F.lit("_"),
                 F.col("page_id").cast("string"), ending).alias("path"),
        F.length("html").cast("bigint").alias("size"),
        F.col("page_id").alias("seq"),
    )
