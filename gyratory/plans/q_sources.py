"""Queries A1-A14. Files are written from the derived tables into the shared scratch folder and read back."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from gyratory.constants import JOURNEY_PATTERNS
from gyratory.functions import scalars as B
from gyratory.operators import journeys as J
from gyratory.operators import sequences as Q
from gyratory.operators import windows as W
from gyratory.operators import zones as Z
from gyratory.plans import inputs as I
from gyratory.plans import sql_tables as S
from gyratory.plans.q_prep import SEQ, seq
from gyratory.plans.q_windows import rounded
from gyratory.plans.registry import query
from gyratory.session import scratch
from gyratory.sources import catalog as C
from gyratory.sources import readers as R
from gyratory.sources import writers as WR

CAMERAS = ["camera1", "camera2", "camera3", "camera4"]


def labels_file(spark, sf):
    """The labels as a CSV file set."""
    rows = I.ratings(spark, sf)
    path = scratch(spark, "labels")
    rows.select(
        F.col("label_id").cast("string").alias("responseId"), "view_label", "videos", "video_time",
        F.col("datetime_start").alias("datetimestamp_start"), F.col("datetime_end").alias("datetimestamp_end"),
        F.to_date("video_time").alias("date"), "congestion_enter_rating", "congestion_exit_rating", "signaling",
        "time_segment_id", "cycle_phase", "ID_enter", "ID_exit",
    ).write.option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)
    return path


@query("a1_read_labels", """
SELECT CAST(label_id AS VARCHAR) AS responseId, view_label, camera_id, direction, video_ts, datetime_start, datetime_end,
       strftime(video_ts, '%Y-%m-%d-%H-%M-%S') AS video_timestamp, congestion_enter_rating, congestion_exit_rating,
       signaling, time_segment_id, cycle_phase, ID_enter, ID_exit, CAST(CAST(video_time AS DATE) AS VARCHAR) AS date
FROM t_ratings""")
def a1(spark, sf):
    rows = R.read_labels(spark, labels_file(spark, sf))
    return rows.drop("videos", "video_time", "datetimestamp_start", "datetimestamp_end")


def _spine_flow(spark, sf):
    ev = I.zone_events(spark, sf)
    return W.flows(ev, W.window_spine(I.sightings(ev), I.DAY_WINDOW), I.DAY_WINDOW, ("entry", "exit"))


@query("a2_read_feature_files", """
SELECT strftime(video_ts, '%Y-%m-%d-%H-%M-%S') AS video_timestamp, R(window_idx) AS window_idx, R(camera_id) AS camera_id,
       R(entry_count) AS entry_count, R(CASE WHEN camera_id > 2 THEN exit_flow_rate END) AS exit_flow_rate,
       CASE WHEN camera_id > 3 THEN 'camera ' || camera_id || ', window ' || window_idx END AS place
FROM t_flow""")
def a2(spark, sf):
    flow = _spine_flow(spark, sf).withColumn("_file", F.date_format("video_ts", B.TIMESTAMP_FORMAT))
    place = F.concat(F.lit("camera "), F.col("camera_id").cast("string"), F.lit(", window "), F.col("window_idx").cast("string"))
    flow = flow.withColumn("place", place)
    path = scratch(spark, "features")
    # three layouts; the folder names stand in for file names, which Spark chooses itself
    for layout, which, names in (
        ("narrow", "camera_id <= 2", ["camera_id", "window_idx", "entry_count"]),
        ("wide", "camera_id = 3", ["camera_id", "window_idx", "entry_count", "exit_flow_rate"]),
        ("quoted", "camera_id > 3", ["place", "exit_flow_rate", "entry_count", "window_idx", "camera_id"]),
    ):
        files = flow.filter(which).select("_file", *names).write.option("header", True).option("quoteAll", layout == "quoted")
        files.partitionBy("_file").csv(f"{path}/{layout}")
    return _from_folders(spark, path)


def _from_folders(spark, path):
    rows = R.read_feature_files(spark, path, "part-")
    return rows.select("video_timestamp", "window_idx", "camera_id", "entry_count", "exit_flow_rate", "place")


def tracking_file(spark, sf):
    """Tracking documents, one vehicle each, from the trips (four events at most)."""
    ev = I.trip_events(spark, sf)
    times = J.journeys_of(ev, I.DISTANCES)
    listed = ev.groupBy(*J.VEHICLE, "class_name").agg(
        F.sort_array(F.collect_list(F.struct("seq", "event_type", "zone_name", "t_sec"))).alias("_e"),
        F.min("t_sec").alias("first"), F.max("t_sec").alias("last"),
    )
    checks = times.groupBy(*J.VEHICLE).agg(
        F.collect_list(
            F.struct(
                "pattern", "start_zone", "end_zone", "is_valid",
                F.when(F.col("is_valid"), F.struct(
                    F.col("t1").alias("t1_enter_start_zone"), F.col("t2").alias("t2_exit_start_zone"),
                    F.col("t3").alias("t3_enter_end_zone"), F.col("t4").alias("t4_exit_end_zone"), "journey_type",
                    "total_journey_time", "speed_km_h")).alias("journey_times"),
            )
        ).alias("_v")
    )
    events = F.transform("_e", lambda e: F.struct(
        e["event_type"].alias("event_type"), e["zone_name"].alias("zone_name"), F.lit(0).alias("frame"),
        e["t_sec"].alias("timestamp")))
    vehicle = F.struct(
        "tracker_id", "class_name", F.col("first").alias("first_seen_time"), F.col("last").alias("last_seen_time"),
        events.alias("events"), F.col("_v").alias("validations"))
    path = scratch(spark, "tracking")
    listed.join(checks, J.VEHICLE).select(
        F.concat(F.lit("camera"), F.col("camera_id").cast("string")).alias("video_name"),
        F.array(vehicle).alias("vehicles"),
    ).write.json(path)
    return path


@query("a3_tracking_events", """
SELECT 'camera' || camera_id AS video_name, tracker_id, class_name, row_number() OVER (PARTITION BY camera_id, tracker_id
       ORDER BY seq) - 1 AS seq, event_type, zone_name, R(t_sec) AS t_sec FROM t_trip_events""")
def a3_events(spark, sf):
    return R.read_tracking(spark, tracking_file(spark, sf), False)[1].drop("frame")


@query("a3_tracking_validations", """
SELECT 'camera' || camera_id AS video_name, tracker_id, pattern, is_valid, R(CASE WHEN is_valid THEN t1 END) AS t1,
       journey_type, R(total_journey_time) AS total_journey_time,
       R(CASE WHEN is_valid THEN speed_km_h END) AS speed_km_h FROM t_trip_journeys""")
def a3_validations(spark, sf):
    return R.read_tracking(spark, tracking_file(spark, sf), False)[2].select(
        "video_name", "tracker_id", "pattern", "is_valid", "t1", "journey_type", "total_journey_time", "speed_km_h")


@query("a4_zone_population", """
SELECT camera_id, zone_name, count(*) AS detections FROM t_in_zone GROUP BY ALL""")
def a4(spark, sf):
    path = scratch(spark, "zones")
    for cam in (1, 2, 3, 4):
        doc = json.dumps({"zones": I.ZONES, "zone_colors": {}})
        spark.createDataFrame([(doc,)], "value string").coalesce(1).write.text(f"{path}/camera_{cam}_zones.json")
    zones = R.read_zones(spark, f"{path}/*")
    return Z.point_in_zone(I.detections(spark, sf), zones).groupBy("camera_id", "zone_name").agg(
        F.count(F.lit(1)).alias("detections"))


@query("a5_distances_to_speed", """
SELECT pattern, count(speed_km_h) AS journeys, R(avg(speed_km_h)) AS mean_speed_km_h
FROM t_trip_journeys WHERE is_valid GROUP BY pattern""")
def a5(spark, sf):
    path = scratch(spark, "distances")
    doc = json.dumps({"_comment": "metres between zones", **I.DISTANCES})
    spark.createDataFrame([(doc,)], "value string").coalesce(1).write.text(path)
    metres = R.distances_dict(R.read_zone_distances(spark, path))
    return J.journeys_of(I.trip_events(spark, sf), metres).filter("is_valid").groupBy("pattern").agg(
        F.count("speed_km_h").alias("journeys"), F.avg("speed_km_h").alias("mean_speed_km_h"))


@query("a7_write_features", """
SELECT strftime(video_ts, '%Y-%m-%d-%H-%M-%S') AS video_timestamp, video_ts, camera_id, window_idx, entry_count, exit_count,
       R(entry_flow_rate) AS entry_flow_rate FROM t_flow""")
def a7(spark, sf):
    path = scratch(spark, "windows")
    WR.write_features(_spine_flow(spark, sf), path)
    return WR.combine_results(spark, path).select(
        "video_timestamp", "video_ts", "camera_id", "window_idx", "entry_count", "exit_count", "entry_flow_rate")


@query("a8_dataset_info", f"""
WITH s AS (SELECT *, row_number() OVER (ORDER BY end_timestamp, sequence_id) <= floor(count(*) OVER () * CAST(0.8 AS DOUBLE))
             AS train FROM t_seq)
SELECT count(*) FILTER (WHERE train) AS n_train_sequences, count(*) FILTER (WHERE NOT train) AS n_test_sequences,
       CAST(6 AS INTEGER) AS window_size, CAST({len(SEQ)} AS INTEGER) AS n_features, CAST(4 AS INTEGER) AS n_targets,
       min(start_timestamp) FILTER (WHERE train) AS train_from, max(end_timestamp) FILTER (WHERE train) AS train_to,
       min(start_timestamp) FILTER (WHERE NOT train) AS test_from, max(end_timestamp) FILTER (WHERE NOT train) AS test_to
FROM s""")
def a8(spark, sf):
    from gyratory.session import materialise

    split = Q.temporal_split(materialise(seq(spark, sf)))
    return WR.write_sequences(split, scratch(spark, "sequences"), SEQ, Q.ENTRY_TARGETS)


_FIRST = "CASE " + " ".join(f"WHEN contains(path, '{c}') THEN '{c}'" for c in CAMERAS) + " END"
S.TABLES["t_camera_files"] = f"SELECT *, {_FIRST} AS camera FROM t_listing WHERE size > 0"


@query("a9_catalog_size", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS camera, count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM t_camera_files WHERE camera = '{c}'"
    for c in CAMERAS) + " UNION ALL SELECT '(all)', count(*), CAST(sum(size) AS BIGINT) FROM t_camera_files)")
def a9(spark, sf):
    return C.catalog_size(I.listing(spark, sf), CAMERAS)


@query("a10_catalog_filter", """
SELECT path, size, seq FROM t_listing WHERE (lower(path) LIKE '%.mp4%' OR lower(path) LIKE '%.avi%' OR lower(path) LIKE '%.mov%')
  AND contains(path, 'camera2') AND regexp_extract(path, '\\d{4}-\\d{2}-\\d{2}') BETWEEN '2025-10-05' AND '2025-10-20'""")
def a10(spark, sf):
    return C.catalog_filter(I.listing(spark, sf), "camera2", "2025-10-05", "2025-10-20")


S.TABLES["t_sets"] = f"""
SELECT video_timestamp, {', '.join(f"max_by(path, seq) FILTER (WHERE camera = '{c}') AS path_{i}" for i, c in enumerate(CAMERAS, 1))}
FROM (SELECT *, {_FIRST} AS camera, regexp_extract(path, '\\d{{4}}(-\\d{{2}}){{5}}') AS video_timestamp FROM t_listing
      WHERE lower(path) LIKE '%.mp4%')
WHERE camera IS NOT NULL GROUP BY video_timestamp"""
_FOUND = " + ".join(f"CAST(path_{i} IS NOT NULL AS INTEGER)" for i in range(1, 5))


@query("a11_complete_video_sets", f"SELECT *, {_FOUND} AS cameras, ({_FOUND}) = 4 AS complete FROM t_sets")
def a11(spark, sf):
    return C.complete_video_sets(I.listing(spark, sf), CAMERAS)


def stamped(spark, sf):
    return I.ratings(spark, sf).withColumn("video_timestamp", B.extract_timestamp("videos"))


@query("a12_select_timestamps", """
SELECT DISTINCT strftime(video_ts, '%Y-%m-%d-%H-%M-%S') AS video_timestamp FROM t_ratings
WHERE CAST(video_ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""")
def a12(spark, sf):
    return C.select_timestamps(stamped(spark, sf), "2024-01-05", "2024-01-20")


@query("a12_first_timestamps", """
SELECT DISTINCT strftime(video_ts, '%Y-%m-%d-%H-%M-%S') AS video_timestamp FROM t_ratings
WHERE CAST(video_ts AS DATE) >= DATE '2024-01-05' ORDER BY 1 LIMIT 12""")
def a12_first(spark, sf):
    return C.select_timestamps(stamped(spark, sf), "2024-01-05", limit=12)


@query("a13_pending_timestamps", """
SELECT DISTINCT strftime(video_ts, '%Y-%m-%d-%H-%M-%S') AS video_timestamp FROM t_ratings
WHERE isodow(video_ts) >= 6""")
def a13(spark, sf):
    path = scratch(spark, "done")
    WR.write_features(_spine_flow(spark, sf).filter(F.weekday("video_ts") < 5), path)
    return C.pending_timestamps(C.select_timestamps(stamped(spark, sf)), WR.written_timestamps(spark, path))


@query("a14_combine_results", """
SELECT strftime(video_ts, '%Y-%m-%d-%H-%M-%S') AS video_timestamp, camera_id, window_idx, entry_count FROM t_flow
WHERE isodow(video_ts) >= 6""")
def a14(spark, sf):
    path = scratch(spark, "windows")
    WR.write_features(_spine_flow(spark, sf), path)
    wanted = C.select_timestamps(stamped(spark, sf)).filter(F.weekday(B.parse_video_ts("video_timestamp")) >= 5)
    return WR.combine_results(spark, path, wanted).select("video_timestamp", "camera_id", "window_idx", "entry_count")
