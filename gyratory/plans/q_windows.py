"""Queries C1-C14 and D1-D12."""

from __future__ import annotations

from gyratory.constants import COUNTED_CLASSES
from gyratory.operators import journeys as J
from gyratory.operators import visits as V
from gyratory.operators import windows as W
from gyratory.operators import zones as Z
from gyratory.plans import inputs as I
from gyratory.plans import sql_tables as S
from gyratory.plans.registry import query

CLASSES = [*COUNTED_CLASSES, "bicycle"]
ZONE_NAMES = ["enter", "exit", "circulating_left", "circulating_right"]
KEY = "video_ts, camera_id, window_idx"


def zone_table(spark):
    rows = [(cam, name, [[float(v) for v in p] for p in poly])
            for cam in (1, 2, 3, 4) for name, poly in I.ZONES.items()]
    return spark.createDataFrame(rows, "camera_id int, zone_name string, polygon array<array<double>>")


def day_features(spark, sf):
    """Window features of the day videos (hourly windows)."""
    ev = I.zone_events(spark, sf)
    return W.extract_features(ev, I.sightings(ev), J.journeys_of(ev, I.DISTANCES), I.DAY_WINDOW)


def _day(spark, sf):
    ev = I.zone_events(spark, sf)
    return ev, W.window_spine(I.sightings(ev), I.DAY_WINDOW)


def _trips(spark, sf):
    ev = I.trip_events(spark, sf)
    return ev, W.window_spine(I.sightings(ev), I.PERIOD_WINDOW), J.journeys_of(ev, I.DISTANCES)


@query("c1_point_in_zone", "SELECT camera_id, tracker_id, frame_num, zone_name FROM t_in_zone")
def c1(spark, sf):
    return Z.point_in_zone(I.detections(spark, sf), zone_table(spark)).select(
        "camera_id", "tracker_id", "frame_num", "zone_name")


@query("c2_zone_events", """
SELECT camera_id, tracker_id, frame_num, event_type, zone_name,
       CAST(frame_num AS BIGINT) * 1000 + row_number() OVER (PARTITION BY camera_id, tracker_id, frame_num
            ORDER BY event_type, zone_name) - 1 AS seq FROM t_track_events""")
def c2(spark, sf):
    ev = Z.detect_zone_events(I.detections(spark, sf), zone_table(spark))
    return ev.select("camera_id", "tracker_id", "frame_num", "event_type", "zone_name", "seq")


@query("c3_vehicle_lifecycle", """
SELECT video_name, camera_id, tracker_id, arg_min(class_id, frame_num) AS class_id,
       arg_min(class_name, frame_num) AS class_name, min(frame_num) AS first_seen_frame, max(frame_num) AS last_seen_frame,
       R(min(timestamp_s)) AS first_seen_time, R(max(timestamp_s)) AS last_seen_time, count(*) AS frames_seen
FROM t_detections GROUP BY ALL""")
def c3(spark, sf):
    return Z.vehicle_lifecycle(I.detections(spark, sf))


@query("c4_validate_journey", """
SELECT camera_id, tracker_id, pattern, start_zone, end_zone, R(t1) AS t1, R(t2) AS t2, R(t3) AS t3, R(t4) AS t4, is_valid
FROM t_trip_journeys""")
def c4(spark, sf):
    return J.validate_journeys(I.trip_events(spark, sf)).drop("video_ts")


@query("c5_journey_times", """
SELECT camera_id, tracker_id, pattern, journey_type, R(time_in_start_zone) AS time_in_start_zone,
       R(time_between_zones) AS time_between_zones, R(time_in_end_zone) AS time_in_end_zone,
       R(total_journey_time) AS total_journey_time
FROM t_trip_journeys WHERE is_valid""")
def c5(spark, sf):
    out = J.journey_times(J.validate_journeys(I.trip_events(spark, sf))).filter("is_valid")
    return out.drop("video_ts", "start_zone", "end_zone", "t1", "t2", "t3", "t4", "is_valid")


@query("c6_journey_speed", """
SELECT camera_id, tracker_id, pattern, R(distance_meters) AS distance_meters, R(speed_m_s) AS speed_m_s,
       R(speed_km_h) AS speed_km_h FROM t_trip_journeys WHERE is_valid""")
def c6(spark, sf):
    out = J.journeys_of(I.trip_events(spark, sf), I.DISTANCES).filter("is_valid")
    return out.select("camera_id", "tracker_id", "pattern", "distance_meters", "speed_m_s", "speed_km_h")


@query("c7_tracking_summary", """
SELECT video_ts, camera_id, count(*) AS total_vehicles_detected, CAST(sum(v) AS BIGINT) AS valid_journeys_count,
       R(sum(v) / CAST(count(*) AS DOUBLE)) AS validation_rate, count(*) FILTER (WHERE v > 0) AS vehicles_with_valid_journey
FROM (SELECT video_ts, camera_id, tracker_id, count(*) FILTER (WHERE is_valid) AS v FROM t_trip_journeys GROUP BY ALL)
GROUP BY ALL""")
def c7(spark, sf):
    return J.tracking_summary(J.validate_journeys(I.trip_events(spark, sf)))


S.TABLES["t_visits"] = """
SELECT video_ts, camera_id, tracker_id, zone_name, class_name, seq,
       CASE WHEN event_type = 'enter' THEN t_sec END AS time_entered,
       CASE WHEN event_type = 'exit' THEN t_sec WHEN nxt = 'exit' THEN nxt_t END AS time_exited,
       CASE WHEN event_type = 'enter' AND nxt = 'exit' THEN nxt_t - t_sec END AS duration
FROM (SELECT *, lag(event_type) OVER w AS prv, lead(event_type) OVER w AS nxt, lead(t_sec) OVER w AS nxt_t
      FROM t_trip_events
      WINDOW w AS (PARTITION BY video_ts, camera_id, tracker_id, zone_name ORDER BY t_sec, seq))
WHERE event_type = 'enter' OR prv IS DISTINCT FROM 'enter'"""
S.TABLES["t_trip_vehicles"] = """
SELECT video_ts, camera_id, tracker_id, min(class_name) AS class_name, min(t_sec) AS first_seen_time,
       max(t_sec) AS last_seen_time FROM t_trip_events GROUP BY ALL"""


@query("c8_zone_visits", """
SELECT camera_id, tracker_id, zone_name, seq, R(time_entered) AS time_entered, R(time_exited) AS time_exited,
       R(duration) AS duration FROM t_visits""")
def c8(spark, sf):
    return V.zone_visits(I.trip_events(spark, sf)).drop("video_ts", "class_name")


S.TABLES["t_dwell"] = """
SELECT video_ts, camera_id, zone_name, avg(duration) AS dwell_mean, quantile_cont(duration, 0.5) AS dwell_median,
       min(duration) AS dwell_min, max(duration) AS dwell_max, stddev_samp(duration) AS dwell_std, count(*) AS dwell_count
FROM t_visits WHERE duration IS NOT NULL GROUP BY ALL"""


@query("c9_dwell_stats", """
SELECT video_ts, camera_id, zone_name, R(dwell_mean) AS dwell_mean, R(dwell_median) AS dwell_median,
       R(dwell_min) AS dwell_min, R(dwell_max) AS dwell_max, R(dwell_std) AS dwell_std, dwell_count FROM t_dwell""")
def c9(spark, sf):
    return V.dwell_stats(V.zone_visits(I.trip_events(spark, sf)))


@query("c10_duration_summary", """
WITH both_ AS (
  SELECT video_ts, camera_id, '(all)' AS zone_name, count(*) AS vehicles FROM t_trip_vehicles GROUP BY ALL
  UNION ALL SELECT video_ts, camera_id, zone_name, count(DISTINCT tracker_id) FROM t_visits GROUP BY ALL)
SELECT * FROM both_ UNION ALL SELECT NULL, NULL, zone_name, CAST(sum(vehicles) AS BIGINT) FROM both_ GROUP BY zone_name
""")
def c10(spark, sf):
    ev = I.trip_events(spark, sf)
    return V.duration_summary(I.vehicles(ev), V.zone_visits(ev))


@query("c11_vehicle_class_counts", "SELECT video_ts, camera_id, " + ", ".join(
    f"count(*) FILTER (WHERE class_name = '{c}') AS vehicle_class_{c}" for c in CLASSES)
    + " FROM t_vehicles GROUP BY ALL")
def c11(spark, sf):
    return V.vehicle_class_counts(I.vehicles(I.zone_events(spark, sf)), CLASSES)


S.TABLES["t_jstats"] = """
SELECT v.video_ts, v.camera_id, avg(last_seen_time - first_seen_time) AS avg_journey_duration,
       min(last_seen_time - first_seen_time) AS min_journey_duration,
       max(last_seen_time - first_seen_time) AS max_journey_duration,
       avg(coalesce(z, 0)) AS avg_zones_visited, max(coalesce(z, 0)) AS max_zones_visited
FROM t_trip_vehicles v LEFT JOIN (SELECT video_ts, camera_id, tracker_id, count(DISTINCT zone_name) AS z
  FROM t_visits GROUP BY ALL) USING (video_ts, camera_id, tracker_id) GROUP BY ALL"""


@query("c12_journey_stats", """
SELECT video_ts, camera_id, R(avg_journey_duration) AS avg_journey_duration, R(min_journey_duration) AS min_journey_duration,
       R(max_journey_duration) AS max_journey_duration, R(avg_zones_visited) AS avg_zones_visited, max_zones_visited
FROM t_jstats""")
def c12(spark, sf):
    ev = I.trip_events(spark, sf)
    return V.journey_stats(I.vehicles(ev), V.zone_visits(ev))


@query("c13_zone_throughput", "SELECT v.video_ts, v.camera_id, zone_name, count(*) AS total_visits, "
       "count(DISTINCT tracker_id) AS unique_vehicles, " + ", ".join(
           f"count(DISTINCT tracker_id) FILTER (WHERE class_name = '{c}') AS vtype_{c}" for c in CLASSES) + """,
       R(count(DISTINCT tracker_id) / any_value(m)) AS throughput
FROM t_visits v JOIN (SELECT video_ts, camera_id, max(last_seen_time) / 60e0 AS m FROM t_trip_vehicles GROUP BY ALL)
  USING (video_ts, camera_id) GROUP BY ALL""")
def c13(spark, sf):
    ev = I.trip_events(spark, sf)
    return V.zone_throughput(V.zone_visits(ev), I.vehicles(ev), CLASSES)


_DW = ["dwell_mean", "dwell_median", "dwell_min", "dwell_max", "dwell_std"]


@query("c14_video_summary", "SELECT t.video_ts, t.camera_id, t.n AS total_vehicles_tracked, R(t.d) AS duration_seconds, "
       + ", ".join(f"t.vehicle_class_{c}" for c in CLASSES) + """,
       R(avg_journey_duration) AS avg_journey_duration, R(min_journey_duration) AS min_journey_duration,
       R(max_journey_duration) AS max_journey_duration, R(avg_zones_visited) AS avg_zones_visited, max_zones_visited, """
       + ", ".join(f"zc.zone_count_{z}" for z in ZONE_NAMES) + ", "
       + ", ".join(f"R(dw.{n}_{z}) AS {n}_{z}" for n in _DW for z in ZONE_NAMES) + ", "
       + ", ".join(f"dw.dwell_count_{z}" for z in ZONE_NAMES) + """,
       CAST(CAST(t.video_ts AS DATE) AS VARCHAR) AS date, CAST(hour(t.video_ts) AS INTEGER) AS hour,
       CAST(minute(t.video_ts) AS INTEGER) AS minute
FROM (SELECT video_ts, camera_id, count(*) AS n, max(last_seen_time) AS d, """
       + ", ".join(f"count(*) FILTER (WHERE class_name = '{c}') AS vehicle_class_{c}" for c in CLASSES) + """
      FROM t_trip_vehicles GROUP BY ALL) t
JOIN t_jstats USING (video_ts, camera_id)
LEFT JOIN (SELECT video_ts, camera_id, """
       + ", ".join(f"count(DISTINCT tracker_id) FILTER (WHERE zone_name = '{z}') AS zone_count_{z}" for z in ZONE_NAMES)
       + """ FROM t_visits GROUP BY ALL) zc USING (video_ts, camera_id)
LEFT JOIN (SELECT video_ts, camera_id, """
       + ", ".join(f"max({n}) FILTER (WHERE zone_name = '{z}') AS {n}_{z}" for n in [*_DW, "dwell_count"] for z in ZONE_NAMES)
       + " FROM t_dwell GROUP BY ALL) dw USING (video_ts, camera_id)")
def c14(spark, sf):
    ev = I.trip_events(spark, sf)
    return V.video_summary(I.vehicles(ev), V.zone_visits(ev), ZONE_NAMES, CLASSES)


@query("d1_window_spine", f"""
SELECT {KEY}, R(start_time) AS start_time, R(end_time) AS end_time, R(window_duration) AS window_duration FROM t_spine""")
def d1(spark, sf):
    return _day(spark, sf)[1]


def _flow_sql(name):
    cols = [f"{name}_count"] + [f"{name}_count_{c}" for c in COUNTED_CLASSES]
    return f"SELECT {KEY}, {', '.join(cols)}, R({name}_flow_rate) AS {name}_flow_rate FROM t_flow"


@query("d2_entry_flow", _flow_sql("entry"))
def d2(spark, sf):
    ev, spine = _day(spark, sf)
    return W.entry_flow(ev, spine, I.DAY_WINDOW)


@query("d3_exit_flow", _flow_sql("exit"))
def d3(spark, sf):
    ev, spine = _day(spark, sf)
    return W.exit_flow(ev, spine, I.DAY_WINDOW)


@query("d4_circulating_flow", f"""
SELECT {KEY}, circulating_flow_count, R(circulating_flow_rate) AS circulating_flow_rate FROM t_flow""")
def d4(spark, sf):
    ev, spine = _day(spark, sf)
    return W.circulating_flow(ev, spine, I.DAY_WINDOW)


@query("d5_zone_occupancy", """
SELECT s.video_ts, s.camera_id, z.zone_name, CAST(s.sample AS INTEGER) AS sample, R(s.sample * 1800e0) AS sample_time,
       coalesce(o.vehicles, 0) AS occupancy
FROM t_samples s JOIN (SELECT DISTINCT video_ts, camera_id, zone_name FROM t_zone_events) z USING (video_ts, camera_id)
LEFT JOIN t_occupied o ON o.video_ts = s.video_ts AND o.camera_id = s.camera_id AND o.zone_name = z.zone_name
     AND o.sample = s.sample""")
def d5(spark, sf):
    ev, spine = _day(spark, sf)
    return W.zone_occupancy(ev, spine, I.DAY_WINDOW)


@query("d6_occupancy_stats", f"""
SELECT {KEY}, R(circulating_occupancy_avg) AS circulating_occupancy_avg, circulating_occupancy_max,
       circulating_occupancy_min FROM t_occupancy""")
def d6(spark, sf):
    ev, spine = _day(spark, sf)
    return W.occupancy_stats(ev, spine, I.DAY_WINDOW)


@query("d7_od_matrix", "SELECT * FROM t_trip_od")
def d7(spark, sf):
    _, spine, journeys = _trips(spark, sf)
    return W.od_matrix(journeys, spine, I.PERIOD_WINDOW)


SPEEDS = ["speed_avg_km_h", "speed_std_km_h", "speed_min_km_h", "speed_max_km_h", "speed_median_km_h",
          "entry_speed_avg_km_h", "circulating_speed_avg_km_h"]


def rounded(names):
    return ", ".join(f"R({n}) AS {n}" for n in names)


@query("d8_speed_stats", f"SELECT {KEY}, {rounded(SPEEDS)} FROM t_trip_speed")
def d8(spark, sf):
    _, spine, journeys = _trips(spark, sf)
    return W.speed_stats(journeys, spine, I.PERIOD_WINDOW)


DERIVED = ["entry_exit_balance", "entry_circulating_ratio", "flow_imbalance_index", "occupancy_flow_ratio",
           "circulating_density"]


@query("d9_derived_features", f"SELECT {KEY}, {rounded(DERIVED)} FROM t_features")
def d9(spark, sf):
    ev, spine = _day(spark, sf)
    base = W.flows(ev, spine, I.DAY_WINDOW).join(W.occupancy_stats(ev, spine, I.DAY_WINDOW), W.KEY, "left")
    return W.derived_features(base).select(*W.KEY, *DERIVED)


_COUNTS = [f"{n}_count{s}" for n in ("entry", "exit") for s in ("", *[f"_{c}" for c in COUNTED_CLASSES])]
_OD = ["od_enter_to_circulating_right", "od_enter_to_exit", "od_circulating_left_to_circulating_right",
       "od_circulating_left_to_exit", "od_total_flow"]


@query("d10_extract_features", f"""
SELECT {KEY}, {rounded(['start_time', 'end_time', 'window_duration'])}, hour_of_day, day_of_week, is_weekend, is_rush_hour,
       {', '.join(_COUNTS)}, circulating_flow_count, circulating_occupancy_max, circulating_occupancy_min, {', '.join(_OD)},
       {rounded(['time_since_midnight', 'entry_flow_rate', 'exit_flow_rate', 'circulating_flow_rate',
                 'circulating_occupancy_avg', *SPEEDS, *DERIVED])}
FROM t_features""")
def d10(spark, sf):
    return day_features(spark, sf)


@query("d11_lags", f"""SELECT {KEY}, {', '.join(n if '_count_' in n else f'R({n}) AS {n}' for n in S.LAG_NAMES)}
FROM t_lagged""")
def d11(spark, sf):
    return W.add_lags(day_features(spark, sf)).select(*W.KEY, *S.LAG_NAMES)


@query("d12_rolling", f"SELECT {KEY}, {rounded(S.ROLL_NAMES)} FROM t_rolled")
def d12(spark, sf):
    return W.add_rolling(day_features(spark, sf)).select(*W.KEY, *S.ROLL_NAMES)
