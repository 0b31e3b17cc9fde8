"""SQL twins of the derived tables in `inputs` and of the large intermediate results."""

from gyratory.constants import JOURNEY_PATTERNS, LAG_METRICS, LAGS, ROLLING, ROLLING_METRICS
from gyratory.plans.inputs import DISTANCES, ZONES
from gyratory.plans.registry import TABLES

_ZONE = "CASE {i} WHEN 0 THEN 'enter' WHEN 1 THEN 'exit' WHEN 2 THEN 'circulating_left' ELSE 'circulating_right' END"
_CLASS = ("CASE user_id % 5 WHEN 0 THEN 'car' WHEN 1 THEN 'truck' WHEN 2 THEN 'bus' "
          "WHEN 3 THEN 'motorcycle' ELSE 'bicycle' END")
DIRECTION = "CASE {c} WHEN 1 THEN 'north' WHEN 2 THEN 'east' WHEN 3 THEN 'south' WHEN 4 THEN 'west' END"
LABEL = ("CASE {i} WHEN 0 THEN 'free flowing' WHEN 1 THEN 'light delay' WHEN 2 THEN 'moderate delay' "
         "WHEN 3 THEN 'heavy delay' END")
SEVERITY = ("CASE {c} WHEN 'free flowing' THEN 0 WHEN 'light delay' THEN 1 WHEN 'moderate delay' THEN 2 "
            "WHEN 'heavy delay' THEN 3 END")

TABLES["t_zone_events"] = f"""
SELECT date_trunc('day', ts) AS video_ts, CAST(user_id % 4 + 1 AS INTEGER) AS camera_id, user_id AS tracker_id,
       event_id AS seq, CAST(epoch_us(ts) - epoch_us(date_trunc('day', ts)) AS DOUBLE) / 1e6 AS t_sec,
       {_ZONE.format(i='event_id % 4')} AS zone_name,
       CASE WHEN (event_id // 4) % 2 = 0 THEN 'enter' ELSE 'exit' END AS event_type,
       {_CLASS} AS class_name
FROM events"""

TABLES["t_vehicles"] = """
SELECT video_ts, camera_id, tracker_id, min(class_name) AS class_name,
       min(t_sec) AS first_seen_time, max(t_sec) AS last_seen_time
FROM t_zone_events GROUP BY ALL"""

_START = "CASE p WHEN 2 THEN 'enter' ELSE 'circulating_left' END"
_END = "CASE p WHEN 1 THEN 'exit' ELSE 'circulating_right' END"
TABLES["t_trip_events"] = f"""
SELECT TIMESTAMP '2024-01-01 00:00:00' AS video_ts, CAST(user_id % 4 + 1 AS INTEGER) AS camera_id,
       user_id * 100000 + trip AS tracker_id, event_id AS seq,
       CAST(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00') AS DOUBLE) / 1e6 AS t_sec,
       CASE WHEN (pos < 2) <> (trip % 11 = 10) THEN {_START} ELSE {_END} END AS zone_name,
       CASE WHEN pos % 2 = 0 THEN 'enter' ELSE 'exit' END AS event_type, {_CLASS} AS class_name
FROM (SELECT *, n // 4 AS trip, n % 4 AS pos, (n // 4 + user_id) % 3 AS p
      FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events))"""

TABLES["t_ratings"] = f"""
SELECT label_id, camera_id, {DIRECTION.format(c='camera_id')} AS direction, 'Camera #' || camera_id AS view_label,
       ts AS datetime_start, ts + INTERVAL 59 SECOND AS datetime_end, ts AS video_time,
       date_trunc('day', ts) AS video_ts,
       'camera' || camera_id || '/camera' || camera_id || '_' || strftime(date_trunc('day', ts), '%Y-%m-%d-%H-%M-%S')
         || '.mp4' AS videos,
       CASE event_type WHEN 'view' THEN 'free flowing' WHEN 'click' THEN 'light delay'
         WHEN 'error' THEN 'moderate delay' WHEN 'purchase' THEN 'heavy delay' END AS congestion_enter_rating,
       {LABEL.format(i='k % 4')} AS congestion_exit_rating,
       CASE k % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'low' ELSE 'high' END AS signaling,
       CAST(n AS INTEGER) AS time_segment_id,
       CASE WHEN n <= floor(m * CAST(0.8 AS DOUBLE)) THEN 'train'
            WHEN n <= floor(m * CAST(0.95 AS DOUBLE)) THEN 'test_input_15' ELSE 'test_output_5' END AS cycle_phase,
       'time_segment_' || n || '_Camera #' || camera_id || '_congestion_enter_rating' AS ID_enter,
       'time_segment_' || n || '_Camera #' || camera_id || '_congestion_exit_rating' AS ID_exit
FROM (SELECT event_id AS label_id, ts, event_type, CAST(user_id % 4 + 1 AS INTEGER) AS camera_id,
             CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
             row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) AS n,
             count(*) OVER (PARTITION BY user_id % 4) AS m
      FROM events)"""

TABLES["t_detections"] = """
SELECT CAST(l_suppkey % 4 + 1 AS INTEGER) AS camera_id, 'camera' || (l_suppkey % 4 + 1) AS video_name,
       l_suppkey AS tracker_id, CAST(n AS INTEGER) AS frame_num, n / CAST(30.0 AS DOUBLE) AS timestamp_s,
       CAST(l_linenumber % 5 AS INTEGER) AS class_id,
       CASE l_linenumber % 5 WHEN 0 THEN 'car' WHEN 1 THEN 'truck' WHEN 2 THEN 'bus' WHEN 3 THEN 'motorcycle'
         ELSE 'bicycle' END AS class_name,
       l_quantity * 2 AS x, l_discount * 1000 AS y
FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey,
                                   l_quantity, l_extendedprice) AS n FROM lineitem)"""

_edges = []
for _name, _poly in ZONES.items():
    for _i, (_x, _y) in enumerate(_poly):
        _xb, _yb = _poly[(_i + 1) % len(_poly)]
        _edges.append(f"('{_name}', {_x}e0, {_y}e0, {_xb}e0, {_yb}e0)")
TABLES["t_edges"] = f"SELECT * FROM (VALUES {', '.join(_edges)}) AS v(zone_name, xa, ya, xb, yb)"
TABLES["t_in_zone"] = """
SELECT d.camera_id, d.video_name, d.tracker_id, d.frame_num, d.timestamp_s, e.zone_name
FROM t_detections d JOIN t_edges e
  ON (e.ya > d.y) <> (e.yb > d.y) AND d.x < e.xa + (e.xb - e.xa) * (d.y - e.ya) / (e.yb - e.ya)
GROUP BY ALL HAVING count(*) % 2 = 1"""
TABLES["t_track_events"] = """
SELECT video_name, camera_id, tracker_id, frame_num, timestamp_s, zone_name,
       CASE WHEN inside THEN 'enter' ELSE 'exit' END AS event_type
FROM (SELECT f.*, lag(inside, 1, false) OVER (PARTITION BY video_name, camera_id, tracker_id, zone_name
                                              ORDER BY frame_num) AS was
      FROM (SELECT d.video_name, d.camera_id, d.tracker_id, d.frame_num, d.timestamp_s, z.zone_name,
                   i.zone_name IS NOT NULL AS inside
            FROM t_detections d CROSS JOIN (SELECT DISTINCT zone_name FROM t_edges) z
            LEFT JOIN t_in_zone i ON i.video_name = d.video_name AND i.camera_id = d.camera_id
                 AND i.tracker_id = d.tracker_id AND i.frame_num = d.frame_num AND i.zone_name = z.zone_name) f)
WHERE inside <> was"""

TABLES["t_prob"] = """
SELECT vec_id AS sequence_id, CAST(vec_id % 4 + 1 AS INTEGER) AS camera_id,
       CAST(CASE WHEN vec_id % 7 = 0 THEN -1 ELSE label % 4 END AS INTEGER) AS y_true,
       a / (a + b + c + d) AS p0, b / (a + b + c + d) AS p1, c / (a + b + c + d) AS p2, d / (a + b + c + d) AS p3,
       a2 / (a2 + b2 + c2 + d2) AS q0, b2 / (a2 + b2 + c2 + d2) AS q1, c2 / (a2 + b2 + c2 + d2) AS q2,
       d2 / (a2 + b2 + c2 + d2) AS q3
FROM (SELECT *, abs(CAST(embedding[1] AS DOUBLE)) AS a, abs(CAST(embedding[2] AS DOUBLE)) AS b,
             abs(CAST(embedding[3] AS DOUBLE)) AS c, abs(CAST(embedding[4] AS DOUBLE)) AS d,
             abs(CAST(embedding[5] AS DOUBLE)) AS a2, abs(CAST(embedding[6] AS DOUBLE)) AS b2,
             abs(CAST(embedding[7] AS DOUBLE)) AS c2, abs(CAST(embedding[8] AS DOUBLE)) AS d2
      FROM embeddings)"""
TABLES["t_pred"] = f"""
SELECT *, {DIRECTION.format(c='camera_id')} AS direction, greatest(p0, p1, p2, p3) AS confidence,
       CAST(CASE greatest(p0, p1, p2, p3) WHEN p0 THEN 0 WHEN p1 THEN 1 WHEN p2 THEN 2 ELSE 3 END AS INTEGER) AS y_pred
FROM t_prob"""
TABLES["t_known"] = "SELECT * FROM t_pred WHERE y_true <> -1"

TABLES["t_listing"] = """
SELECT folder || '/' || folder || '_2025-10-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') || '-'
       || lpad(CAST((page_id // 140) % 24 AS VARCHAR), 2, '0') || '-00-00_' || page_id
       || CASE WHEN page_id % 11 = 10 THEN '.txt' ELSE '.mp4' END AS path, length(html) AS size, page_id AS seq
FROM (SELECT *, CASE WHEN page_id % 5 < 4 THEN 'camera' || (page_id % 5 + 1) ELSE 'other' END AS folder FROM pages)"""


def journey_tables(prefix: str, events: str) -> None:
    """C4-C6 over an event table."""
    pat = ", ".join(f"('{a}', '{b}')" for a, b in JOURNEY_PATTERNS)
    dist = " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in DISTANCES.items())
    first = ("min_by(t_sec, seq) FILTER (WHERE zone_name = p.{z} AND event_type = '{e}')")
    TABLES[f"{prefix}_times"] = f"""
SELECT video_ts, camera_id, tracker_id, p.a || ' -> ' || p.b AS pattern, p.a AS start_zone, p.b AS end_zone,
       {first.format(z='a', e='enter')} AS t1, {first.format(z='a', e='exit')} AS t2,
       {first.format(z='b', e='enter')} AS t3, {first.format(z='b', e='exit')} AS t4
FROM {events} CROSS JOIN (VALUES {pat}) AS p(a, b) GROUP BY ALL"""
    TABLES[f"{prefix}_journeys"] = f"""
SELECT *, distance_meters / total_journey_time AS speed_m_s, distance_meters / total_journey_time * 3.6e0 AS speed_km_h
FROM (SELECT *, CASE WHEN total_journey_time > 0 THEN CASE start_zone || '_to_' || end_zone {dist} END END AS distance_meters
      FROM (SELECT *, CASE WHEN is_valid THEN CASE WHEN t4 IS NOT NULL THEN 'complete' ELSE 'partial' END END AS journey_type,
                   CASE WHEN is_valid THEN t2 - t1 END AS time_in_start_zone,
                   CASE WHEN is_valid THEN t3 - t2 END AS time_between_zones,
                   CASE WHEN is_valid THEN t4 - t3 END AS time_in_end_zone,
                   CASE WHEN is_valid THEN coalesce(t4, t3) - t1 END AS total_journey_time
            FROM (SELECT *, coalesce(CASE WHEN t4 IS NOT NULL THEN t1 < t2 AND t2 < t3 AND t3 < t4
                                          ELSE t1 < t2 AND t2 < t3 END, false) AS is_valid
                  FROM {prefix}_times)))"""


journey_tables("t_trip", "t_trip_events")
journey_tables("t_day", "t_zone_events")


def spine(vehicles: str, w: float) -> str:
    return f"""
SELECT video_ts, camera_id, CAST(i AS INTEGER) AS window_idx, i * {w}e0 AS start_time, (i + 1) * {w}e0 AS end_time,
       {w}e0 AS window_duration
FROM (SELECT video_ts, camera_id, unnest(range(n)) AS i
      FROM (SELECT video_ts, camera_id, CAST(ceil(max(last_seen_time) / {w}e0) AS BIGINT) AS n
            FROM {vehicles} GROUP BY ALL))"""


TABLES["t_spine"] = spine("t_vehicles", 3600)
TABLES["t_trip_spine"] = spine(
    "(SELECT video_ts, camera_id, max(t_sec) AS last_seen_time FROM t_trip_events GROUP BY ALL)", 21600)

_counts = []
for _n, _z in (("entry", "enter"), ("exit", "exit")):
    _counts.append(f"count(*) FILTER (WHERE zone_name = '{_z}') AS {_n}_count")
    _counts += [f"count(*) FILTER (WHERE zone_name = '{_z}' AND class_name = '{c}') AS {_n}_count_{c}"
                for c in ("car", "truck", "bus", "motorcycle")]
_counts.append("count(*) FILTER (WHERE zone_name LIKE 'circulating%') AS circulating_flow_count")
TABLES["t_flow_raw"] = f"""
SELECT video_ts, camera_id, CAST(floor(t_sec / 3600e0) AS INTEGER) AS window_idx, {', '.join(_counts)}
FROM t_zone_events WHERE event_type = 'enter' GROUP BY ALL"""
_flow_names = [c.split(" AS ")[1] for c in _counts]
TABLES["t_flow"] = f"""
SELECT s.*, {', '.join(f'coalesce(f.{n}, 0) AS {n}' for n in _flow_names)},
       coalesce(f.entry_count, 0) / 60e0 AS entry_flow_rate, coalesce(f.exit_count, 0) / 60e0 AS exit_flow_rate,
       coalesce(f.circulating_flow_count, 0) / 60e0 AS circulating_flow_rate
FROM t_spine s LEFT JOIN t_flow_raw f USING (video_ts, camera_id, window_idx)"""

TABLES["t_samples"] = """
SELECT video_ts, camera_id, unnest(range(2 * n + 1)) AS sample
FROM (SELECT video_ts, camera_id, max(window_idx) + 1 AS n FROM t_spine GROUP BY ALL)"""
TABLES["t_occupied"] = """
SELECT video_ts, camera_id, zone_name, sample, count(*) AS vehicles
FROM (SELECT s.video_ts, s.camera_id, e.zone_name, s.sample, e.tracker_id,
             arg_max(e.event_type, (e.t_sec, e.seq)) AS state
      FROM t_samples s JOIN t_zone_events e
        ON e.video_ts = s.video_ts AND e.camera_id = s.camera_id AND e.t_sec <= s.sample * 1800e0
      GROUP BY ALL)
WHERE state = 'enter' GROUP BY ALL"""
TABLES["t_ring"] = """
SELECT video_ts, camera_id, sample, coalesce(sum(vehicles) FILTER (WHERE zone_name LIKE 'circulating%'), 0) AS n
FROM t_samples LEFT JOIN t_occupied USING (video_ts, camera_id, sample) GROUP BY ALL"""
TABLES["t_occupancy"] = """
SELECT a.video_ts, a.camera_id, CAST(a.sample // 2 AS INTEGER) AS window_idx, (a.n + b.n + c.n) / 3e0 AS circulating_occupancy_avg,
       CAST(greatest(a.n, b.n, c.n) AS BIGINT) AS circulating_occupancy_max,
       CAST(least(a.n, b.n, c.n) AS BIGINT) AS circulating_occupancy_min
FROM t_ring a JOIN t_ring b ON b.video_ts = a.video_ts AND b.camera_id = a.camera_id AND b.sample = a.sample + 1
JOIN t_ring c ON c.video_ts = a.video_ts AND c.camera_id = a.camera_id AND c.sample = a.sample + 2
WHERE a.sample % 2 = 0"""


def od_speed(prefix: str, spine_table: str, w: float) -> None:
    pairs = [("enter", "circulating_right"), ("enter", "exit"), ("circulating_left", "circulating_right"),
             ("circulating_left", "exit")]
    cols = ", ".join(
        f"count(*) FILTER (WHERE start_zone = '{a}' AND end_zone = '{b}') AS od_{a}_to_{b}" for a, b in pairs)
    names = [f"od_{a}_to_{b}" for a, b in pairs] + ["od_total_flow"]
    started = f"""(SELECT *, CAST(floor(t1 / {w}e0) AS INTEGER) AS window_idx FROM {prefix}_journeys WHERE is_valid)"""
    TABLES[f"{prefix}_od"] = f"""
SELECT s.video_ts, s.camera_id, s.window_idx, {', '.join(f'coalesce(o.{n}, 0) AS {n}' for n in names)}
FROM {spine_table} s LEFT JOIN (SELECT video_ts, camera_id, window_idx, {cols}, count(*) AS od_total_flow
     FROM {started} GROUP BY ALL) o USING (video_ts, camera_id, window_idx)"""
    TABLES[f"{prefix}_speed"] = f"""
SELECT s.video_ts, s.camera_id, s.window_idx, o.* EXCLUDE (video_ts, camera_id, window_idx)
FROM {spine_table} s LEFT JOIN (
  SELECT video_ts, camera_id, window_idx, avg(speed_km_h) AS speed_avg_km_h, stddev_pop(speed_km_h) AS speed_std_km_h,
         min(speed_km_h) AS speed_min_km_h, max(speed_km_h) AS speed_max_km_h,
         quantile_cont(speed_km_h, 0.5) AS speed_median_km_h,
         avg(speed_km_h) FILTER (WHERE start_zone = 'enter') AS entry_speed_avg_km_h,
         avg(speed_km_h) FILTER (WHERE start_zone LIKE '%circulating%') AS circulating_speed_avg_km_h
  FROM {started} WHERE speed_km_h IS NOT NULL GROUP BY ALL) o USING (video_ts, camera_id, window_idx)"""


od_speed("t_day", "t_spine", 3600)
od_speed("t_trip", "t_trip_spine", 21600)

TABLES["t_features"] = """
SELECT *, CASE WHEN entry_count + exit_count > 0 THEN (entry_count - exit_count) / CAST(entry_count + exit_count AS DOUBLE)
            ELSE 0e0 END AS entry_exit_balance,
       CASE WHEN circulating_flow_rate > 0 THEN entry_flow_rate / circulating_flow_rate ELSE entry_flow_rate END
         AS entry_circulating_ratio,
       0e0 AS flow_imbalance_index,
       CASE WHEN entry_flow_rate + exit_flow_rate > 0 THEN circulating_occupancy_avg / (entry_flow_rate + exit_flow_rate)
            ELSE circulating_occupancy_avg END AS occupancy_flow_ratio,
       CASE WHEN circulating_flow_rate > 0 THEN circulating_occupancy_avg / circulating_flow_rate
            ELSE circulating_occupancy_avg END AS circulating_density
FROM (SELECT f.*, CAST(hour(m) AS INTEGER) AS hour_of_day, CAST(isodow(m) - 1 AS INTEGER) AS day_of_week,
             CAST(isodow(m) >= 6 AS INTEGER) AS is_weekend, CAST(hour(m) IN (7, 8, 9, 16, 17, 18) AS INTEGER) AS is_rush_hour,
             hour(m) + minute(m) / 60e0 AS time_since_midnight
      FROM (SELECT *, video_ts + to_seconds(CAST(start_time AS BIGINT)) AS m FROM t_flow) f)
JOIN t_occupancy USING (video_ts, camera_id, window_idx)
JOIN t_day_od USING (video_ts, camera_id, window_idx)
JOIN t_day_speed USING (video_ts, camera_id, window_idx)"""

_lags = [f"lag({m}, {k}) OVER w AS {m}_lag_{k}" for m in LAG_METRICS for k in LAGS]
_rolls = [f"{f}({m}) OVER (PARTITION BY video_ts, camera_id ORDER BY window_idx ROWS {s - 1} PRECEDING) AS {m}_rolling_{n}_{s}"
          for m in ROLLING_METRICS for s in ROLLING for f, n in (("avg", "mean"), ("stddev_samp", "std"))]
LAG_NAMES = [c.split(" AS ")[-1] for c in _lags]
ROLL_NAMES = [c.split(" AS ")[-1] for c in _rolls]
TABLES["t_lagged"] = (f"SELECT video_ts, camera_id, window_idx, {', '.join(_lags)} FROM t_features "
                      "WINDOW w AS (PARTITION BY video_ts, camera_id ORDER BY window_idx)")
TABLES["t_rolled"] = f"SELECT video_ts, camera_id, window_idx, {', '.join(_rolls)} FROM t_features"
