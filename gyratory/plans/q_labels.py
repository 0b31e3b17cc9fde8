"""Queries E1-E9 and F1-F14."""

from __future__ import annotations

from pyspark.sql import functions as F

from gyratory.constants import DIRECTIONS, FUSED_FEATURES
from gyratory.operators import fusion as E
from gyratory.operators import labels as L
from gyratory.operators import windows as W
from gyratory.plans import inputs as I
from gyratory.plans import sql_tables as S
from gyratory.plans.q_windows import day_features, rounded
from gyratory.plans.registry import query
from gyratory.session import materialise

WIDTH = int(I.DAY_WINDOW)
INTS = {f for f in FUSED_FEATURES if "_count" in f} | {"circulating_occupancy_max"}
SPANS = ["start_time", "end_time", "window_duration", "time_since_midnight"]
CALENDAR = ["hour_of_day", "day_of_week", "is_weekend", "is_rush_hour"]
SIDES = ["entry", "exit"]


def _wide(names, ints):
    return ", ".join(
        (f"max({n}) FILTER (WHERE camera_id = {i + 1})") + f" AS {d}_{n}"
        for i, d in enumerate(DIRECTIONS) for n in names)


S.TABLES["t_merged"] = f"""
SELECT video_ts, window_idx, {', '.join(f'max({c}) FILTER (WHERE camera_id = 1) AS {c}' for c in [*SPANS, *CALENDAR])},
       {_wide(FUSED_FEATURES, INTS)},
       stddev_samp(entry_flow_rate) AS entry_flow_imbalance, var_samp(entry_flow_rate) AS entry_flow_variance,
       stddev_samp(exit_flow_rate) AS exit_flow_imbalance, stddev_samp(circulating_occupancy_avg) AS occupancy_imbalance
FROM t_features GROUP BY ALL HAVING count(*) = 4"""


def _sum(f):
    return " + ".join(f"{d}_{f}" for d in DIRECTIONS)


_SP = [f"{d}_speed_avg_km_h" for d in DIRECTIONS]
S.TABLES["t_fused"] = f"""
SELECT *, CASE WHEN total_entry_count + total_exit_count > 0
            THEN (total_entry_count - total_exit_count) / CAST(total_entry_count + total_exit_count AS DOUBLE) ELSE 0e0 END
            AS system_flow_balance,
       abs(north_entry_flow_rate - south_entry_flow_rate) AS NS_entry_diff,
       CASE WHEN north_entry_flow_rate + south_entry_flow_rate > 0 THEN (north_entry_flow_rate - south_entry_flow_rate)
            / (north_entry_flow_rate + south_entry_flow_rate) ELSE 0e0 END AS NS_entry_balance,
       abs(east_entry_flow_rate - west_entry_flow_rate) AS EW_entry_diff,
       CASE WHEN east_entry_flow_rate + west_entry_flow_rate > 0 THEN (east_entry_flow_rate - west_entry_flow_rate)
            / (east_entry_flow_rate + west_entry_flow_rate) ELSE 0e0 END AS EW_entry_balance,
       north_entry_flow_rate + south_entry_flow_rate AS NS_total_entry,
       east_entry_flow_rate + west_entry_flow_rate AS EW_total_entry,
       CASE WHEN {_sum('entry_flow_rate')} > 0 THEN (north_entry_flow_rate + south_entry_flow_rate
            - (east_entry_flow_rate + west_entry_flow_rate)) / ({_sum('entry_flow_rate')}) ELSE 0e0 END AS NS_EW_imbalance,
       (north_entry_count + south_entry_count) / 2e0 AS NS_through_flow,
       (east_entry_count + west_entry_count) / 2e0 AS EW_through_flow,
       max_speed_km_h - min_speed_km_h AS speed_range,
       north_entry_count - south_entry_count AS cam1_cam3_entry_diff,
       east_exit_flow_rate / (west_exit_flow_rate + 1e0) AS cam2_cam4_flow_ratio
FROM (SELECT *, {_sum('entry_count')} AS total_entry_count, {_sum('exit_count')} AS total_exit_count,
             {_sum('entry_flow_rate')} AS total_entry_flow_rate, {_sum('exit_flow_rate')} AS total_exit_flow_rate,
             {_sum('circulating_occupancy_avg')} AS total_circulating_occupancy,
             ({_sum('circulating_occupancy_avg')}) / 4e0 AS avg_circulating_occupancy,
             ({' + '.join(f'coalesce({c}, 0e0)' for c in _SP)})
               / nullif({' + '.join(f'CAST({c} IS NOT NULL AS INTEGER)' for c in _SP)}, 0) AS avg_speed_km_h,
             least({', '.join(_SP)}) AS min_speed_km_h, greatest({', '.join(_SP)}) AS max_speed_km_h
      FROM t_merged)"""


def fused(spark, sf):
    return E.fuse(day_features(spark, sf))


def every_number(spark, sf):
    """Fused windows with the comparisons of cameras."""
    return E.camera_interactions(fused(spark, sf))


def cols(names, ints=()):
    return ", ".join(n if n in ints else f"R({n}) AS {n}" for n in names)


_MERGED = [f"{d}_{f}" for d in DIRECTIONS for f in FUSED_FEATURES]
MERGED_INTS = {f"{d}_{f}" for d in DIRECTIONS for f in INTS}


@query("e1_merge_cameras", f"""
SELECT video_ts, window_idx, {', '.join(CALENDAR)}, {cols([*SPANS, *_MERGED], MERGED_INTS)} FROM t_merged""")
def e1(spark, sf):
    out = E.merge_cameras(day_features(spark, sf))
    return out.drop("entry_flow_imbalance", "entry_flow_variance", "exit_flow_imbalance", "occupancy_imbalance")


TOTALS = ["total_entry_count", "total_exit_count", "total_entry_flow_rate", "total_exit_flow_rate",
          "total_circulating_occupancy", "avg_circulating_occupancy", "avg_speed_km_h", "min_speed_km_h", "max_speed_km_h"]
TOTAL_INTS = {"total_entry_count", "total_exit_count"}


_OPPOSITE = ["NS_entry_diff", "NS_entry_balance", "EW_entry_diff", "EW_entry_balance"]
_DIRECTIONAL = ["NS_total_entry", "EW_total_entry", "NS_EW_imbalance", "NS_through_flow", "EW_through_flow", "speed_range"]
_IMBALANCE = ["entry_flow_imbalance", "entry_flow_variance", "exit_flow_imbalance", "occupancy_imbalance"]
#: Every number of a fused window.
FUSED = [*SPANS, *CALENDAR, *_MERGED, *_IMBALANCE, *TOTALS, "system_flow_balance", *_OPPOSITE, *_DIRECTIONAL, "cam1_cam3_entry_diff", "cam2_cam4_flow_ratio"]


def _fused_query(name, names, ints=()):
    @query(name, f"SELECT video_ts, window_idx, {cols(names, ints)} FROM t_fused")
    def run(spark, sf):
        return E.camera_interactions(fused(spark, sf)).select("video_ts", "window_idx", *names)


_fused_query("e2_roundabout_totals", TOTALS, TOTAL_INTS)
_fused_query("e3_system_flow_balance", ["system_flow_balance"])
_fused_query("e4_imbalance", _IMBALANCE)
_fused_query("e5_opposite_pairs", _OPPOSITE)
_fused_query("e6_directional", _DIRECTIONAL)
_fused_query("e9_camera_interactions", ["cam1_cam3_entry_diff", "cam2_cam4_flow_ratio"], {"cam1_cam3_entry_diff"})


@query("e8_alignment_check", """
WITH moved AS (SELECT video_ts, camera_id, CASE WHEN camera_id = 4 THEN window_idx + 1 ELSE window_idx END AS window_idx,
                      CASE WHEN camera_id = 3 THEN start_time + 1 ELSE start_time END AS start_time FROM t_spine)
SELECT s.video_ts, s.camera_id, count(*) AS windows, count(*) FILTER (WHERE r.start_time IS NULL) AS without_reference,
       count(*) FILTER (WHERE abs(r.start_time - s.start_time) > 1e-8 + 1e-3 * abs(s.start_time)) AS misaligned
FROM moved s LEFT JOIN (SELECT * FROM moved WHERE camera_id = 1) r USING (video_ts, window_idx)
GROUP BY s.video_ts, s.camera_id""")
def e8(spark, sf):
    spine = W.window_spine(I.sightings(I.zone_events(spark, sf)), I.DAY_WINDOW)
    # the third camera starts a second late, the fourth counts its windows from one
    camera = F.col("camera_id")
    moved = spine.withColumns({
        "window_idx": F.when(camera == 4, F.col("window_idx") + 1).otherwise(F.col("window_idx")),
        "start_time": F.when(camera == 3, F.col("start_time") + 1).otherwise(F.col("start_time")),
    })
    return E.alignment_check(moved)


# F: windows that all four cameras have, against the labels.
def windows(spark, sf):
    """Distinct (video, window) pairs with all four cameras."""
    spine = W.window_spine(I.sightings(I.zone_events(spark, sf)), I.DAY_WINDOW)
    return materialise(
        spine.groupBy("video_ts", "window_idx", "start_time", "end_time")
        .agg(F.count(F.lit(1)).alias("_n")).filter("_n = 4").drop("_n")
    )


S.TABLES["t_windows"] = """
SELECT video_ts, window_idx, start_time, end_time, video_ts + to_seconds(CAST(start_time AS BIGINT)) AS window_start,
       video_ts + to_seconds(CAST(end_time AS BIGINT)) AS window_end
FROM t_spine GROUP BY ALL HAVING count(*) = 4"""
S.TABLES["t_long_windows"] = f"""
SELECT w.*, d.direction FROM t_windows w CROSS JOIN (VALUES {', '.join(f"('{d}')" for d in DIRECTIONS)}) d(direction)"""
S.TABLES["t_pairs"] = """
SELECT w.video_ts, w.window_idx, w.direction, l.label_id, l.datetime_start, l.congestion_enter_rating,
       l.congestion_exit_rating, l.signaling, l.videos
FROM t_long_windows w JOIN t_ratings l
  ON l.direction = w.direction AND l.datetime_start < w.window_end AND l.datetime_end > w.window_start"""


@query("f1_overlap_join", """
SELECT w.video_ts, w.window_idx, w.direction, p.label_id FROM t_long_windows w
LEFT JOIN t_pairs p USING (video_ts, window_idx, direction)""")
def f1(spark, sf):
    long = L.by_direction(L.with_bounds(windows(spark, sf)))
    return L.overlap_join(long, I.ratings(spark, sf), WIDTH).select("video_ts", "window_idx", "direction", "label_id")


def mode_table(source, keys, column, name):
    """Most frequent value per key, smallest on ties."""
    return f"""SELECT {keys}, {column} AS {name} FROM (
  SELECT {keys}, {column}, row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, {column}) AS r
  FROM {source} WHERE {column} IS NOT NULL GROUP BY {keys}, {column}) WHERE r = 1"""


_K = "video_ts, window_idx, direction"
S.TABLES["t_mode_entry"] = mode_table("t_pairs", _K, "congestion_enter_rating", "entry_congestion")
S.TABLES["t_mode_exit"] = mode_table("t_pairs", _K, "congestion_exit_rating", "exit_congestion")
S.TABLES["t_mode_signal"] = mode_table("t_pairs", _K, "signaling", "signaling")
S.TABLES["t_counts"] = f"SELECT {_K}, count(*) AS label_count FROM t_pairs GROUP BY ALL"
S.TABLES["t_mode"] = f"""
SELECT {_K}, entry_congestion, exit_congestion, label_count, signaling FROM t_counts
LEFT JOIN t_mode_entry USING ({_K}) LEFT JOIN t_mode_exit USING ({_K}) LEFT JOIN t_mode_signal USING ({_K})"""
S.TABLES["t_worst"] = f"""
SELECT {_K}, {S.LABEL.format(i='max(e)')} AS entry_congestion, {S.LABEL.format(i='max(x)')} AS exit_congestion,
       count(*) AS label_count
FROM (SELECT *, {S.SEVERITY.format(c='congestion_enter_rating')} AS e, {S.SEVERITY.format(c='congestion_exit_rating')} AS x
      FROM t_pairs) GROUP BY {_K}"""
S.TABLES["t_latest"] = f"""
SELECT {_K}, congestion_enter_rating AS entry_congestion, congestion_exit_rating AS exit_congestion, label_count
FROM (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY datetime_start DESC, label_id DESC) AS r,
             count(*) OVER (PARTITION BY {_K}) AS label_count FROM t_pairs) WHERE r = 1"""


def _window_labels(spark, sf, aggregation):
    return L.window_labels(L.with_bounds(windows(spark, sf)), I.ratings(spark, sf), WIDTH, aggregation)


@query("f2_agg_mode", f"SELECT {_K}, entry_congestion, exit_congestion FROM t_mode")
def f2(spark, sf):
    return _window_labels(spark, sf, "mode").drop("label_count", "signaling")


@query("f3_agg_max", f"SELECT {_K}, entry_congestion, exit_congestion FROM t_worst")
def f3(spark, sf):
    return _window_labels(spark, sf, "max").drop("label_count", "signaling")


@query("f4_agg_last", f"SELECT {_K}, entry_congestion, exit_congestion FROM t_latest")
def f4(spark, sf):
    return _window_labels(spark, sf, "last").drop("label_count", "signaling")


@query("f5_signaling_counts_videos", f"""
SELECT {_K}, videos, count(*) AS records, any_value(label_count) AS label_count, any_value(m.signaling) AS signaling
FROM t_pairs JOIN t_mode m USING ({_K}) GROUP BY {_K}, videos""")
def f5(spark, sf):
    w, lab = L.with_bounds(windows(spark, sf)), I.ratings(spark, sf)
    totals = L.window_labels(w, lab, WIDTH).select(*L.WINDOW, "direction", "label_count", "signaling")
    return L.window_videos(w, lab, WIDTH).join(totals, [*L.WINDOW, "direction"])


_ATTACHED = [f"{d}_{c}" for d in DIRECTIONS for c in ("entry_congestion", "exit_congestion", "label_count", "signaling")]
S.TABLES["t_attached"] = f"""
SELECT w.video_ts, w.window_idx, {', '.join(
    (f"coalesce(max({c}) FILTER (WHERE m.direction = '{d}'), 0)" if c == 'label_count' else
     f"max({c}) FILTER (WHERE m.direction = '{d}')") + f' AS {d}_{c}'
    for d in DIRECTIONS for c in ('entry_congestion', 'exit_congestion', 'label_count', 'signaling'))}
FROM t_windows w LEFT JOIN t_mode m USING (video_ts, window_idx) GROUP BY ALL"""


def labelled(spark, sf, aggregation="mode"):
    """Fused windows with labels."""
    return L.attach_labels(materialise(fused(spark, sf)), I.ratings(spark, sf), WIDTH, aggregation)


@query("f6_attach_labels", f"""
SELECT video_ts, window_idx, total_entry_count, R(total_entry_flow_rate) AS total_entry_flow_rate, {', '.join(_ATTACHED)}
FROM t_fused JOIN t_attached USING (video_ts, window_idx)""")
def f6(spark, sf):
    return labelled(spark, sf).select(
        "video_ts", "window_idx", "total_entry_count", "total_entry_flow_rate", *_ATTACHED)


S.TABLES["t_by_hour"] = "SELECT *, CAST(hour(datetime_start) AS INTEGER) AS hour_of_day FROM t_ratings"
_H = "direction, hour_of_day"
S.TABLES["t_hour_entry"] = mode_table("t_by_hour", _H, "congestion_enter_rating", "entry_congestion")
S.TABLES["t_hour_exit"] = mode_table("t_by_hour", _H, "congestion_exit_rating", "exit_congestion")
S.TABLES["t_hour_signal"] = mode_table("t_by_hour", _H, "signaling", "signaling")
S.TABLES["t_hour_labels"] = f"""
SELECT * FROM (SELECT {_H}, count(*) AS label_count FROM t_by_hour GROUP BY ALL)
LEFT JOIN t_hour_entry USING ({_H}) LEFT JOIN t_hour_exit USING ({_H}) LEFT JOIN t_hour_signal USING ({_H})"""


@query("f7_hour_match_labels", f"""
SELECT w.video_ts, w.window_idx, w.hour_of_day, {', '.join(
    (f"coalesce(max({c}) FILTER (WHERE h.direction = '{d}'), 0)" if c == 'label_count' else
     f"max({c}) FILTER (WHERE h.direction = '{d}')") + f' AS {d}_{c}'
    for d in DIRECTIONS for c in ('entry_congestion', 'exit_congestion', 'label_count', 'signaling'))}
FROM (SELECT video_ts, window_idx, CAST(hour(window_start) AS INTEGER) AS hour_of_day FROM t_windows) w
LEFT JOIN t_hour_labels h USING (hour_of_day) GROUP BY ALL""")
def f7(spark, sf):
    w = L.with_bounds(windows(spark, sf)).select("video_ts", "window_idx", F.hour("window_start").alias("hour_of_day"))
    return L.hour_match_labels(w, I.ratings(spark, sf))


@query("f8_containment_join", """
SELECT s.video_ts, s.camera_id, s.window_idx, l.label_id, l.congestion_enter_rating
FROM t_spine s JOIN t_ratings l ON l.video_ts = s.video_ts AND l.camera_id = s.camera_id
 AND l.datetime_start >= s.video_ts + to_seconds(CAST(s.start_time AS BIGINT))
 AND l.datetime_start < s.video_ts + to_seconds(CAST(s.end_time AS BIGINT))""")
def f8(spark, sf):
    spine = W.window_spine(I.sightings(I.zone_events(spark, sf)), I.DAY_WINDOW)
    return L.containment_join(spine, I.ratings(spark, sf)).select(
        "video_ts", "camera_id", "window_idx", "label_id", "congestion_enter_rating")


@query("f9_join_features_on_timestamp", """
SELECT label_id, l.video_ts, f.window_idx, f.total_entry_count, R(f.total_exit_flow_rate) AS total_exit_flow_rate
FROM t_ratings l LEFT JOIN t_fused f USING (video_ts)""")
def f9(spark, sf):
    side = fused(spark, sf).select("video_ts", "window_idx", "total_entry_count", "total_exit_flow_rate")
    return L.join_features_on_timestamp(I.ratings(spark, sf).select("label_id", "video_ts"), side)


@query("f10_add_test_metadata", """
SELECT w.video_ts, w.window_idx, m.cycle_phase, m.view_label FROM t_windows w
LEFT JOIN (SELECT DISTINCT video_ts, cycle_phase, view_label FROM t_ratings WHERE cycle_phase <> 'train') m USING (video_ts)""")
def f10(spark, sf):
    segments = I.ratings(spark, sf).filter("cycle_phase <> 'train'")
    return L.add_test_metadata(
        windows(spark, sf).select("video_ts", "window_idx"), segments, ["cycle_phase", "view_label"])


_LABELS = [f"{d}_{s}_congestion" for d in DIRECTIONS for s in SIDES]
S.TABLES["t_label_cells"] = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS label FROM t_attached" for c in _LABELS)


@query("f11_coverage_report", """
WITH per AS (SELECT column_name, count(*) AS total, count(label) AS filled FROM t_label_cells GROUP BY ALL)
SELECT column_name, '(any)' AS label, filled AS n, R(filled * 100e0 / total) AS percent FROM per
UNION ALL SELECT '(all)', '(any)', CAST(sum(filled) AS BIGINT), R(sum(filled) * 100e0 / sum(total)) FROM per
UNION ALL SELECT column_name, label, count(*), R(count(*) * 100e0 / any_value(filled)) FROM t_label_cells
  JOIN per USING (column_name) WHERE label IS NOT NULL GROUP BY column_name, label""")
def f11(spark, sf):
    return L.coverage_report(L.attach_labels(windows(spark, sf), I.ratings(spark, sf), WIDTH))


@query("f12_null_diagnostics", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_empty, "
    f"R((count(*) - count({c})) * 100e0 / count(*)) AS percent_or_mean, '{stage}' AS stage FROM {t}"
    for t, stage, names in (("t_ratings", "raw", ["congestion_enter_rating", "congestion_exit_rating"]),
                            ("t_attached", "processed", _LABELS)) for c in names) + " UNION ALL " + " UNION ALL ".join(
    f"SELECT '{d}_label_count', count(*), count(*) FILTER (WHERE {d}_label_count = 0), R(avg({d}_label_count)), "
    f"'label_count' FROM t_attached" for d in DIRECTIONS) + ")")
def f12(spark, sf):
    raw = I.ratings(spark, sf)
    return L.null_diagnostics(raw, L.attach_labels(windows(spark, sf), raw, WIDTH))


S.TABLES["t_attached_worst"] = f"""
SELECT w.video_ts, w.window_idx, {', '.join(
    f"max({c}) FILTER (WHERE m.direction = '{d}') AS {d}_{c}" for d in DIRECTIONS for c in ('entry_congestion', 'exit_congestion'))}
FROM t_windows w LEFT JOIN t_worst m USING (video_ts, window_idx) GROUP BY ALL"""


@query("f13_relabel", f"SELECT video_ts, window_idx, {', '.join(_LABELS)} FROM t_attached_worst")
def f13(spark, sf):
    raw = I.ratings(spark, sf)
    first = L.attach_labels(windows(spark, sf), raw, WIDTH)
    return L.relabel(first, raw, WIDTH, "max").select("video_ts", "window_idx", *_LABELS)


@query("f14_id_set_diff", """
WITH a AS (SELECT ID_enter AS ID FROM t_ratings WHERE cycle_phase <> 'train'),
     b AS (SELECT ID_enter AS ID FROM t_ratings WHERE cycle_phase <> 'test_output_5')
SELECT DISTINCT ID, 'missing' AS side FROM b WHERE ID NOT IN (SELECT ID FROM a)
UNION ALL SELECT DISTINCT ID, 'extra' FROM a WHERE ID NOT IN (SELECT ID FROM b)""")
def f14(spark, sf):
    rows = I.ratings(spark, sf).withColumnRenamed("ID_enter", "ID")
    return L.id_set_diff(rows.filter("cycle_phase <> 'train'"), rows.filter("cycle_phase <> 'test_output_5'"))
