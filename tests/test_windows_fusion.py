"""Window features, lags, fusion."""

import pytest
from collected import rows
from pyspark.sql import functions as F
from test_zones_journeys import events

from gyratory.operators import fusion as E
from gyratory.operators import windows as W


def seen(ev):
    return ev.select("video_ts", "camera_id", F.col("t_sec").alias("last_seen_time"))


def test_occupancy_of_worked_example(spark):
    z = "circulating_left"
    ev = events(spark, {1: [(z, "enter", 1.0), (z, "enter", 3.0), (z, "exit", 4.0)], 2: [(z, "exit", 2.0), (z, "enter", 2.0)],
                        3: [(z, "enter", 5.0)]})
    spine = spark.createDataFrame([(i,) for i in range(3)], "window_idx int").crossJoin(ev.select("video_ts", "camera_id").distinct())
    got = W.zone_occupancy(ev, spine, 2.0)
    assert [r[0] for r in rows(got.select("occupancy", "sample").orderBy("sample").select("occupancy"))] == [0, 1, 2, 2, 1, 2, 2]
    stats = W.occupancy_stats(ev, spine, 2.0).orderBy("window_idx").collect()
    assert [(r.circulating_occupancy_min, r.circulating_occupancy_max) for r in stats] == [(0, 2), (1, 2), (1, 2)]
    assert [r.circulating_occupancy_avg for r in stats] == [pytest.approx(x) for x in (1.0, 5 / 3, 5 / 3)]


def test_spine_has_empty_windows_and_nothing_for_nothing(spark):
    ev = events(spark, {1: [("enter", "enter", 1.0), ("enter", "exit", 650.0)]})
    spine = W.window_spine(seen(ev), 300.0)
    assert [r.window_idx for r in spine.orderBy("window_idx").collect()] == [0, 1, 2]
    flow = W.entry_flow(ev, spine, 300.0).orderBy("window_idx").collect()
    assert [r.entry_count for r in flow] == [1, 0, 0] and flow[0].entry_flow_rate == pytest.approx(0.2)
    assert W.window_spine(seen(ev.limit(0)), 300.0).count() == 0


def test_event_counts_add_up(spark):
    ev = events(spark, {i: [("enter", "enter", i * 7.0), ("exit", "enter", i * 7.0 + 3)] for i in range(60)})
    flow = W.flows(ev, W.window_spine(seen(ev), 50.0), 50.0).agg(F.sum("entry_count"), F.sum("exit_count")).first()
    assert tuple(flow) == (60, 60)


def test_features_without_journeys(spark):
    ev = events(spark, {1: [("enter", "enter", 10.0), ("bus", "enter", 20.0)]})
    none = spark.createDataFrame([], "video_ts timestamp, camera_id int, start_zone string, end_zone string, t1 double, is_valid boolean, speed_km_h double")
    r = W.extract_features(ev, seen(ev), none, 300.0).first()
    assert (r.entry_count, r.od_total_flow, r.speed_avg_km_h, r.entry_exit_balance) == (1, 0, None, 1.0)
    assert r.entry_circulating_ratio == pytest.approx(0.2) and r.circulating_density == 0.0
    assert (r.hour_of_day, r.day_of_week, r.is_rush_hour, r.time_since_midnight) == (6, 0, 0, 6.0)


def test_rolling_skips_nulls(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, None, 3.0, 5.0])], "window_idx int, entry_count double")
    df = df.withColumns({"video_ts": F.lit("2025-01-01").cast("timestamp"), "camera_id": F.lit(1)})
    out = W.add_rolling(W.add_lags(df), [3]).orderBy("window_idx").collect()
    assert [r.entry_count_rolling_mean_3 for r in out] == [1.0, 1.0, 2.0, 4.0]
    assert [r.entry_count_rolling_std_3 for r in out] == [None, None, pytest.approx(2 ** 0.5), pytest.approx(2 ** 0.5)]
    assert [r.entry_count_lag_1 for r in out] == [None, 1.0, None, 3.0]


def test_lags_across_videos(spark, both_paths):
    df = spark.createDataFrame([(f"2025-01-0{d}", i, d * 10 + i) for d in (1, 2) for i in range(4)], "d string, window_idx int, entry_count int")
    df = df.withColumns({"video_ts": F.col("d").cast("timestamp"), "camera_id": F.lit(1)})
    out = W.add_lags(df, [1], keys=["camera_id"]).orderBy("video_ts", "window_idx").collect()
    assert [r.entry_count_lag_1 for r in out] == [None, 10, 11, 12, 13, 20, 21, 22]


def features(spark, cams):
    data = [(c, 0, float(c), float(c) / 2, 1.0, None if c == 2 else c * 10.0, c * 2, c) for c in cams]
    df = spark.createDataFrame(
        data, "camera_id int, window_idx int, entry_flow_rate double, exit_flow_rate double, circulating_occupancy_avg double, "
              "speed_avg_km_h double, entry_count int, exit_count int")
    return df.withColumns({"video_ts": F.lit("2025-01-01").cast("timestamp"), "start_time": F.lit(0.0), "end_time": F.lit(300.0)})


def test_fusion_of_four_cameras(spark):
    r = E.target_placeholders(E.camera_interactions(E.fuse(features(spark, [1, 2, 3, 4])))).first()
    assert (r.total_entry_count, r.total_exit_count) == (20, 10)
    assert r.system_flow_balance == pytest.approx(1 / 3)
    assert r.avg_speed_km_h == pytest.approx(80 / 3) and (r.min_speed_km_h, r.max_speed_km_h, r.speed_range) == (10, 40, 30)
    assert r.entry_flow_imbalance == pytest.approx(1.2909944) and r.entry_flow_variance == pytest.approx(5 / 3)
    assert (r.NS_entry_diff, r.NS_through_flow, r.NS_EW_imbalance) == (2.0, 4.0, pytest.approx(-0.2))
    assert (r.cam1_cam3_entry_diff, r.cam2_cam4_flow_ratio) == (-4, pytest.approx(1 / 3))
    assert r.north_entry_congestion is None


def test_fusion_needs_all_cameras(spark):
    assert E.fuse(features(spark, [1, 2, 4])).count() == 0


def test_alignment(spark):
    df = features(spark, [1, 2]).withColumn("start_time", F.when(F.col("camera_id") == 2, 5.0).otherwise(0.0))
    assert rows(E.alignment_check(df).select("camera_id", "windows", "misaligned"), "camera_id") == [(1, 1, 0), (2, 1, 1)]
