"""Zone membership, zone events, journeys, visits."""

import math
import random

import pytest
from collected import rows
from pyspark.sql import functions as F

from gyratory.operators import journeys as J
from gyratory.operators import visits as V
from gyratory.operators import zones as Z

ZONES = [(1, "enter", [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0]]),
         (1, "exit", [[5.0, 5.0], [15.0, 5.0], [15.0, 15.0], [5.0, 15.0]]),
         (2, "enter", [[100.0, 100.0], [110.0, 100.0], [105.0, 120.0]])]
ZONE_DDL = "camera_id int, zone_name string, polygon array<array<double>>"
DET_DDL = ("video_name string, camera_id int, tracker_id long, frame_num int, timestamp_s double, class_id int, "
           "class_name string, x1 double, y1 double, x2 double, y2 double")


def det(tracker, frame, x, y, camera=1, name="car"):
    x, y = float(x), float(y)
    return ("v", camera, tracker, frame, frame / 10.0, 2, name, x - 1, y - 3, x + 1, y)


def test_anchor_is_bottom_centre_and_borders_are_half_open(spark):
    d = spark.createDataFrame(
        [det(1, 1, 0.0, 0.0), det(1, 2, 10.0, 5.0), det(1, 3, 7.0, 7.0), det(1, 4, 50.0, 50.0), det(2, 1, 105.0, 105.0, 2),
         det(3, 1, 5.0, 5.0, 9)], DET_DDL)
    out = Z.point_in_zone(d, spark.createDataFrame(ZONES, ZONE_DDL)).select("tracker_id", "frame_num", "zone_name")
    assert rows(out, "tracker_id", "frame_num", "zone_name") == [
        (1, 1, "enter"), (1, 2, "exit"), (1, 3, "enter"), (1, 3, "exit"), (2, 1, "enter")]


def test_zone_events_skip_unseen_frames_and_do_not_close_tracks(spark, both_paths):
    d = spark.createDataFrame(
        [det(1, 1, 50.0, 50.0), det(1, 2, 2.0, 2.0), det(1, 9, 3.0, 3.0), det(1, 10, 12.0, 12.0), det(2, 4, 2.0, 2.0),
         det(1, 11, 7.0, 7.0), det(1, 12, 7.0, 7.0)], DET_DDL)
    out = Z.detect_zone_events(d, spark.createDataFrame(ZONES, ZONE_DDL))
    got = rows(out.select("tracker_id", "frame_num", "event_type", "zone_name", "seq"), "tracker_id", "seq")
    assert got == [
        (1, 2, "enter", "enter", 2000), (1, 10, "enter", "exit", 10000), (1, 10, "exit", "enter", 10001),
        (1, 11, "enter", "enter", 11000), (2, 4, "enter", "enter", 4000)]


def test_lifecycle_keeps_the_first_class(spark):
    d = spark.createDataFrame([det(1, 5, 0, 0, name="bus"), det(1, 3, 0, 0, name="car"), det(1, 9, 0, 0, name="truck")], DET_DDL)
    r = Z.vehicle_lifecycle(d).first()
    assert (r.class_name, r.first_seen_frame, r.last_seen_frame, r.frames_seen) == ("car", 3, 9, 3)


EV = "video_ts timestamp, camera_id int, tracker_id long, seq long, t_sec double, zone_name string, event_type string, class_name string"


def events(spark, spec):
    """spec: tracker -> [(zone, type, t), ...] in list order."""
    data = [(t, i, s, z, e) for t, evs in spec.items() for i, (z, e, s) in enumerate(evs)]
    df = spark.createDataFrame(data, "tracker_id long, seq long, t_sec double, zone_name string, event_type string")
    return df.select(F.lit("2025-10-20 06:00:45").cast("timestamp").alias("video_ts"), F.lit(1).alias("camera_id"),
                     "tracker_id", "seq", "t_sec", "zone_name", "event_type", F.lit("car").alias("class_name"))


CL, CR = "circulating_left", "circulating_right"


def pattern(df, name):
    return {r.tracker_id: r for r in df.filter(F.col("pattern") == name).collect()}


def test_journey_rules(spark):
    ev = events(spark, {
        1: [(CL, "enter", 12.5), (CL, "exit", 14.0), (CR, "enter", 16.0), (CR, "exit", 18.5)],
        2: [(CL, "enter", 1.0), (CL, "exit", 5.0), (CR, "enter", 4.0), (CR, "exit", 9.0)],  # out of order, no fallback
        3: [(CL, "enter", 1.0), (CL, "exit", 2.0), (CR, "enter", 3.0)],  # partial
        4: [(CL, "enter", 1.0), (CR, "enter", 3.0)],  # incomplete
        5: [(CL, "enter", 9.0), (CL, "enter", 1.0), (CL, "exit", 2.0), (CR, "enter", 3.0)],  # first by list order
    })
    out = pattern(J.journeys_of(ev, {"circulating_right_to_circulating_left": 18.5}), f"{CL} -> {CR}")
    assert {t: r.is_valid for t, r in out.items()} == {1: True, 2: False, 3: True, 4: False, 5: False}
    assert out[1].journey_type == "complete" and out[1].total_journey_time == 6.0
    assert out[1].speed_m_s == pytest.approx(3.0833, abs=1e-4) and out[1].speed_km_h == pytest.approx(11.1)
    assert out[3].journey_type == "partial" and out[3].total_journey_time == 2.0 and out[3].time_in_end_zone is None
    assert out[2].journey_type is None and out[2].speed_km_h is None
    strict = pattern(J.validate_journeys(ev, partial_ok=False), f"{CL} -> {CR}")
    assert strict[1].is_valid and not strict[3].is_valid


def test_speed_needs_a_distance(spark):
    ev = events(spark, {1: [(CL, "enter", 1.0), (CL, "exit", 2.0), (CR, "enter", 3.0)]})
    for table in ({"other_to_pair": 3.0}, {f"{CL}_to_{CR}": 0.0}):
        assert pattern(J.journeys_of(ev, table), f"{CL} -> {CR}")[1].speed_km_h is None


def test_tracking_summary_counts_pairs(spark):
    ev = events(spark, {1: [(CL, "enter", 1.0), (CL, "exit", 2.0), (CR, "enter", 3.0), ("exit", "enter", 4.0)], 2: [(CL, "enter", 1.0)]})
    r = J.tracking_summary(J.validate_journeys(ev)).first()
    assert (r.total_vehicles_detected, r.valid_journeys_count, r.validation_rate, r.vehicles_with_valid_journey) == (2, 2, 1.0, 1)


def test_visits_keep_unpaired_sides(spark, both_paths):
    ev = events(spark, {1: [("exit", "exit", 1.0), ("exit", "enter", 2.0), ("exit", "exit", 5.0), ("exit", "enter", 6.0)],
                        2: [("enter", "enter", 1.0), ("enter", "enter", 2.0), ("enter", "exit", 3.0), ("enter", "exit", 4.0)]})
    out = V.zone_visits(ev).select("tracker_id", "time_entered", "time_exited", "duration")
    assert rows(out, "tracker_id", F.coalesce("time_entered", "time_exited")) == [
        (1, None, 1.0, None), (1, 2.0, 5.0, 3.0), (1, 6.0, None, None), (2, 1.0, None, None), (2, 2.0, 3.0, 1.0),
        (2, None, 4.0, None)]
    d = {r.zone_name: r for r in V.dwell_stats(V.zone_visits(ev)).collect()}
    assert (d["exit"].dwell_mean, d["exit"].dwell_count, d["exit"].dwell_std) == (3.0, 1, None)


def even_odd(polygon, x, y):
    odd = False
    for (xa, ya), (xb, yb) in zip(polygon, polygon[1:] + polygon[:1]):
        if (ya > y) != (yb > y) and x < xa + (xb - xa) * (y - ya) / (yb - ya):
            odd = not odd
    return odd


def test_grid_cells_equal_the_edges(spark):
    rng = random.Random(8)
    zones, points = [], []
    for camera in (1, 2, 3):
        for name in ("enter", "exit", "ring"):
            n = rng.choice([3, 4, 40, 1000])
            cx, cy, size = rng.uniform(0, 500), rng.uniform(0, 500), rng.uniform(1, 300)
            corners = [[cx + math.cos(2 * math.pi * i / n) * (r := size * rng.uniform(0.3, 1)), cy + math.sin(2 * math.pi * i / n) * r] for i in range(n)]
            zones.append((camera, name, corners))
            points += [(camera, *rng.choice(corners)) for _ in range(30)]
        zones.append((camera, "box", [[0.0, 0.0], [512.0, 0.0], [512.0, 256.0], [0.0, 256.0]]))
        points += [(camera, x, y) for x in (0.0, 16.0, 511.999, 512.0, 513.0) for y in (0.0, 8.0, 255.9, 256.0, -1.0)]
        points += [(camera, rng.uniform(-100, 700), rng.uniform(-100, 700)) for _ in range(1500)]
    zones.append((7, "flat", [[1.0, 1.0], [5.0, 1.0], [3.0, 1.0]]))
    points.append((7, 2.0, 1.0))
    d = spark.createDataFrame([det(i, 1, x, y, c) for i, (c, x, y) in enumerate(points)], DET_DDL)
    # the anchor is computed from the box, as the operator does
    where = {r["tracker_id"]: ((r["x1"] + r["x2"]) / 2, r["y2"]) for r in d.collect()}
    got = {r["tracker_id"]: r["zones"] for r in Z.zones_of_detections(d, spark.createDataFrame(zones, ZONE_DDL)).collect()}
    for i, (camera, _, _) in enumerate(points):
        assert got[i] == sorted(n for c, n, p in zones if c == camera and even_odd(p, *where[i])), points[i]


def test_border_cells_hold_few_edges(spark):
    corners = [[math.cos(i / 1000 * 2 * math.pi) * 100, math.sin(i / 1000 * 2 * math.pi) * 100] for i in range(1000)]
    cells = Z.grid_cells(spark.createDataFrame([(1, "ring", corners)], ZONE_DDL))[1]
    most, inside = cells.agg(F.max(F.size(F.get("border", 0)["edges"])), F.count_if(F.size("inside") > 0)).first()
    assert most < 150 and inside > 500
