"""Interval joins and label aggregation."""

import random

import pytest
from collected import rows
from pyspark.sql import functions as F

from gyratory.operators import labels as L

BASE = "2025-10-20 06:00:00"


def windows(spark, spans):
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(spans)], "window_idx int, start_time double, end_time double")
    return df.withColumn("video_ts", F.lit(BASE).cast("timestamp"))


def labels(spark, data):
    df = spark.createDataFrame(data, "label_id int, direction string, s double, e double, congestion_enter_rating string, congestion_exit_rating string, signaling string")

    def at(c):
        return F.timestamp_micros(F.unix_micros(F.lit(BASE).cast("timestamp")) + (F.col(c) * 1e6).cast("bigint"))

    return df.withColumns({"datetime_start": at("s"), "datetime_end": at("e"), "videos": F.lit("a/b.mp4")}).drop("s", "e")


def lab(i, s, e, enter=None, leave=None, signal=None, direction="north"):
    return (i, direction, float(s), float(e), enter, leave, signal)


def test_overlap_borders(spark):
    w = L.by_direction(L.with_bounds(windows(spark, [(60, 120)]))).filter("direction = 'north'")
    for span, hit in (((0, 60), 0), ((59, 61), 1), ((120, 130), 0), ((30, 200), 1), ((60, 60), 0), ((90, 90), 1)):
        assert L.overlap_join(w, labels(spark, [lab(1, *span)]), 60, "inner").count() == hit, span


def test_bucketed_join_equals_naive(spark):
    rng = random.Random(5)
    spans = [(a, a + rng.choice([30, 300, 700])) for a in (rng.randint(-500, 5000) for _ in range(60))]
    data = [lab(i, s, s + rng.choice([1, 59, 400, 3000])) for i, s in enumerate(rng.randint(-900, 6000) for _ in range(80))]
    w = L.by_direction(L.with_bounds(windows(spark, spans))).filter("direction = 'north'")
    got = L.overlap_join(w, labels(spark, data), 300, "inner").select("window_idx", "label_id").collect()
    want = {(i, d[0]) for i, (a, b) in enumerate(spans) for d in data if d[2] < b and d[3] > a}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_left_join_keeps_empty_windows(spark):
    w = L.by_direction(L.with_bounds(windows(spark, [(0, 60), (600, 660)])))
    out = L.overlap_join(w, labels(spark, [lab(1, 10, 20)]), 60)
    assert out.count() == 8 and out.filter("label_id is not null").count() == 1


LIGHT, FREE, HEAVY = "light delay", "free flowing", "heavy delay"


def test_aggregations(spark):
    data = [lab(1, 0, 10, LIGHT, None, "b"), lab(2, 1, 10, FREE, None, "a"), lab(3, 2, 10, LIGHT, None, None),
            lab(4, 3, 10, FREE, "odd"), lab(5, 4, 10, HEAVY), lab(6, 5, 10, None)]
    w = L.with_bounds(windows(spark, [(0, 60)]))
    got = {a: L.window_labels(w, labels(spark, data), 60, a).first() for a in ("mode", "max", "last")}
    assert got["mode"].entry_congestion == FREE and got["mode"].signaling == "a" and got["mode"].label_count == 6
    assert got["max"].entry_congestion == HEAVY and got["max"].exit_congestion is None
    assert got["last"].entry_congestion is None
    with pytest.raises(ValueError):
        L.label_aggregates("median")


def test_attach_and_relabel(spark):
    w = windows(spark, [(0, 60), (60, 120)])
    out = L.attach_labels(w, labels(spark, [lab(1, 5, 20, LIGHT, FREE, "x"), lab(2, 70, 80, HEAVY, direction="west")]), 60)
    assert rows(out.select("window_idx", "north_entry_congestion", "north_label_count", "west_entry_congestion", "west_label_count", "east_label_count"), "window_idx") == [
        (0, LIGHT, 1, None, 0, 0), (1, None, 0, HEAVY, 1, 0)]
    again = L.relabel(out, labels(spark, [lab(3, 5, 20, HEAVY)]), 60)
    assert again.columns == out.columns and again.filter("window_idx = 0").first().north_entry_congestion == HEAVY


def test_coverage_and_id_diff(spark):
    df = spark.createDataFrame([(LIGHT, None), (LIGHT, FREE), (None, None), (FREE, None)], "a_congestion string, b_congestion string")
    got = {(r.column_name, r.label): (r.n, r.percent) for r in L.coverage_report(df).collect()}
    assert got[("a_congestion", "(any)")] == (3, 75.0) and got[("(all)", "(any)")] == (4, 50.0)
    assert got[("a_congestion", LIGHT)][1] == pytest.approx(200 / 3)
    a, b = spark.createDataFrame([("1",), ("2",)], "ID string"), spark.createDataFrame([("2",), ("3",)], "ID string")
    assert set(rows(L.id_set_diff(a, b))) == {("3", "missing"), ("1", "extra")}


def test_containment(spark):
    w = windows(spark, [(0, 60), (60, 120)]).withColumns({"camera_id": F.lit(1), "window_duration": F.lit(60.0)})
    la = labels(spark, [lab(1, 59.999999, 70), lab(2, 60, 70), lab(3, 130, 140)]).withColumns(
        {"video_ts": F.lit(BASE).cast("timestamp"), "camera_id": F.lit(1)})
    assert rows(L.containment_join(w, la).select("label_id", "window_idx"), "label_id") == [(1, 0), (2, 1)]
