"""Scalars, preparation, sequences, splits, metrics."""

import pytest
from collected import rows
from pyspark.sql import functions as F

from gyratory.functions import scalars as B
from gyratory.operators import history as J
from gyratory.operators import metrics as M
from gyratory.operators import prep as P
from gyratory.operators import profile as R
from gyratory.operators import sequences as Q

FREE, LIGHT, MODERATE, HEAVY = "free flowing", "light delay", "moderate delay", "heavy delay"


def test_parsing(spark):
    df = spark.createDataFrame([("site1/site1_2025-10-20-06-00-45.mp4", "Site #2"), ("readme.txt", "odd"), (None, None)], "p string, v string")
    out = df.select(B.extract_timestamp("p"), B.parse_video_ts(B.extract_timestamp("p")).cast("string"), B.camera_id("p"),
                    B.direction_of(B.camera_of_view("v")), B.video_basename("p"))
    assert rows(out) == [("2025-10-20-06-00-45", "2025-10-20 06:00:45", 1, "east", "site1_2025-10-20-06-00-45"),
                         (None, None, None, None, "readme.txt"), (None, None, None, None, None)]
    bad = spark.createDataFrame([("2025-13-40-06-00-45",)], "p string").select(B.parse_video_ts("p"))
    assert rows(bad) == [(None,)]


def test_submission_id(spark):
    df = spark.createDataFrame([("time_segment_181_Some Place #1_congestion_enter_rating", "x", "y")], "ID string, Target string, Target_Accuracy string")
    r = B.parse_submission_id(df).first()
    assert (r.time_segment_id, r.view_label, r.ID_type, r.cycle_phase) == (181, "Some Place #1", "ID_enter", "test_output_5")
    assert "Target" not in r.asDict()


def test_encoding(spark):
    df = spark.createDataFrame([(FREE,), (HEAVY,), (None,), ("nan",)], "l string")
    assert rows(df.select(B.encode_congestion("l"))) == [(0,), (3,), (-1,), (-1,)]
    odd = spark.createDataFrame([("jam",)], "l string")
    assert rows(odd.select(B.encode_congestion("l", "missing"))) == [(-1,)]
    with pytest.raises(Exception, match="unknown congestion label"):
        odd.select(B.encode_congestion("l")).collect()
    flows = spark.createDataFrame([(1.9,), (2.0,), (5.9,), (6.0,), (None,)], "f double")
    assert rows(flows.select(B.rule_label("f"))) == [(FREE,), (LIGHT,), (MODERATE,), (HEAVY,), (None,)]


def test_codes_by_first_appearance(spark):
    train = spark.createDataFrame([(3, "b"), (1, None), (2, "a")], "i int, s string")
    test = spark.createDataFrame([(1, "c"), (2, "a")], "i int, s string")
    a, b = B.encode_by_first_appearance(train, test, "s", "i")
    assert rows(a.select("i", "s"), "i") == [(1, -1), (2, 0), (3, 1)]
    assert rows(b.select("i", "s"), "i") == [(1, 2), (2, 0)]


def long_rows(spark, n=12):
    data = [("c", "ID_enter", i, f"id{i:02d}", "train" if i < 8 else "test_input_15" if i < 10 else "test_output_5", FREE,
             float(i) if i != 2 else None) for i in range(n)]
    return spark.createDataFrame(data, "view_label string, ID_type string, time_segment_id int, ID string, cycle_phase string, congestion_rating string, f double")


def test_shift_drops_incomplete_training_rows_only(spark, both_paths):
    out = P.shift_features(long_rows(spark), ["f"], 7)
    assert rows(out.select("ID", "f"), "ID") == [("id07", 0.0), ("id08", 1.0), ("id10", 3.0), ("id11", 4.0)]
    short = P.shift_features(long_rows(spark), ["f"], 9)
    assert rows(short.select("ID", "f"), "ID") == [("id09", 0.0), ("id10", 1.0), ("id11", None)]


def test_median_fill(spark):
    train = spark.createDataFrame([(1.0, 1), (2.0, 4), (None, 9)], "a double, b int")
    test = spark.createDataFrame([(None, None), (7.0, 3)], "a double, b int")
    assert rows(P.fill_with_train_median(test, train, ["a", "b"])) == [(1.5, 4.0), (7.0, 3.0)]


def test_feature_selection(spark):
    df = spark.createDataFrame([(1.0, None, 1, "x"), (None, None, 2, "y")], "speed_a double, od_b double, hour int, note string")
    assert P.select_features(df) == ["hour", "speed_a"]
    assert P.feature_columns(spark.createDataFrame([], "window_idx int, a double, north_entry_congestion string, north_signaling string")) == ["a"]


def test_lag_policies(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([None, 1.0, None, 2.0])], "window_idx int, x double").withColumns(
        {"video_ts": F.lit(1), "camera_id": F.lit(1)})
    assert [r.x for r in P.missing_lag_policy(df, ["x"], "ffill").orderBy("window_idx").collect()] == [None, 1.0, 1.0, 2.0]
    assert P.missing_lag_policy(df, ["x"], "drop").count() == 1
    assert [r.x for r in P.missing_lag_policy(df, ["x"], "zero").orderBy("window_idx").collect()] == [0.0, 1.0, 0.0, 2.0]


def test_grouped_lags(spark, both_paths):
    out = P.grouped_lags(long_rows(spark), ["f"], [1, 3], 3).orderBy("time_segment_id").collect()
    assert [r.f_lag_3 for r in out[:6]] == [None, None, None, 0.0, 1.0, None]
    assert [r.f_rolling_3 for r in out[:7]] == [None, None, None, None, None, 4.0, 5.0]


def test_zscore(spark):
    cells = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, "a", None), (1, "b", 5.0), (2, "b", 5.0), (1, "c", None)], "k int, feature string, value double")
    out = P.zscore_apply(cells, P.zscore_fit(cells)).select("feature", "k", "value")
    assert rows(out, "feature", "k") == [("a", 1, -1.0), ("a", 2, 1.0), ("a", 3, 0.0), ("b", 1, 0.0), ("b", 2, 0.0), ("c", 1, 0.0)]


def seq_input(spark, minutes, labels=4):
    data = [(i, float(i), *[FREE if j < labels else None for j in range(4)]) for i in range(len(minutes))]
    ddl = "i int, a double, " + ", ".join(f"{t} string" for t in Q.ENTRY_TARGETS)
    df = spark.createDataFrame(data, ddl)
    start = F.unix_micros(F.lit("2025-10-20 23:00:00").cast("timestamp"))
    at = F.element_at(F.array(*[F.lit(m) for m in minutes]), F.col("i") + 1).cast("bigint")
    return df.withColumns({"video_ts": F.timestamp_micros(start + at * 60_000_000), "window_idx": F.lit(0)})


def test_sequences(spark):
    steady = list(range(0, 40, 5))
    assert Q.sequences(seq_input(spark, steady), ["a"], size=3).count() == 6
    assert [r.start_timestamp.minute for r in Q.sequences(seq_input(spark, steady), ["a"], size=3, stride=2).orderBy("sequence_id").collect()] == [0, 10, 20]
    assert Q.sequences(seq_input(spark, [0, 5, 10, 30, 35, 40]), ["a"], size=3).count() == 2  # gap over ten minutes
    assert Q.sequences(seq_input(spark, steady, labels=2), ["a"], size=3).count() == 0
    split = Q.sequences(seq_input(spark, [50, 55, 60, 65]), ["a"], size=2)  # midnight falls between
    assert rows(split.select("sequence_id", "x"), "sequence_id") == [(0, [[0.0], [1.0]]), (1, [[2.0], [3.0]])]


@pytest.mark.parametrize("n,train", [(15, 12), (4009, 3207)])
def test_temporal_split_sizes(spark, n, train, both_paths):
    df = spark.range(n).select(F.col("id").alias("sequence_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(F.col("id") / 7) * 60).alias("end_timestamp"))
    out = Q.temporal_split(df)
    assert out.filter("part = 'train'").agg(F.count("*"), F.max("sequence_id")).first()[:] == (train, train - 1)


def test_embargo_and_aggregates(spark):
    data = [(i, float(i * i), i * 300.0, (i + 1) * 300.0, str(i)) for i in range(6)]
    df = spark.createDataFrame(data, "window_idx int, a double, start_time double, end_time double, y string").withColumn("video_ts", F.lit(1))
    e = Q.embargo_sequences(df, ["a"], ["y"]).orderBy("window_idx").collect()
    assert [(r.a_t0, r.a_t1, r.a_t2, r.y_y, r.output_start_time) for r in e] == [(0.0, 1.0, 4.0, "4", 1200.0), (1.0, 4.0, 9.0, "5", 1500.0)]
    g = Q.recent_aggregates(df, ["a"]).orderBy("window_idx").collect()
    assert [(r.momentum_a, r.accel_a, r.min_15min_a) for r in g] == [(4.0, 2.0, 0.0), (8.0, 2.0, 1.0), (12.0, 2.0, 4.0), (16.0, 2.0, 9.0)]
    h = Q.horizon_targets(df, [3], ["y"]).orderBy("window_idx").collect()
    assert [r.y_t3 for r in h] == ["3", "4", "5", None, None, None]


GOLD_Y = [[0, 1, -1, 0], [0, 0, -1, -1], [2, 1, -1, 0], [-1, -1, -1, 1]]
GOLD_P = [
    [[0.9, 0.05, 0.03, 0.02], [0.1, 0.8, 0.05, 0.05], [0.25] * 4, [0.7, 0.1, 0.1, 0.1]],
    [[0.8, 0.1, 0.05, 0.05], [0.7, 0.15, 0.1, 0.05], [0.25] * 4, [0.25] * 4],
    [[0.1, 0.1, 0.7, 0.1], [0.2, 0.6, 0.1, 0.1], [0.25] * 4, [0.6, 0.2, 0.1, 0.1]],
    [[0.25] * 4, [0.25] * 4, [0.25] * 4, [0.1, 0.8, 0.05, 0.05]],
]
NAMES = ["north", "east", "south", "west"]


def gold(spark):
    data = [(i, NAMES[j], GOLD_Y[i][j], GOLD_P[i][j]) for i in range(4) for j in range(4)]
    return spark.createDataFrame(data, "sequence_id int, direction string, y_true int, probs array<double>")


def test_masked_loss_and_accuracy(spark):
    r = M.masked_cross_entropy(gold(spark)).first()
    assert (r.n_valid, r.loss_sum, r.loss) == (9, pytest.approx(2.86647, abs=1e-5), pytest.approx(0.318497, abs=1e-5))
    nothing = M.masked_cross_entropy(gold(spark).filter("y_true = -1")).first()
    assert (nothing.n_valid, nothing.loss) == (0, 0.0)
    acc = {r.direction: r.accuracy for r in M.masked_accuracy(M.argmax_predictions(gold(spark))).collect()}
    assert acc == {"north": 1.0, "east": 1.0, "west": 1.0, "(mean)": 1.0}


def test_confusion_and_scores(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1), (1, 0), (2, 0)], "y_true int, y_pred int")
    conf = M.confusion_matrix(df)
    assert conf.count() == 16 and conf.agg(F.sum("n")).first()[0] == 6
    prf = {r.label: r for r in M.per_class_prf(conf).collect()}
    assert (prf[0].precision, prf[0].recall, prf[2].f1, prf[3].support) == (0.5, pytest.approx(2 / 3), 0.0, 0)
    s = M.summary_scores(M.per_class_prf(conf)).first()
    f0, f1 = 4 / 7, 0.5
    assert s.macro_f1 == pytest.approx((f0 + f1) / 3) and s.accuracy == pytest.approx(0.5)
    assert s.balanced_accuracy == pytest.approx((2 / 3 + 0.5) / 3) and s.weighted_f1 == pytest.approx((3 * f0 + 2 * f1) / 6)


def test_argmax_takes_the_first(spark):
    df = spark.createDataFrame([([0.4, 0.4, 0.1, 0.1],), ([0.1, 0.2, 0.3, 0.4],)], "probs array<double>")
    assert [r.y_pred for r in M.argmax_predictions(df).collect()] == [0, 3]


def test_soft_vote(spark):
    a = spark.createDataFrame([(1, [0.6, 0.4])], "sequence_id int, probs array<double>")
    b = spark.createDataFrame([(1, [0.1, 0.9])], "sequence_id int, probs array<double>")
    assert M.soft_vote([a, b]).first().y_pred == 1 and M.soft_vote([a, b], [9.0, 1.0]).first().y_pred == 0


def test_thresholds_smallest_best_wins(spark):
    df = spark.createDataFrame([(0, [0.5, 0.5]), (1, [0.2, 0.8]), (1, [0.32, 0.68])], "y_true int, probs array<double>")
    out = {r.label: (round(r.threshold, 2), r.f1) for r in M.tune_thresholds(df).collect()}
    assert out == {0: (0.35, 1.0), 1: (0.55, 1.0)}


def test_weights_and_undersampling(spark, both_paths):
    df = spark.createDataFrame([(i, "a" if i % 4 else "b") for i in range(40)] + [(99, None)], "i int, l string")
    w = {r.l: (r.n, r.weight) for r in M.class_weights(df, "l").collect()}
    assert w == {"a": (30, pytest.approx(40 / 60)), "b": (10, 2.0)}
    s = M.undersample(df, "l", "i", 5)
    assert {r.l: r["count"] for r in s.groupBy("l").count().collect()} == {"a": 10, "b": 10}
    assert set(rows(s)) == set(rows(M.undersample(df, "l", "i", 5)))


def test_submission(spark):
    template = spark.createDataFrame([("x", 0), ("y", 1)], "ID string, row_order int")
    sub = M.build_submission(spark.createDataFrame([("y", FREE), ("z", FREE)], "ID string, Target string"), template)
    r = M.validate_submission(sub, template).first()
    assert (r.rows, r.expected_rows, r.missing_ids, r.extra_ids, r.out_of_order, r.empty_targets) == (2, 2, 0, 0, 0, 1)
    d = {r.label: r.n for r in M.prediction_distribution(sub).collect()}
    assert d == {FREE: 1, LIGHT: 0, MODERATE: 0, HEAVY: 0}


def test_history(spark, both_paths):
    sev = [0, 0, 1, 1, 1, None, None, 2, 2, 2, 2, 2]
    df = spark.createDataFrame([("c", "e", i, f"{i:02d}", v) for i, v in enumerate(sev)], "view_label string, ID_type string, time_segment_id int, ID string, severity int")
    assert [r.persistence for r in J.persistence(df).orderBy("ID").collect()] == [0, 1, 0, 1, 2, 0, 1, 0, 1, 2, 3, 4]
    t = J.trends(df, span=3, half=1, short=2).orderBy("ID").collect()
    assert t[2].trend_slope == pytest.approx(0.5) and t[4].trend_slope == 0.0
    assert (t[2].changed, t[2].worsening, t[2].improving, t[0].changed) == (1, 1, 0, None)


def test_profile(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, "x"), (4.0, "y"), (9.0, None)], "a double, b string")
    assert rows(R.missing_values(df, 1)) == [("b", 2, 50.0)]
    d = R.describe(df, ["a"]).first()
    assert (d["count"], d["mean"], d["q25"], d["q50"], d["q75"]) == (4, 4.0, 1.75, 3.0, 5.25)
    v = spark.createDataFrame([(0.0, x) for x in (0.0, 5.0, 10.0)], "first_seen_time double, last_seen_time double")
    assert rows(R.duration_histogram(v, 2), "bin") == [(0, 1), (1, 2)]
    c = spark.createDataFrame([(FREE, 1.0), (LIGHT, 2.0), (MODERATE, 3.0), (None, 9.0)], "y string, f double")
    assert R.top_correlations(c, ["f"], "y").first().correlation == pytest.approx(1.0)


def test_gaps(spark, both_paths):
    stamps = ["2025-01-01 10:00:00", "2025-01-01 10:00:00", "2025-01-01 10:05:00", "2025-01-01 10:10:00", "2025-01-02 00:10:00"]
    df = spark.createDataFrame([(s,) for s in stamps], "s string").select(F.col("s").cast("timestamp").alias("video_ts"))
    r = R.gap_analysis(df).first()
    assert (r.records, r.distinct_timestamps, r.min_gap, r.max_gap, r.most_common_gap) == (5, 4, 0.0, 50400.0, 300.0)
