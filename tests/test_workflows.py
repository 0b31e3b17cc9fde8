"""The end-to-end compositions on small inputs."""

from collected import rows
from pyspark.sql import functions as F
from test_zones_journeys import events

from gyratory.operators import journeys as J
from gyratory.operators import prep as P
from gyratory.plans import workflows as FL


def records(spark, phase, segments, start):
    data = [(start + i, s, phase, "low" if s % 2 else "none", "free flowing", "light delay") for i, s in enumerate(segments)]
    df = spark.createDataFrame(data, "label_id long, time_segment_id int, cycle_phase string, signaling string, "
                                     "congestion_enter_rating string, congestion_exit_rating string")
    ident = F.concat(F.lit("time_segment_"), F.col("time_segment_id").cast("string"), F.lit("_Camera #1_congestion_"))
    at = F.timestamp_seconds(F.lit(1_760_000_000) + F.col("time_segment_id") * 60)
    return df.withColumns({"view_label": F.lit("Camera #1"), "video_time": at, "video_ts": F.date_trunc("minute", at),
                           "ID_enter": F.concat(ident, F.lit("enter_rating")), "ID_exit": F.concat(ident, F.lit("exit_rating"))})


def template(spark, segments):
    ids = [(f"time_segment_{s}_Camera #1_congestion_{side}_rating", "x", "x") for s in segments for side in ("enter", "exit")]
    return spark.createDataFrame(ids, "ID string, Target string, Target_Accuracy string")


def test_forecasting_tables(spark):
    out = FL.forecasting_dataset(records(spark, "train", range(1, 21), 0), records(spark, "test_input_15", range(21, 31), 100),
                                 template(spark, range(31, 36)))
    assert out.features == sorted(P.BASE_FEATURES)
    assert (out.training.count(), out.validation.count(), out.testing.count()) == (26, 20, 10)
    assert out.testing.filter("signaling is null or hour is null").count() == 0
    shifted = out.training.filter(F.col("ID").contains("_8_")).first()
    assert shifted.signaling == 0  # the code of segment 1


def test_forecasting_tables_with_window_features(spark):
    train, test = records(spark, "train", range(1, 21), 0), records(spark, "test_input_15", range(21, 31), 100)
    feats = train.select("video_ts").crossJoin(spark.createDataFrame([(0, 1.0), (1, 2.0)], "window_idx int, total_entry_count double"))
    out = FL.forecasting_dataset(train, test, template(spark, range(31, 36)), feats)
    assert "total_entry_count" in out.features
    # two windows per segment, so seven rows back is three and a half segments
    assert out.training.count() == (20 * 2 - 7) * 2


def test_training_dataset(spark):
    spec = {i: [("enter", "enter", 10.0 * i), ("circulating_left", "enter", 10.0 * i + 1), ("circulating_left", "exit", 10.0 * i + 2),
                ("exit", "enter", 10.0 * i + 3)] for i in range(40)}
    ev = events(spark, spec).withColumn("camera_id", F.explode(F.array(*[F.lit(c) for c in (1, 2, 3, 4)])))
    sight = ev.select("video_ts", "camera_id", F.col("t_sec").alias("last_seen_time"))
    lab = spark.createDataFrame([(1, "north", 100, 160, "heavy delay")], "label_id int, direction string, a long, b long, congestion_enter_rating string")
    base = F.unix_micros(F.lit("2025-10-20 06:00:45").cast("timestamp"))
    lab = lab.withColumns({"datetime_start": F.timestamp_micros(base + F.col("a") * 1_000_000),
                           "datetime_end": F.timestamp_micros(base + F.col("b") * 1_000_000),
                           "congestion_exit_rating": F.lit(None).cast("string"), "signaling": F.lit("low")})
    out = FL.training_dataset(ev, sight, J.journeys_of(ev, {"circulating_left_to_exit": 20.0}), lab, 200.0)
    got = rows(out.select("window_idx", "total_entry_count", "north_entry_count_lag_1", "west_speed_avg_km_h",
                          "north_entry_congestion", "north_label_count"), "window_idx")
    assert got == [(0, 80, None, 36.0, "heavy delay", 1), (1, 80, 20, 36.0, None, 0)]
    made = FL.sequence_dataset(out.withColumns({f"{d}_entry_congestion": F.lit("free flowing") for d in ("north", "east", "south", "west")}),
                               ["total_entry_count"], size=2)
    assert rows(made.select("x", "y_encoded", "part")) == [([[80.0], [80.0]], [0, 0, 0, 0], "test")]
