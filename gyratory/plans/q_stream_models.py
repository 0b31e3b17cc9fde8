"""Queries K1-K3 (streams drained to the end, then equal to their batch twins) and H16-H20."""

from __future__ import annotations

from pyspark.sql import functions as F

from gyratory import schemas
from gyratory.constants import COUNTED_CLASSES
from gyratory.functions import scalars as B
from gyratory.operators import boosting as X
from gyratory.operators import ensembles as N
from gyratory.operators import labels as L
from gyratory.operators import models as M
from gyratory.operators import prep as P
from gyratory.plans import inputs as I
from gyratory.plans import sql_tables as S
from gyratory.plans.q_labels import FUSED, WIDTH, every_number
from gyratory.plans.q_windows import zone_table
from gyratory.plans.registry import query
from gyratory.session import materialise, scratch
from gyratory.streaming import events as E

S.TABLES["t_hourly"] = ("SELECT camera_id, date_trunc('hour', video_ts + to_microseconds(CAST(round(t_sec * 1e6) AS BIGINT))) AS window_start, "
    + ", ".join(f"count(*) FILTER (WHERE zone_name = '{z}') AS {n}_count, " + ", ".join(
        f"count(*) FILTER (WHERE zone_name = '{z}' AND class_name = '{c}') AS {n}_count_{c}" for c in COUNTED_CLASSES)
        for n, z in (("entry", "enter"), ("exit", "exit")))
    + ", count(*) FILTER (WHERE zone_name LIKE 'circulating%') AS circulating_flow_count "
    + "FROM t_zone_events WHERE event_type = 'enter' GROUP BY ALL")


def detection_time():
    return F.timestamp_micros((F.col("timestamp_s") * 1_000_000).cast("bigint"))


@query("k1_stream_zone_events", """
SELECT camera_id, tracker_id, frame_num, event_type, zone_name,
       CAST(frame_num AS BIGINT) * 1000 + row_number() OVER (PARTITION BY camera_id, tracker_id, frame_num
            ORDER BY event_type, zone_name) - 1 AS seq FROM t_track_events""")
def k1(spark, sf):
    source = scratch(spark, "detections")
    I.detections(spark, sf).write.parquet(source)
    stream = spark.readStream.schema(schemas.DETECTIONS).parquet(source).withColumn("event_time", detection_time())
    events = E.run_zone_events(stream, zone_table(spark), scratch(spark, "zone-events"), scratch(spark, "state"))
    return events.select("camera_id", "tracker_id", "frame_num", "event_type", "zone_name", "seq")


def event_stream(spark, sf):
    schema = I.table(spark, sf, "events").schema
    # a glob, because the streaming source takes a plain path for a folder
    raw = spark.readStream.schema(schema).parquet(f"{sf}/[e]vents.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return I.zone_events_of(raw).withColumn("event_time", F.timestamp_micros(
        F.unix_micros("video_ts") + F.round(F.col("t_sec") * 1e6).cast("bigint")))


@query("k2_stream_window_flow", "SELECT * FROM t_hourly")
def k2(spark, sf):
    table = scratch(spark, "flow")
    E.run_to_table(E.stream_window_flow(event_stream(spark, sf), "1 hour"), table, scratch(spark, "state"))
    return E.latest(spark, table, ["camera_id", "window_start"])


@query("k3_stream_last_windows", """
SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY window_start DESC) AS r FROM t_hourly)
WHERE r <= 6""")
def k3(spark, sf):
    flow = E.stream_window_flow(event_stream(spark, sf), "1 hour")
    return E.run_last_windows(flow, scratch(spark, "last"), scratch(spark, "state"), 6)


# Congestion at the north entry from all numbers of the fused window; every fifth day is for validation.
S.TABLES["t_model"] = f"""
SELECT strftime(video_ts, '%Y%m%d%H%M%S') || ':' || window_idx AS ID, day(video_ts) % 5 = 0 AS held_out,
       CAST({S.SEVERITY.format(c='north_entry_congestion')} AS INTEGER) AS label, {', '.join(FUSED)}
FROM t_table WHERE north_entry_congestion IS NOT NULL"""


def model_rows(spark, sf):
    """(training rows, validation rows, features): the features are all columns that are neither key nor label."""
    wide = L.attach_labels(materialise(every_number(spark, sf)), I.ratings(spark, sf), WIDTH)
    names = [c for c in P.feature_columns(wide) if c in FUSED]
    key = F.concat_ws(":", F.date_format("video_ts", "yyyyMMddHHmmss"), "window_idx")
    rows = wide.select(key.alias("ID"), (F.dayofmonth("video_ts") % 5 == 0).alias("held_out"), B.severity("north_entry_congestion").alias("label"), *[F.col(c).cast("double").alias(c) for c in names])
    rows = materialise(rows.filter("label is not null"))
    return rows.filter("NOT held_out"), rows.filter("held_out"), names


def _probs(frame):
    return frame.select("ID", *[F.round(F.col("probs")[i], 6).alias(f"p{i}") for i in range(4)], "y_pred")


@query("h15_balanced_samples", """
WITH d AS (SELECT ID, label, CAST(s AS INTEGER) AS sample, row_number() OVER (PARTITION BY label, s ORDER BY md5(ID || ':' || s), ID) AS r
           FROM t_model, range(10) t(s) WHERE NOT held_out)
SELECT ID, label, sample FROM d WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM t_model WHERE NOT held_out GROUP BY label))""")
def h15_samples(spark, sf):
    return N.balanced_samples(model_rows(spark, sf)[0], "label", "ID", 10)


@query("h15_sample_classes", """
SELECT CAST(s AS INTEGER) AS sample, label, (SELECT min(n) FROM (SELECT count(*) AS n FROM t_model WHERE NOT held_out GROUP BY label)) AS n
FROM (SELECT DISTINCT label FROM t_model WHERE NOT held_out), range(100) t(s)""")
def h15_classes(spark, sf):
    drawn = N.balanced_samples(model_rows(spark, sf)[0], "label", "ID", 100)
    return drawn.groupBy("sample", "label").agg(F.count(F.lit(1)).alias("n"))


def _forest(train, names):
    # missing speeds are a value of their own
    return M.train_random_forest(train.fillna(-1.0, names), names)


def _mlp(train, names):
    return M.train_mlp(train.fillna(0.0, names), names, 4)


@query("h16_random_forest")
def h16(spark, sf):
    train, valid, names = model_rows(spark, sf)
    return _probs(M.probabilities(_forest(train, names), valid.fillna(-1.0, names), ["ID"]))


@query("h16_balanced_bag")
def h16_bag(spark, sf):
    train, valid, names = model_rows(spark, sf)
    return _probs(N.fit_balanced_bag(train, names, samples=100).probabilities(valid, ["ID"]))


@query("h16_balanced_boost")
def h16_boost(spark, sf):
    train, valid, names = model_rows(spark, sf)
    return _probs(N.fit_balanced_boost(train, names, rounds=30).probabilities(valid, ["ID"]))


@query("h17_boosted_trees")
def h17(spark, sf):
    train, valid, names = model_rows(spark, sf)
    return _probs(M.train_boosted_trees(train, names).probabilities(valid, ["ID"]))


#: Bins of the booster and their cells, as in its defaults.
_BINS, _CELLS = 32, 1024


def _first_splits() -> str:
    return f"""
WITH v AS (UNPIVOT (SELECT ID, label, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in FUSED)} FROM t_model WHERE NOT held_out) ON {', '.join(FUSED)} INTO NAME feature VALUE x),
o AS (SELECT unnest([{', '.join(f"'{c}'" for c in FUSED)}]) AS feature, unnest(range({len(FUSED)})) AS f),
b AS (SELECT feature, min(x) AS low, max(x) AS high FROM v GROUP BY feature),
c AS (SELECT v.*, CASE WHEN high > low THEN least({_CELLS - 1}, greatest(0, CAST(floor((x - low) / (high - low) * {_CELLS}) AS BIGINT))) ELSE 0 END AS cell FROM v JOIN b USING (feature)),
n AS (SELECT feature, cell, count(*) AS n FROM c GROUP BY ALL),
e AS (SELECT feature, cell, least({_BINS - 1}, 1 + coalesce(sum(n) OVER (PARTITION BY feature ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {_BINS - 1}
      // sum(n) OVER (PARTITION BY feature)) AS bin FROM n),
m AS (SELECT label, count(*) AS n FROM t_model WHERE NOT held_out GROUP BY label),
k AS (SELECT label, n, (SELECT sum(n) FROM m) / CAST((SELECT count(*) FROM m) * n AS DOUBLE) AS w FROM m),
g AS (SELECT t.label AS class, k.label, CAST(floor(w * (1e0 / (SELECT count(*) FROM m) - (t.label = k.label)::INTEGER) * 16777216 + 0.5) AS BIGINT) AS g,
      CAST(floor(w * (1e0 / (SELECT count(*) FROM m)) * (1 - 1e0 / (SELECT count(*) FROM m)) * 16777216 + 0.5) AS BIGINT) AS h FROM m t, k),
r AS (SELECT t.ID, o.feature, o.f, t.label, coalesce(e.bin, 0) AS bin FROM (SELECT ID, label FROM t_model WHERE NOT held_out) t CROSS JOIN o
      LEFT JOIN c ON c.ID = t.ID AND c.feature = o.feature LEFT JOIN e ON e.feature = o.feature AND e.cell = c.cell),
s AS (SELECT class, feature, f, bin, sum(g) AS g, sum(h) AS h FROM r JOIN g USING (label) GROUP BY ALL),
a AS (SELECT class, feature, f, q AS bin, coalesce(sum(g) FILTER (bin <= q), 0) / 16777216e0 AS gl, coalesce(sum(h) FILTER (bin <= q), 0) / 16777216e0 AS hl, sum(g) / 16777216e0 AS ga, sum(h) / 16777216e0 AS ha
      FROM s, range({_BINS - 1}) t(q) GROUP BY ALL),
w AS (SELECT *, gl * gl / (hl + 1) + (ga - gl) * (ga - gl) / (ha - hl + 1) - ga * ga / (ha + 1) AS gain FROM a WHERE hl >= 1 AND ha - hl >= 1)
SELECT CAST(class AS INTEGER) AS class, feature, CAST(bin AS INTEGER) AS bin, R(gain) AS gain
FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY gain DESC, f, bin) AS r FROM w) WHERE r = 1"""


@query("h17_first_splits", _first_splits())
def h17_first(spark, sf):
    train, _, names = model_rows(spark, sf)
    return spark.createDataFrame(X.root_splits(train, names), "class int, feature string, bin int, gain double")


@query("h18_mlp")
def h18(spark, sf):
    train, valid, names = model_rows(spark, sf)
    return _probs(M.probabilities(_mlp(train, names), valid.fillna(0.0, names), ["ID"]))


@query("h19_compare_models")
def h19(spark, sf):
    train, valid, names = model_rows(spark, sf)
    # forests and perceptrons take a value in place of a missing one, so the comparison gives it to all
    train, valid = (rows.fillna(0.0, names) for rows in (train, valid))
    return M.compare_models(train, valid, {
        "random_forest": lambda rows: M.train_random_forest(rows, names), "boosted_trees": lambda rows: M.train_boosted_trees(rows, names),
        "mlp": lambda rows: M.train_mlp(rows, names, 4), "balanced_bag": lambda rows: N.fit_balanced_bag(rows, names, samples=100)})


@query("h20_feature_importance")
def h20(spark, sf):
    train, _, names = model_rows(spark, sf)
    return M.feature_importance(_forest(train, names), names)
