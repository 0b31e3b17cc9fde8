"""Queries for the end-to-end compositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gyratory.operators import journeys as J
from gyratory.operators import prep as P
from gyratory.operators import sequences as Q
from gyratory.plans import inputs as I
from gyratory.plans import sql_tables as S
from gyratory.plans import workflows as FL
from gyratory.plans.q_labels import FUSED, every_number
from gyratory.plans.q_prep import FEATURES, SEQ, labelled_windows
from gyratory.plans.registry import query
from gyratory.session import materialise

_LAGGED = ["entry_count_lag_1", "exit_flow_rate_lag_3", "entry_count_rolling_mean_3", "exit_count_rolling_std_12"]
_EP1 = [f"{d}_{c}" for d in ("north", "west") for c in _LAGGED]
_EP1_LABELS = [f"{d}_{c}" for d in ("north", "east", "south", "west") for c in ("entry_congestion", "exit_congestion", "label_count")]


@query("ep1_training_dataset", f"""
SELECT video_ts, window_idx, total_entry_count, R(system_flow_balance) AS system_flow_balance, {', '.join(_EP1_LABELS)},
       {', '.join((f'l.{c}' if '_count_lag' in c else f'R(l.{c})') + f' AS {c}' for c in _EP1)}
FROM t_fused JOIN t_attached USING (video_ts, window_idx)
JOIN (SELECT video_ts, window_idx, {', '.join(f'max({c}) FILTER (WHERE camera_id = {i}) AS {d}_{c}' for d, i in (('north', 1), ('west', 4)) for c in _LAGGED)}
      FROM t_lagged JOIN t_rolled USING (video_ts, camera_id, window_idx) GROUP BY ALL) l USING (video_ts, window_idx)""")
def ep1(spark, sf):
    ev = I.zone_events(spark, sf)
    out = FL.training_dataset(ev, I.sightings(ev), J.journeys_of(ev, I.DISTANCES), I.ratings(spark, sf), I.DAY_WINDOW)
    return out.select("video_ts", "window_idx", "total_entry_count", "system_flow_balance", *_EP1_LABELS, *_EP1)


@query("ep2_forecasting_dataset", f"""
WITH m AS (SELECT {', '.join(f'quantile_cont({c}::DOUBLE, 0.5) AS m_{c}' for c in FEATURES)}
           FROM t_shifted WHERE cycle_phase = 'train')
SELECT ID, cycle_phase, congestion_rating, {', '.join(
    f"R(CASE WHEN cycle_phase = 'test_output_5' THEN coalesce({c}::DOUBLE, m_{c}) ELSE {c} END) AS {c}" for c in FEATURES)}
FROM t_shifted, m""")
def ep2(spark, sf):
    # read by each of the parts
    rows = materialise(I.ratings(spark, sf))
    template = P.to_long(rows.filter("cycle_phase = 'test_output_5'")).select(
        "ID", F.lit("x").alias("Target"), F.lit("x").alias("Target_Accuracy"))
    out = FL.forecasting_dataset(rows.filter("cycle_phase = 'train'"), rows.filter("cycle_phase = 'test_input_15'"), template)
    names = [F.col(c).cast("double").alias(c) for c in FEATURES]
    parts = [p.select("ID", "cycle_phase", "congestion_rating", *names) for p in (out.training, out.validation, out.testing)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


#: Numbers of a fused window that every window has; speeds need journeys, which most windows of these tables have none of.
_STEADY = [c for c in FUSED if "speed" not in c and P.candidate_features_of(c) and c not in FEATURES]
_WITH = [*FEATURES, *_STEADY]
S.TABLES["t_featured"] = f"""
SELECT ID, ID_type, view_label, time_segment_id, cycle_phase, congestion_rating, window_idx, {', '.join(_WITH)}
FROM (SELECT l.*, f.window_idx, {', '.join(f'f.{c}' for c in _STEADY)} FROM t_long l LEFT JOIN (SELECT * FROM t_fused WHERE window_idx = 8) f USING (video_ts) WHERE cycle_phase <> 'test_output_5')
UNION ALL
SELECT ID, ID_type, view_label, time_segment_id, cycle_phase, NULL, NULL, {', '.join('NULL' for _ in _WITH)} FROM t_long WHERE cycle_phase = 'test_output_5'"""
S.TABLES["t_shifted_features"] = f"""
SELECT * FROM (SELECT ID, cycle_phase, congestion_rating, {', '.join(f'lag({c}, 7) OVER w AS {c}' for c in _WITH)} FROM t_featured
  WINDOW w AS (PARTITION BY view_label, ID_type ORDER BY time_segment_id, window_idx NULLS FIRST, ID))
WHERE cycle_phase = 'test_output_5' OR ({' AND '.join(f'{c} IS NOT NULL' for c in _WITH)})"""


@query("ep2_forecasting_features", f"""
WITH m AS (SELECT {', '.join(f'quantile_cont({c}::DOUBLE, 0.5) AS m_{c}' for c in _WITH)} FROM t_shifted_features WHERE cycle_phase = 'train')
SELECT ID, cycle_phase, congestion_rating, {', '.join(
    f"R(CASE WHEN cycle_phase = 'test_output_5' THEN coalesce({c}::DOUBLE, m_{c}) ELSE {c} END) AS {c}" for c in _WITH)}
FROM t_shifted_features, m""")
def ep2_features(spark, sf):
    # read by each of the parts
    rows = materialise(I.ratings(spark, sf))
    template = P.to_long(rows.filter("cycle_phase = 'test_output_5'")).select("ID", F.lit("x").alias("Target"), F.lit("x").alias("Target_Accuracy"))
    numbers = materialise(every_number(spark, sf).select("video_ts", "window_idx", *_STEADY))
    out = FL.forecasting_dataset(rows.filter("cycle_phase = 'train'"), rows.filter("cycle_phase = 'test_input_15'"), template, features=numbers, window=8)
    names = [F.col(c).cast("double").alias(c) for c in _WITH]
    parts = [p.select("ID", "cycle_phase", "congestion_rating", *names) for p in (out.training, out.validation, out.testing)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("ep3_sequence_dataset", f"""
SELECT sequence_id, start_timestamp, end_timestamp, {', '.join(
    f"coalesce(CAST({S.SEVERITY.format(c=t)} AS INTEGER), -1) AS y{i}" for i, t in enumerate(Q.ENTRY_TARGETS))},
       CASE WHEN row_number() OVER (ORDER BY end_timestamp, sequence_id) <= floor(count(*) OVER () * CAST(0.8 AS DOUBLE))
            THEN 'train' ELSE 'test' END AS part FROM t_seq""")
def ep3(spark, sf):
    out = FL.sequence_dataset(labelled_windows(spark, sf), SEQ)
    return out.select("sequence_id", "start_timestamp", "end_timestamp",
                      *[F.col("y_encoded")[i].alias(f"y{i}") for i in range(4)], "part")
