"""Queries B (encoders) and G1-G23."""

from __future__ import annotations

from pyspark.sql import functions as F

from gyratory.constants import DIRECTIONS
from gyratory.functions import scalars as B
from gyratory.operators import labels as L
from gyratory.operators import prep as P
from gyratory.operators import sequences as Q
from gyratory.operators import windows as W
from gyratory.plans import inputs as I
from gyratory.plans import sql_tables as S
from gyratory.plans.q_labels import WIDTH, fused, windows
from gyratory.plans.q_windows import day_features
from gyratory.plans.registry import query
from gyratory.session import materialise

TIME_COLS = ["day_week", "hour", "minute", "is_weekend", "is_rush_hour"]
FEATURES = ["signaling", *TIME_COLS]

# B
S.TABLES["t_timed"] = """
SELECT *, CAST(isodow(video_time) - 1 AS INTEGER) AS day_week, CAST(hour(video_time) AS INTEGER) AS hour,
       CAST(minute(video_time) AS INTEGER) AS minute, CAST(isodow(video_time) >= 6 AS INTEGER) AS is_weekend,
       CAST(hour(video_time) IN (7, 8, 9, 16, 17, 18) AS INTEGER) AS is_rush_hour
FROM t_ratings"""


@query("b_parse_fields", f"""
SELECT label_id, regexp_extract(videos, '(\\d{{4}}(-\\d{{2}}){{5}})') AS stamp, video_ts AS parsed,
       camera_id, direction, split_part(videos, '/', 2)[:-5] AS basename, day_week, hour, minute, is_weekend, is_rush_hour,
       CAST(video_time AS DATE)::VARCHAR AS date, time_segment_id, view_label,
       CAST({S.SEVERITY.format(c='congestion_enter_rating')} AS INTEGER) AS known_code,
       coalesce(CAST({S.SEVERITY.format(c='congestion_enter_rating')} AS INTEGER), -1) AS code,
       congestion_enter_rating AS decoded
FROM t_timed""")
def b_parse(spark, sf):
    rows = I.ratings(spark, sf)
    timed = B.add_time_features(rows)
    ids = B.parse_submission_id(timed.drop("view_label", "time_segment_id").withColumnRenamed("ID_enter", "ID"))
    code = B.encode_congestion("congestion_enter_rating")
    return ids.select(
        "label_id", B.extract_timestamp("videos").alias("stamp"),
        B.parse_video_ts(B.extract_timestamp("videos")).alias("parsed"),
        B.camera_id("videos").alias("camera_id"), B.direction_of(B.camera_of_view("view_label")).alias("direction"),
        B.video_basename("videos").alias("basename"), *TIME_COLS, F.col("Date").alias("date"),
        "time_segment_id", "view_label", F.nullif(code, F.lit(-1)).alias("known_code"), code.alias("code"),
        B.decode_congestion(code).alias("decoded"),
    )


S.TABLES["t_codes"] = """
SELECT signaling, CAST(row_number() OVER (ORDER BY min((side, label_id))) - 1 AS INTEGER) AS code
FROM (SELECT signaling, label_id, CASE WHEN cycle_phase = 'train' THEN 0 ELSE 1 END AS side FROM t_ratings)
WHERE signaling IS NOT NULL GROUP BY signaling"""


def encoded(spark, sf):
    """Labels with time features and signaling codes."""
    rows = B.add_time_features(I.ratings(spark, sf))
    train, test = rows.filter("cycle_phase = 'train'"), rows.filter("cycle_phase <> 'train'")
    return B.apply_codes(rows, B.appearance_codes(train, test, "signaling", "label_id"), "signaling")


S.TABLES["t_encoded"] = """
SELECT t.* REPLACE (coalesce(c.code, -1) AS signaling) FROM t_timed t LEFT JOIN t_codes c USING (signaling)"""


@query("b10_encode_signaling", "SELECT label_id, cycle_phase, signaling FROM t_encoded")
def b10(spark, sf):
    return encoded(spark, sf).select("label_id", "cycle_phase", "signaling")


@query("b11_label_encode", """
SELECT label_id, coalesce(CAST(code AS INTEGER), -1) AS code FROM t_ratings LEFT JOIN (
  SELECT DISTINCT congestion_enter_rating, dense_rank() OVER (ORDER BY congestion_enter_rating) - 1 AS code
  FROM t_ratings WHERE congestion_enter_rating IS NOT NULL) USING (congestion_enter_rating)""")
def b11(spark, sf):
    return B.label_encode(I.ratings(spark, sf), "congestion_enter_rating", "code").select("label_id", "code")


@query("b12_rule_label", """
SELECT video_ts, camera_id, window_idx, CASE WHEN entry_count < 2 THEN 'free flowing' WHEN entry_count < 4 THEN 'light delay'
       WHEN entry_count < 6 THEN 'moderate delay' WHEN entry_count IS NOT NULL THEN 'heavy delay' END AS label
FROM t_flow""")
def b12(spark, sf):
    ev = I.zone_events(spark, sf)
    flow = W.entry_flow(ev, W.window_spine(I.sightings(ev), I.DAY_WINDOW), I.DAY_WINDOW)
    return flow.select(*W.KEY, B.rule_label("entry_count").alias("label"))


# G1-G10
S.TABLES["t_long"] = """
SELECT * EXCLUDE (ID_enter, ID_exit, congestion_enter_rating, congestion_exit_rating), 'ID_enter' AS ID_type,
       ID_enter AS ID, congestion_enter_rating AS congestion_rating FROM t_encoded
UNION ALL
SELECT * EXCLUDE (ID_enter, ID_exit, congestion_enter_rating, congestion_exit_rating), 'ID_exit', ID_exit,
       congestion_exit_rating FROM t_encoded"""


@query("g1_to_long", "SELECT label_id, ID_type, ID, congestion_rating, cycle_phase FROM t_long")
def g1(spark, sf):
    return P.to_long(I.ratings(spark, sf)).select("label_id", "ID_type", "ID", "congestion_rating", "cycle_phase")


def known_and_template(spark, sf):
    """Labelled rows in long form, and the submission template of the remaining IDs."""
    long = P.to_long(encoded(spark, sf))
    template = long.filter("cycle_phase = 'test_output_5'").select(
        "ID", F.lit("x").alias("Target"), F.lit("x").alias("Target_Accuracy"))
    return long.filter("cycle_phase <> 'test_output_5'"), template


S.TABLES["t_full"] = """
SELECT ID, ID_type, view_label, time_segment_id, cycle_phase, congestion_rating, signaling, day_week, hour, minute,
       is_weekend, is_rush_hour FROM t_long WHERE cycle_phase <> 'test_output_5'
UNION ALL
SELECT ID, ID_type, view_label, time_segment_id, cycle_phase, NULL, NULL, NULL, NULL, NULL, NULL, NULL
FROM t_long WHERE cycle_phase = 'test_output_5'"""


def full_long(spark, sf):
    known, template = known_and_template(spark, sf)
    return P.append_template(known, template)


@query("g2_append_template", "SELECT * FROM t_full")
def g2(spark, sf):
    return full_long(spark, sf).select(
        "ID", "ID_type", "view_label", "time_segment_id", "cycle_phase", "congestion_rating", *FEATURES)


@query("g3_select_features", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS non_null, R((count(*) - count({c})) * 100e0 / count(*)) AS null_percent, "
    f"count({c}) > 0 AS kept, (count(*) - count({c})) * 100e0 / count(*) > 50 AS mostly_null FROM t_full"
    for c in FEATURES) + ")")
def g3(spark, sf):
    return P.feature_completeness(full_long(spark, sf))


_SHIFTED = ", ".join(f"lag({c}, 7) OVER w AS {c}" for c in FEATURES)
S.TABLES["t_shifted"] = f"""
SELECT * FROM (SELECT ID, cycle_phase, congestion_rating, view_label, ID_type, {_SHIFTED} FROM t_full
  WINDOW w AS (PARTITION BY view_label, ID_type ORDER BY time_segment_id, ID))
WHERE cycle_phase = 'test_output_5' OR ({' AND '.join(f'{c} IS NOT NULL' for c in FEATURES)})"""


@query("g5_shift_features", "SELECT * FROM t_shifted")
def g5(spark, sf):
    return P.shift_features(full_long(spark, sf), FEATURES)


@query("g6_split_by_phase", """
SELECT cycle_phase, view_label, ID_type, count(*) AS n, count(congestion_rating) AS labelled FROM t_shifted GROUP BY ALL""")
def g6(spark, sf):
    parts = P.split_by_phase(materialise(P.shift_features(full_long(spark, sf), FEATURES)))
    counted = [p.groupBy("cycle_phase", "view_label", "ID_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("congestion_rating").alias("labelled")) for p in parts]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("g7_fill_with_train_median", f"""
WITH m AS (SELECT {', '.join(f'quantile_cont({c}::DOUBLE, 0.5) AS m_{c}' for c in FEATURES)}
           FROM t_shifted WHERE cycle_phase = 'train')
SELECT ID, {', '.join(f'R(coalesce({c}::DOUBLE, m_{c})) AS {c}' for c in FEATURES)}
FROM t_shifted, m WHERE cycle_phase = 'test_output_5'""")
def g7(spark, sf):
    train, _, test = P.split_by_phase(materialise(P.shift_features(full_long(spark, sf), FEATURES)))
    return P.fill_with_train_median(test, train, FEATURES).select("ID", *FEATURES)


@query("g8_current_state", "SELECT ID, congestion_rating AS current_congestion FROM t_long")
def g8(spark, sf):
    return P.current_state(I.ratings(spark, sf))


S.TABLES["t_history"] = """
SELECT ID, lag(congestion_rating, 7) OVER (PARTITION BY view_label, ID_type ORDER BY video_time, time_segment_id, ID)
  AS historical_congestion FROM t_long"""


@query("g9_historical_state", "SELECT * FROM t_history")
def g9(spark, sf):
    return P.historical_state(I.ratings(spark, sf))


S.TABLES["t_history_codes"] = """
SELECT f.ID, f.cycle_phase, h.historical_congestion, coalesce(c.code, -1) AS code FROM t_shifted f
LEFT JOIN (SELECT h.* FROM t_history h JOIN t_long l USING (ID) WHERE l.cycle_phase <> 'test_output_5') h USING (ID)
LEFT JOIN (SELECT historical_congestion, row_number() OVER (ORDER BY historical_congestion) - 1 AS code
           FROM (SELECT DISTINCT h.historical_congestion FROM t_shifted f JOIN t_history h USING (ID)
                 JOIN t_long l USING (ID) WHERE l.cycle_phase <> 'test_output_5' AND h.historical_congestion IS NOT NULL)) c
  ON c.historical_congestion = h.historical_congestion"""


@query("g10_add_historical_state", """
SELECT ID, cycle_phase, historical_congestion, CAST(CASE WHEN code = -1 THEN (
  SELECT code FROM t_history_codes WHERE cycle_phase = 'train' GROUP BY code ORDER BY count(*) DESC, code LIMIT 1)
  ELSE code END AS INTEGER) AS historical_congestion_encoded FROM t_history_codes""")
def g10(spark, sf):
    known = I.ratings(spark, sf).filter("cycle_phase <> 'test_output_5'")
    shifted = materialise(P.shift_features(full_long(spark, sf), FEATURES).select("ID", "cycle_phase"))
    out = P.add_historical_state(shifted, P.historical_state(known))
    return out.select("ID", "cycle_phase", "historical_congestion", "historical_congestion_encoded")


# G11-G22 on fused windows with labels.
SEQ = ["total_entry_count", "total_exit_count", "avg_circulating_occupancy", "avg_speed_km_h", "hour_of_day"]


def labelled_windows(spark, sf):
    base = fused(spark, sf).select("video_ts", "window_idx", "start_time", "end_time", "is_rush_hour", "day_of_week",
                                   "is_weekend", *SEQ)
    return materialise(L.attach_labels(materialise(base), I.ratings(spark, sf), WIDTH))


S.TABLES["t_table"] = "SELECT * FROM t_fused JOIN t_attached USING (video_ts, window_idx)"
_VALID = " + ".join(f"CAST({t} IS NOT NULL AS INTEGER)" for t in Q.ENTRY_TARGETS)
S.TABLES["t_seq"] = f"""
SELECT row_number() OVER (ORDER BY d, i) - 1 AS sequence_id, *
FROM (SELECT CAST(video_ts AS DATE) AS d, row_number() OVER w - 1 AS i, count(*) OVER a AS n, video_ts AS start_timestamp,
             last_value(video_ts) OVER a AS end_timestamp, last_value({_VALID}) OVER a AS valid_targets,
             {', '.join(f'last_value({t}) OVER a AS {t}' for t in Q.ENTRY_TARGETS)}
      FROM t_table
      WINDOW w AS (PARTITION BY CAST(video_ts AS DATE) ORDER BY video_ts, window_idx),
             a AS (PARTITION BY CAST(video_ts AS DATE) ORDER BY video_ts, window_idx ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING))
WHERE n = 6 AND valid_targets >= 3"""
S.TABLES["t_numbered"] = f"""
SELECT CAST(video_ts AS DATE) AS d, row_number() OVER (PARTITION BY CAST(video_ts AS DATE) ORDER BY video_ts, window_idx) - 1 AS i,
       {', '.join(SEQ)} FROM t_table"""
S.TABLES["t_cells"] = " UNION ALL ".join(
    f"SELECT s.sequence_id, CAST(m.i - s.i AS INTEGER) AS step, '{c}' AS feature, CAST(m.{c} AS DOUBLE) AS value "
    "FROM t_seq s JOIN t_numbered m ON m.d = s.d AND m.i BETWEEN s.i AND s.i + 5" for c in SEQ)


def seq(spark, sf):
    return Q.sequences(labelled_windows(spark, sf), SEQ)


@query("g11_sequences", f"""
SELECT s.sequence_id, CAST(d AS VARCHAR) AS date, start_timestamp, end_timestamp, CAST(6 AS INTEGER) AS n_windows,
       CAST(valid_targets AS INTEGER) AS valid_targets, R(0e0) AS max_time_gap_sec, {', '.join(Q.ENTRY_TARGETS)},
       c.step, c.feature, R(c.value) AS value
FROM t_seq s JOIN t_cells c USING (sequence_id)""")
def g11(spark, sf):
    made = seq(spark, sf)
    labels = [F.col("y")[i].alias(t) for i, t in enumerate(Q.ENTRY_TARGETS)]
    names = F.array(*[F.lit(c) for c in SEQ])
    return (
        made.select("sequence_id", "date", "start_timestamp", "end_timestamp", "n_windows", "valid_targets",
                    "max_time_gap_sec", *labels, F.posexplode("x").alias("step", "_v"))
        .select("*", F.posexplode("_v").alias("_f", "value")).withColumn("feature", names[F.col("_f")])
        .drop("_v", "_f")
    )


@query("g12_temporal_split", """
SELECT sequence_id, end_timestamp, CASE WHEN row_number() OVER (ORDER BY end_timestamp, sequence_id)
       <= floor(count(*) OVER () * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS part FROM t_seq""")
def g12(spark, sf):
    return Q.temporal_split(materialise(seq(spark, sf).select("sequence_id", "end_timestamp")))


_EMB = ["total_entry_count", "avg_circulating_occupancy"]
_INT = {"total_entry_count", "total_exit_count", "hour_of_day"}


def _r(expr, name, plain):
    return f"{expr} AS {name}" if plain else f"R({expr}) AS {name}"


@query("g13_embargo_sequences", "SELECT video_ts, window_idx, " + ", ".join(
    _r(f"{c}_t{k}", f"{c}_t{k}", c in _INT) for c in _EMB for k in range(3)) + ", "
    + ", ".join(f"y_{t}" for t in Q.ALL_TARGETS)
    + ", R(start_time) AS input_start_time, R(e2) AS input_end_time, R(s4) AS output_start_time, R(e4) AS output_end_time"
    + " FROM (SELECT *, " + ", ".join(f"lead({c}, {k}) OVER w AS {c}_t{k}" for c in _EMB for k in range(3)) + ", "
    + ", ".join(f"lead({t}, 4) OVER w AS y_{t}" for t in Q.ALL_TARGETS)
    + ", lead(end_time, 2) OVER w AS e2, lead(start_time, 4) OVER w AS s4, lead(end_time, 4) OVER w AS e4 FROM t_table"
    + " WINDOW w AS (PARTITION BY video_ts ORDER BY window_idx)) WHERE s4 IS NOT NULL")
def g13(spark, sf):
    return Q.embargo_sequences(labelled_windows(spark, sf), _EMB)


def _g14(c):
    p = c in _INT
    return ", ".join([
        _r(c, f"current_{c}", p), _r(f"avg({c}) OVER r", f"avg_15min_{c}", False),
        _r(f"stddev_samp({c}) OVER r", f"std_15min_{c}", False),
        _r(f"{c} - lag({c}, 2) OVER w", f"momentum_{c}", p),
        _r(f"({c} - lag({c}, 1) OVER w) - (lag({c}, 1) OVER w - lag({c}, 2) OVER w)", f"accel_{c}", p),
        _r(f"min({c}) OVER r", f"min_15min_{c}", p), _r(f"max({c}) OVER r", f"max_15min_{c}", p)])


@query("g14_recent_aggregates", "SELECT * EXCLUDE (n) FROM (SELECT video_ts, window_idx, hour_of_day, is_rush_hour, "
       "day_of_week, is_weekend, " + ", ".join(_g14(c) for c in _EMB) + ", count(*) OVER r AS n FROM t_table "
       "WINDOW w AS (PARTITION BY video_ts ORDER BY window_idx), "
       "r AS (PARTITION BY video_ts ORDER BY window_idx ROWS 2 PRECEDING)) WHERE n = 3")
def g14(spark, sf):
    return Q.recent_aggregates(labelled_windows(spark, sf), _EMB)


_HOR = [f"{t}_t{k}" for t in Q.ALL_TARGETS for k in (3, 4, 5, 6, 7, 8)]


@query("g15_horizon_targets", "SELECT video_ts, window_idx, " + ", ".join(
    f"lead({t}, {k}) OVER w AS {t}_t{k}" for t in Q.ALL_TARGETS for k in (3, 4, 5, 6, 7, 8))
    + " FROM t_attached WINDOW w AS (PARTITION BY video_ts ORDER BY window_idx)")
def g15(spark, sf):
    rows = L.attach_labels(windows(spark, sf), I.ratings(spark, sf), WIDTH)
    return Q.horizon_targets(rows).select("video_ts", "window_idx", *_HOR)


def _part(pos, total):
    return (f"CASE WHEN {pos} <= floor({total} * CAST(0.6 AS DOUBLE)) THEN 'train' "
            f"WHEN {pos} <= floor({total} * CAST(0.8 AS DOUBLE)) THEN 'validation' ELSE 'test' END")


@query("g16_split_60_20_20", f"""
SELECT w.video_ts, w.window_idx, {_part('row_number() OVER (ORDER BY w.video_ts, w.window_idx)', 'count(*) OVER ()')} AS row_part,
       g.part AS video_part
FROM t_windows w JOIN (SELECT video_ts, {_part('row_number() OVER (ORDER BY video_ts)', 'count(*) OVER ()')} AS part
                       FROM (SELECT DISTINCT video_ts FROM t_windows)) g USING (video_ts)""")
def g16(spark, sf):
    w = windows(spark, sf).select("video_ts", "window_idx")
    rows = Q.split_three_ways(w).withColumnRenamed("part", "row_part")
    return Q.group_split(rows).withColumnRenamed("part", "video_part")


@query("g17_leave_one_day_out", """
SELECT video_ts, window_idx, CAST(CAST(video_ts AS DATE) AS VARCHAR) AS date,
       CAST(dense_rank() OVER (ORDER BY CAST(video_ts AS DATE)) AS INTEGER) AS fold FROM t_windows""")
def g17(spark, sf):
    return Q.leave_one_day_out(windows(spark, sf).select("video_ts", "window_idx"))


@query("g18_daytype_split", """
SELECT video_ts, window_idx, day_type, CASE WHEN row_number() OVER (PARTITION BY day_type ORDER BY video_ts, window_idx)
   <= floor(count(*) OVER (PARTITION BY day_type) * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS part
FROM (SELECT *, CASE WHEN isodow(video_ts) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type FROM t_windows)""")
def g18(spark, sf):
    return Q.daytype_split(windows(spark, sf).select("video_ts", "window_idx"))


_G19 = [f"entry_count_lag_{k}" for k in (1, 2, 3)] + [f"speed_avg_km_h_lag_{k}" for k in (1, 2, 3)]


def _g19(policy, exprs, where=""):
    return (f"SELECT '{policy}' AS policy, video_ts, camera_id, window_idx, "
            + ", ".join(exprs(c) for c in _G19) + f" FROM t_lagged {where}")


@query("g19_missing_lag_policy",
       _g19("ffill", lambda c: (f"last_value({c} IGNORE NULLS) OVER (PARTITION BY video_ts, camera_id ORDER BY window_idx "
                                f"ROWS UNBOUNDED PRECEDING)" if "count" in c else
                                f"R(last_value({c} IGNORE NULLS) OVER (PARTITION BY video_ts, camera_id ORDER BY window_idx "
                                f"ROWS UNBOUNDED PRECEDING))") + f" AS {c}")
       + " UNION ALL " + _g19("drop", lambda c: c if "count" in c else f"R({c}) AS {c}", "WHERE window_idx >= 3")
       + " UNION ALL " + _g19("zero", lambda c: f"coalesce({c}, 0)" if "count" in c else f"R(coalesce({c}, 0e0)) AS {c}"))
def g19(spark, sf):
    lagged = W.add_lags(day_features(spark, sf)).select(*W.KEY, *_G19)
    parts = [P.missing_lag_policy(lagged, _G19, p).withColumn("policy", F.lit(p)) for p in ("ffill", "drop", "zero")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


S.TABLES["t_fit"] = """
SELECT feature, coalesce(avg(value), 0e0) AS mean, coalesce(nullif(stddev_pop(value), 0e0), 1e0) AS std
FROM t_cells GROUP BY feature"""


@query("g20_zscore", """
SELECT sequence_id, step, feature, R(coalesce((value - mean) / std, 0e0)) AS value FROM t_cells JOIN t_fit USING (feature)""")
def g20(spark, sf):
    cells = Q.sequence_cells(materialise(seq(spark, sf).select("sequence_id", "x")), SEQ)
    return P.zscore_apply(cells, P.zscore_fit(cells))


@query("g21_mean_impute_scale", """
SELECT sequence_id, step, feature, R((coalesce(value, m) - mean) / std) AS value FROM t_cells JOIN t_fit USING (feature)
JOIN (SELECT feature, avg(value) AS m FROM t_cells GROUP BY feature) USING (feature)""")
def g21(spark, sf):
    cells = Q.sequence_cells(materialise(seq(spark, sf).select("sequence_id", "x")), SEQ)
    return P.mean_impute_scale(cells, P.zscore_fit(cells))


@query("g22_target_mask", """
SELECT sequence_id, direction, y_true, y_true <> -1 AS valid, CASE WHEN y_true <> -1 THEN y_true ELSE 0 END AS y_clean
FROM t_pred""")
def g22(spark, sf):
    return P.target_mask(I.predictions(spark, sf).select("sequence_id", "direction", "y_true"))


_G23 = ["code", "hour"]


@query("g23_grouped_lags", "SELECT ID, " + ", ".join(
    f"lag({c}, {k}) OVER w AS {c}_lag_{k}" for c in _G23 for k in (1, 2, 3, 5, 10)) + ", " + ", ".join(
    f"R(CASE WHEN count({c}) OVER r = 5 THEN avg({c}) OVER r END) AS {c}_rolling_5" for c in _G23)
    + f" FROM (SELECT *, CAST({S.SEVERITY.format(c='congestion_rating')} AS INTEGER) AS code FROM t_long) "
    "WINDOW w AS (PARTITION BY view_label, ID_type ORDER BY time_segment_id, ID), "
    "r AS (PARTITION BY view_label, ID_type ORDER BY time_segment_id, ID ROWS 4 PRECEDING)")
def g23(spark, sf):
    long = P.to_long(B.add_time_features(I.ratings(spark, sf)))
    rows = long.select("view_label", "ID_type", "time_segment_id", "ID", "hour",
                       B.severity("congestion_rating").alias("code"))
    return P.grouped_lags(rows, _G23).drop("view_label", "ID_type", "time_segment_id", "hour", "code")
