"""Queries H1-H15, I2-I17 and J1-J6."""

from __future__ import annotations

from pyspark.sql import functions as F

from gyratory.constants import CONGESTION, COUNTED_CLASSES, DIRECTIONS
from gyratory.functions import scalars as B
from gyratory.functions.gram import correlation_matrix
from gyratory.operators import history as J
from gyratory.operators import labels as L
from gyratory.operators import metrics as M
from gyratory.operators import prep as P
from gyratory.operators import profile as R
from gyratory.operators import visits as V
from gyratory.plans import inputs as I
from gyratory.plans import sql_tables as S
from gyratory.plans.q_labels import FUSED, TOTALS, WIDTH, every_number, fused, windows
from gyratory.plans.q_prep import labelled_windows
from gyratory.plans.q_windows import CLASSES, day_features
from gyratory.plans.registry import query
from gyratory.session import materialise

# H
S.TABLES["t_filled"] = "SELECT * FROM t_long WHERE congestion_rating IS NOT NULL"


@query("h1_class_weights", """
SELECT congestion_rating, count(*) AS n, R(sum(count(*)) OVER () / (count(*) OVER () * count(*)::DOUBLE)) AS weight,
       R(count(*) * 100e0 / sum(count(*)) OVER ()) AS percent FROM t_filled GROUP BY congestion_rating""")
def h1(spark, sf):
    return M.class_weights(P.to_long(I.ratings(spark, sf)), "congestion_rating")


def predicted(spark, sf):
    return M.argmax_predictions(I.predictions(spark, sf))


def known(spark, sf):
    return predicted(spark, sf).filter("y_true <> -1")


S.TABLES["t_grid"] = "SELECT CAST(a.i AS INTEGER) AS a, CAST(b.i AS INTEGER) AS b FROM range(4) a(i), range(4) b(i)"
S.TABLES["t_cams"] = "SELECT DISTINCT camera_id FROM t_known"
S.TABLES["t_confusion"] = """
SELECT c.camera_id, g.a AS y_true, g.b AS y_pred, count(k.y_true) AS n FROM t_cams c CROSS JOIN t_grid g
LEFT JOIN t_known k ON k.camera_id = c.camera_id AND k.y_true = g.a AND k.y_pred = g.b GROUP BY ALL"""


@query("h2_confusion_matrix", "SELECT y_true, y_pred, CAST(sum(n) AS BIGINT) AS n FROM t_confusion GROUP BY ALL")
def h2(spark, sf):
    return M.confusion_matrix(known(spark, sf))


def _prf(source, keys):
    k = "".join(f"{x}, " for x in keys)
    return f"""
SELECT {k}label, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0e0 END AS f1,
       support, hits, predicted
FROM (SELECT *, CASE WHEN predicted > 0 THEN hits / predicted::DOUBLE ELSE 0e0 END AS precision,
             CASE WHEN support > 0 THEN hits / support::DOUBLE ELSE 0e0 END AS recall
      FROM (SELECT {k}label, CAST(sum(n) FILTER (WHERE y_true = label AND y_pred = label) AS BIGINT) AS hits,
                   CAST(sum(n) FILTER (WHERE y_true = label) AS BIGINT) AS support,
                   CAST(sum(n) FILTER (WHERE y_pred = label) AS BIGINT) AS predicted
            FROM {source}, (SELECT CAST(i AS INTEGER) AS label FROM range(4) r(i)) GROUP BY ALL))"""


S.TABLES["t_prf"] = _prf("t_confusion", [])
S.TABLES["t_prf_camera"] = _prf("t_confusion", ["camera_id"])


def _scores(source, keys):
    k = "".join(f"{x}, " for x in keys)
    return f"""
SELECT {k}avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1, sum(hits) / sum(support)::DOUBLE AS accuracy,
       avg(recall) FILTER (WHERE support > 0) AS balanced_accuracy
FROM {source} WHERE support > 0 OR predicted > 0 {'GROUP BY ALL' if keys else ''}"""


S.TABLES["t_scores_camera"] = _scores("t_prf_camera", ["camera_id"])
S.TABLES["t_scores"] = _scores("t_prf", [])


@query("h3_per_class_prf", """
SELECT label, R(precision) AS precision, R(recall) AS recall, R(f1) AS f1, support, hits, predicted FROM t_prf""")
def h3(spark, sf):
    return M.per_class_prf(M.confusion_matrix(known(spark, sf)))


@query("h4_scores", """
SELECT R(macro_f1) AS macro_f1, R(weighted_f1) AS weighted_f1, R(accuracy) AS accuracy,
       R(balanced_accuracy) AS balanced_accuracy FROM t_scores""")
def h4(spark, sf):
    return M.summary_scores(M.per_class_prf(M.confusion_matrix(known(spark, sf))))


@query("h5_competition_score", """
SELECT R(avg(macro_f1)) AS avg_f1, R(avg(accuracy)) AS avg_accuracy, R(0.7e0 * avg(macro_f1) + 0.3e0 * avg(accuracy)) AS score
FROM t_scores_camera""")
def h5(spark, sf):
    return M.competition_score(known(spark, sf))


@query("h6_masked_accuracy", """
WITH per AS (SELECT direction, avg(CAST(y_true = y_pred AS INTEGER)) AS accuracy, count(*) AS valid FROM t_known GROUP BY ALL)
SELECT direction, R(accuracy) AS accuracy, valid FROM per
UNION ALL SELECT '(mean)', R(avg(accuracy)), CAST(sum(valid) AS BIGINT) FROM per""")
def h6(spark, sf):
    return M.masked_accuracy(predicted(spark, sf))


_PT = "CASE y_true WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 WHEN 3 THEN p3 END"


@query("h7_masked_cross_entropy", f"""
SELECT count(p) AS n_valid, R(sum(-ln(least(greatest(p, 1e-7), 1e0 - 1e-7)))) AS loss_sum,
       R(sum(-ln(p)) / (count(p) + 1e-7)) AS loss_unclipped,
       R(sum(-ln(least(greatest(p, 1e-7), 1e0 - 1e-7))) / count(p)) AS loss
FROM (SELECT {_PT} AS p FROM t_known)""")
def h7(spark, sf):
    return M.masked_cross_entropy(I.predictions(spark, sf))


@query("h8_argmax_predictions", "SELECT sequence_id, " + ", ".join(
    f"CASE WHEN direction = '{d}' THEN {S.LABEL.format(i='y_pred')} END AS {d}_prediction, "
    f"R(CASE WHEN direction = '{d}' THEN confidence END) AS {d}_confidence" for d in DIRECTIONS) + " FROM t_pred")
def h8(spark, sf):
    return M.prediction_table(I.predictions(spark, sf), DIRECTIONS, ["sequence_id"])


@query("h9_explode_probabilities", "SELECT sequence_id, direction, y_true, " + ", ".join(
    f"R(p{i}) AS prob_{c.replace(' ', '_')}" for i, c in enumerate(CONGESTION)) + " FROM t_pred")
def h9(spark, sf):
    return M.explode_probabilities(I.predictions(spark, sf)).drop("camera_id")


_V = [f"(p{i} * 2e0 + q{i} * 1e0) / 3e0" for i in range(4)]


@query("h10_soft_vote", f"""
SELECT sequence_id, R(v0) AS v0, R(v1) AS v1, R(v2) AS v2, R(v3) AS v3,
       CAST(CASE greatest(v0, v1, v2, v3) WHEN v0 THEN 0 WHEN v1 THEN 1 WHEN v2 THEN 2 ELSE 3 END AS INTEGER) AS y_pred
FROM (SELECT sequence_id, {', '.join(f'{e} AS v{i}' for i, e in enumerate(_V))} FROM t_prob)""")
def h10(spark, sf):
    out = M.soft_vote([I.predictions(spark, sf), I.predictions(spark, sf, 4)], [2.0, 1.0])
    return out.select("sequence_id", *[F.col("probs")[i].alias(f"v{i}") for i in range(4)], "y_pred")


@query("h11_tune_thresholds", """
WITH c AS (SELECT y_true, CAST(u.k AS INTEGER) AS label, CASE u.k WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END AS p
           FROM t_known, range(4) u(k)),
     g AS (SELECT label, i, count(*) FILTER (WHERE p >= 0.1e0 + 0.05e0 * i) AS predicted,
                  count(*) FILTER (WHERE p >= 0.1e0 + 0.05e0 * i AND y_true = label) AS tp,
                  count(*) FILTER (WHERE y_true = label) AS actual FROM c, range(16) r(i) GROUP BY ALL),
     f AS (SELECT *, CASE WHEN predicted + actual > 0 THEN 2e0 * tp / (predicted + actual) ELSE 0e0 END AS f1 FROM g)
SELECT label, R(0.1e0 + 0.05e0 * i) AS threshold, R(f1) AS f1
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY f1 DESC, i) AS r FROM f) WHERE r = 1 AND f1 > 0""")
def h11(spark, sf):
    return M.tune_thresholds(known(spark, sf))


def template(spark, sf):
    """IDs of the test output in template order."""
    long = P.to_long(I.ratings(spark, sf)).filter("cycle_phase = 'test_output_5'")
    return long.select("ID", (F.col("label_id") * 2 + (F.col("ID_type") == "ID_exit").cast("int")).alias("row_order"))


def submission_predictions(spark, sf):
    """History as a naive forecast."""
    state = P.historical_state(I.ratings(spark, sf))
    return state.select("ID", F.coalesce("historical_congestion", F.lit(CONGESTION[0])).alias("Target"))


S.TABLES["t_template"] = """
SELECT ID, label_id * 2 + CAST(ID_type = 'ID_exit' AS INTEGER) AS row_order FROM t_long WHERE cycle_phase = 'test_output_5'"""
S.TABLES["t_submission"] = """
SELECT row_order, ID, coalesce(historical_congestion, 'free flowing') AS Target,
       coalesce(historical_congestion, 'free flowing') AS Target_Accuracy
FROM t_template LEFT JOIN t_history USING (ID)"""


@query("h12_build_submission", "SELECT * FROM t_submission")
def h12(spark, sf):
    return M.build_submission(submission_predictions(spark, sf), template(spark, sf))


@query("h13_validate_submission", """
SELECT count(s.ID) AS rows, count(t.ID) AS expected_rows, count(*) FILTER (WHERE s.ID IS NULL) AS missing_ids,
       count(*) FILTER (WHERE t.ID IS NULL) AS extra_ids, count(*) FILTER (WHERE s.row_order <> t.row_order) AS out_of_order,
       count(*) FILTER (WHERE s.ID IS NOT NULL AND s.Target IS NULL) AS empty_targets
FROM (SELECT CASE WHEN row_order % 50 = 1 THEN 'other_' || ID ELSE ID END AS ID,
             CASE WHEN row_order % 50 = 2 THEN row_order + 1 WHEN row_order % 50 = 3 THEN row_order - 1 ELSE row_order END AS row_order,
             CASE WHEN row_order % 50 <> 4 THEN Target END AS Target
      FROM t_submission WHERE row_order % 50 <> 0) s
FULL JOIN t_template t ON t.ID = s.ID""")
def h13(spark, sf):
    wanted = template(spark, sf)
    # a submission with faults of every kind: rows left out, foreign IDs, swapped rows, empty targets
    nth = F.col("row_order") % 50
    flawed = M.build_submission(submission_predictions(spark, sf), wanted).filter(nth != 0).withColumns({
        "ID": F.when(nth == 1, F.concat(F.lit("other_"), "ID")).otherwise(F.col("ID")),
        "row_order": F.col("row_order") + F.when(nth == 2, 1).when(nth == 3, -1).otherwise(0),
        "Target": F.when(nth != 4, F.col("Target")),
    })
    return M.validate_submission(flawed, wanted)


@query("h14_prediction_distribution", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS label, count(*) FILTER (WHERE Target = '{c}') AS n, "
    f"R(count(*) FILTER (WHERE Target = '{c}') * 100e0 / count(Target)) AS percent FROM t_submission" for c in CONGESTION) + ")")
def h14(spark, sf):
    return M.prediction_distribution(M.build_submission(submission_predictions(spark, sf), template(spark, sf)))


@query("h15_undersample", """
SELECT label_id, congestion_enter_rating FROM (
  SELECT label_id, congestion_enter_rating, row_number() OVER (PARTITION BY congestion_enter_rating
         ORDER BY md5(label_id || ':0'), label_id) AS r FROM t_ratings WHERE congestion_enter_rating IS NOT NULL)
WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM t_ratings WHERE congestion_enter_rating IS NOT NULL
                                GROUP BY congestion_enter_rating))""")
def h15(spark, sf):
    rows = I.ratings(spark, sf).select("label_id", "congestion_enter_rating")
    return M.undersample(rows, "congestion_enter_rating", "label_id")


# I
_KEYF = ["total_entry_count", "total_exit_count", "total_entry_flow_rate", "total_exit_flow_rate",
         "total_circulating_occupancy", "avg_circulating_occupancy", "avg_speed_km_h", "entry_flow_imbalance",
         "north_entry_count", "east_entry_count", "south_entry_count", "west_entry_count"]
_MISSING = f"""
SELECT column_name, n - known AS missing, R((n - known) * 100e0 / n) AS percent
FROM (UNPIVOT (SELECT count(*) AS n, {', '.join(f'count({c}) AS {c}' for c in FUSED)} FROM t_fused) ON {', '.join(FUSED)} INTO NAME column_name VALUE known)
WHERE n > known"""


@query("i2_missing_values", _MISSING)
def i2(spark, sf):
    return R.missing_values(every_number(spark, sf))


@query("i2_most_missing", _MISSING + " ORDER BY n - known DESC, column_name LIMIT 5")
def i2_most(spark, sf):
    return R.missing_values(every_number(spark, sf), top=5)


@query("i3_describe", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS count, R(round(avg({c}), 2)) AS mean, R(round(stddev_samp({c}), 2)) AS std, "
    f"R(round(min({c})::DOUBLE, 2)) AS min, R(round(quantile_cont({c}::DOUBLE, 0.25), 2)) AS q25, R(round(quantile_cont({c}::DOUBLE, 0.5), 2)) AS q50, "
    f"R(round(quantile_cont({c}::DOUBLE, 0.75), 2)) AS q75, R(round(max({c})::DOUBLE, 2)) AS max FROM t_fused" for c in _KEYF) + ")")
def i3(spark, sf):
    return R.describe(materialise(fused(spark, sf).select(*_KEYF)), _KEYF)


@query("i4_hour_distribution", """
SELECT hour_of_day, count(*) AS n, R(sum(sum(is_rush_hour)) OVER () * 100e0 / sum(count(*)) OVER ()) AS rush_percent
FROM t_fused GROUP BY hour_of_day""")
def i4(spark, sf):
    return R.hour_distribution(fused(spark, sf))


@query("i5_flow_balance", """
SELECT CAST(sum(total_entry_count) AS BIGINT) AS total_entries, CAST(sum(total_exit_count) AS BIGINT) AS total_exits,
       CAST(sum(total_entry_count) - sum(total_exit_count) AS BIGINT) AS net_flow,
       R(avg(total_entry_flow_rate)) AS avg_entry_rate, R(avg(total_exit_flow_rate)) AS avg_exit_rate FROM t_fused""")
def i5(spark, sf):
    return R.flow_balance(fused(spark, sf))


@query("i6_camera_comparison", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, '{d}' AS direction, R(avg({d}_{m})) AS mean_value FROM t_fused"
    for m in R.CAMERA_METRICS for d in DIRECTIONS) + ")")
def i6(spark, sf):
    return R.camera_comparison(fused(spark, sf))


@query("i7_directional_asymmetry", """
SELECT R(avg(NS_total_entry)) AS NS_total_entry, R(avg(EW_total_entry)) AS EW_total_entry,
       R(avg(NS_EW_imbalance)) AS NS_EW_imbalance FROM t_fused""")
def i7(spark, sf):
    return R.directional_asymmetry(fused(spark, sf))


_LABELS = [f"{d}_{s}_congestion" for d in DIRECTIONS for s in ("entry", "exit")]


@query("i8_target_distribution", """
SELECT column_name AS target, label, count(*) AS n FROM t_label_cells WHERE label IS NOT NULL GROUP BY ALL""")
def i8(spark, sf):
    return R.target_distribution(L.attach_labels(windows(spark, sf), I.ratings(spark, sf), WIDTH), _LABELS)


def labelled_numbers(spark, sf):
    """Every number of the fused windows beside the label of the north entry."""
    wide = L.attach_labels(materialise(every_number(spark, sf)), I.ratings(spark, sf), WIDTH)
    return materialise(wide.select(*FUSED, "north_entry_congestion"))


S.TABLES["t_correlations"] = f"""
SELECT feature, CASE WHEN count(x) FILTER (y IS NOT NULL) > 1 AND min(x) FILTER (y IS NOT NULL) < max(x) FILTER (y IS NOT NULL) THEN abs(corr(y, x)) END AS correlation
FROM (SELECT CAST({S.SEVERITY.format(c='north_entry_congestion')} AS DOUBLE) AS y, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in FUSED)} FROM t_table)
     UNPIVOT INCLUDE NULLS (x FOR feature IN ({', '.join(FUSED)})) GROUP BY feature"""


@query("i9_correlations", "SELECT feature, R(correlation) AS correlation FROM t_correlations")
def i9(spark, sf):
    return R.correlations(labelled_numbers(spark, sf), None, "north_entry_congestion")


@query("i9_top_correlations", """SELECT feature, R(correlation) AS correlation FROM t_correlations WHERE correlation IS NOT NULL
ORDER BY round(correlation, 9) DESC, feature LIMIT 10""")
def i9_top(spark, sf):
    return R.top_correlations(labelled_numbers(spark, sf), None, "north_entry_congestion")


_PAIRED = [c for c in FUSED if c in ("total_entry_count", "total_exit_count", "avg_circulating_occupancy", "avg_speed_km_h", "speed_range", "hour_of_day", "NS_EW_imbalance", "north_entry_speed_avg_km_h")]


@query("i9_correlation_matrix", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, R(corr({a}, {b})) AS correlation FROM t_fused"
    for i, a in enumerate(_PAIRED) for b in _PAIRED[i + 1:]) + ")")
def i9_matrix(spark, sf):
    # every pair is computed; the twin spells out these
    return correlation_matrix(every_number(spark, sf).select(*FUSED), FUSED).filter(F.col("a").isin(*_PAIRED) & F.col("b").isin(*_PAIRED))


@query("i10_gap_analysis", """
WITH g AS (SELECT epoch_us(datetime_start) - epoch_us(lag(datetime_start) OVER (ORDER BY datetime_start)) AS gap FROM t_ratings),
     m AS (SELECT gap FROM g WHERE gap IS NOT NULL GROUP BY gap ORDER BY count(*) DESC, gap LIMIT 1)
SELECT min(datetime_start) AS earliest, max(datetime_start) AS latest, count(*) AS records,
       count(DISTINCT datetime_start) AS distinct_timestamps, R((SELECT min(gap) FROM g) / 1e6) AS min_gap,
       R((SELECT max(gap) FROM g) / 1e6) AS max_gap, R((SELECT gap FROM m) / 1e6) AS most_common_gap,
       R((epoch_us(max(datetime_start)) - epoch_us(min(datetime_start))) / 1e6) AS range_seconds FROM t_ratings""")
def i10(spark, sf):
    return R.gap_analysis(I.ratings(spark, sf), "datetime_start")


def summary(spark, sf):
    """Vehicles and class counts per day video."""
    cars = I.vehicles(I.zone_events(spark, sf))
    counts = V.vehicle_class_counts(cars, CLASSES)
    total = sum((F.col(f"vehicle_class_{c}") for c in CLASSES[1:]), F.col(f"vehicle_class_{CLASSES[0]}"))
    return counts.withColumn("total_vehicles_tracked", total)


S.TABLES["t_summary"] = ("SELECT video_ts, camera_id, count(*) AS total_vehicles_tracked, " + ", ".join(
    f"count(*) FILTER (WHERE class_name = '{c}') AS vehicle_class_{c}" for c in CLASSES) + " FROM t_vehicles GROUP BY ALL")


@query("i11_daily_counts", """
SELECT CAST(CAST(video_ts AS DATE) AS VARCHAR) AS date, CAST(sum(total_vehicles_tracked) AS BIGINT) AS vehicles
FROM t_summary GROUP BY ALL""")
def i11(spark, sf):
    return R.daily_counts(summary(spark, sf))


@query("i12_camera_totals", """
SELECT camera_id, CAST(sum(total_vehicles_tracked) AS BIGINT) AS vehicles, count(*) AS videos,
       R(avg(total_vehicles_tracked)) AS mean_vehicles, count(DISTINCT camera_id) AS cameras
FROM t_summary GROUP BY ROLLUP (camera_id)""")
def i12(spark, sf):
    return R.camera_totals(summary(spark, sf))


@query("i13_prefix_unpivot", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT video_ts, camera_id, 'vehicle_class_' AS family, '{c}' AS key, R(vehicle_class_{c}) AS value FROM t_summary"
    for c in CLASSES) + ")")
def i13(spark, sf):
    return R.prefix_unpivot(summary(spark, sf), ["video_ts", "camera_id"], ["vehicle_class_", "zone_count_", "dwell_mean_"])


@query("i14_duration_histogram", """
WITH d AS (SELECT last_seen_time - first_seen_time AS d FROM t_vehicles),
     b AS (SELECT min(d) AS low, (max(d) - min(d)) / 20 AS width FROM d)
SELECT CAST(CASE WHEN width > 0 THEN least(floor((d - low) / width), 19) ELSE 0 END AS INTEGER) AS bin, count(*) AS vehicles
FROM d, b GROUP BY 1""")
def i14(spark, sf):
    return R.duration_histogram(I.vehicles(I.zone_events(spark, sf)))


@query("i15_group_means", """
SELECT 'rating' AS grouping_key, north_entry_congestion AS group_value, R(avg(total_entry_count)) AS mean_total_entry_count,
       R(avg(avg_circulating_occupancy)) AS mean_avg_circulating_occupancy FROM t_table GROUP BY ALL
UNION ALL SELECT 'hour', hour_of_day::VARCHAR, R(avg(total_entry_count)), R(avg(avg_circulating_occupancy)) FROM t_table GROUP BY hour_of_day
UNION ALL SELECT 'high_traffic', camera_id::VARCHAR, R(avg(total_vehicles_tracked)), R(count(*)) FROM t_summary
  WHERE camera_id = 1 AND total_vehicles_tracked > 20 GROUP BY camera_id""")
def i15(spark, sf):
    table = labelled_windows(spark, sf)
    names = ["total_entry_count", "avg_circulating_occupancy"]

    def part(df, kind, key):
        return df.select(F.lit(kind).alias("grouping_key"), F.col(key).cast("string").alias("group_value"),
                         *[f"mean_{n}" for n in names])

    busy = R.high_traffic(summary(spark, sf), 1, 20).groupBy("camera_id").agg(
        F.avg("total_vehicles_tracked").alias(f"mean_{names[0]}"), F.count(F.lit(1)).cast("double").alias(f"mean_{names[1]}"))
    return (
        part(R.mean_by(table, "north_entry_congestion", names), "rating", "north_entry_congestion")
        .unionByName(part(R.mean_by(table, "hour_of_day", names), "hour", "hour_of_day"))
        .unionByName(part(busy, "high_traffic", "camera_id"))
    )


@query("i16_dataset_stats", """
SELECT count(*) AS n_rows, count(DISTINCT video_ts) AS timestamps, count(DISTINCT camera_id) AS cameras,
       count(DISTINCT cycle_phase) AS phases, CAST(16 AS INTEGER) AS n_columns FROM t_ratings""")
def i16(spark, sf):
    return R.dataset_stats(I.ratings(spark, sf))


@query("i17_class_totals", """
SELECT class_name AS key, count(*) AS vehicles FROM t_vehicles GROUP BY class_name""")
def i17(spark, sf):
    return R.class_totals(summary(spark, sf))


# J
S.TABLES["t_series"] = f"""
SELECT view_label, ID_type, time_segment_id, ID, CAST({S.SEVERITY.format(c='congestion_rating')} AS INTEGER) AS severity,
       row_number() OVER (PARTITION BY view_label, ID_type ORDER BY time_segment_id, ID) AS rn FROM t_long"""


def series(spark, sf):
    long = P.to_long(I.ratings(spark, sf))
    return long.select("view_label", "ID_type", "time_segment_id", "ID", B.severity("congestion_rating").alias("severity"))


_W = "PARTITION BY view_label, ID_type ORDER BY rn"


def _series_query(name, columns, sql):
    @query(name, f"SELECT ID, {sql} FROM t_series")
    def run(spark, sf):
        return J.trends(series(spark, sf)).select("ID", *columns)


def _slope(rows):
    return f"regr_slope(severity, rn) OVER ({_W} ROWS BETWEEN {rows})"


_series_query("j1_trend_slope", ["trend_slope"], f"R({_slope('14 PRECEDING AND CURRENT ROW')}) AS trend_slope")
_series_query("j2_acceleration", ["acceleration"],
              f"R({_slope('6 PRECEDING AND CURRENT ROW')} - {_slope('13 PRECEDING AND 7 PRECEDING')}) AS acceleration")
_series_query("j4_rolling_state", [f"{k}_{n}" for n in (5, 15) for k in ("mean", "max", "min", "volatility")], ", ".join(
    f"R(avg(severity) OVER ({_W} ROWS {n - 1} PRECEDING)) AS mean_{n}, max(severity) OVER ({_W} ROWS {n - 1} PRECEDING) AS max_{n}, "
    f"min(severity) OVER ({_W} ROWS {n - 1} PRECEDING) AS min_{n}, R(stddev_samp(severity) OVER ({_W} ROWS {n - 1} PRECEDING)) AS volatility_{n}"
    for n in (5, 15)))
_series_query("j6_change_flags", ["changed", "worsening", "improving"], ", ".join(
    f"CAST(severity {op} lag(severity) OVER ({_W}) AS INTEGER) AS {n}"
    for op, n in (("<>", "changed"), (">", "worsening"), ("<", "improving"))))


@query("j3_persistence", f"""
SELECT ID, rn - max(CASE WHEN new THEN rn END) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS persistence
FROM (SELECT *, lag(coalesce(severity, -1)) OVER ({_W}) IS DISTINCT FROM coalesce(severity, -1) AS new FROM t_series)""")
def j3(spark, sf):
    return J.persistence(series(spark, sf)).select("ID", "persistence")


@query("j5_direction_imbalance", f"""
SELECT label_id, CAST({S.SEVERITY.format(c='congestion_enter_rating')} - {S.SEVERITY.format(c='congestion_exit_rating')} AS INTEGER)
  AS direction_imbalance FROM t_ratings""")
def j5(spark, sf):
    rows = I.ratings(spark, sf).select(
        "label_id", B.severity("congestion_enter_rating").alias("e"), B.severity("congestion_exit_rating").alias("x"))
    return J.direction_imbalance(rows, "e", "x", ["label_id"])
