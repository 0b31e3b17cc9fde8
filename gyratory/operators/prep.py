"""Long format, shifts, fills and scaling for forecasting tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyratory.constants import MISSING, PHASES, SHIFT
from gyratory.functions import ordered
from gyratory.functions.quantiles import exact_quantiles
from gyratory.functions.scalars import label_encode, parse_submission_id
from gyratory.session import materialise

SERIES = ["view_label", "ID_type"]

# Columns of a feature table that are keys, labels or their by-products (fixed name parts).
NOT_FEATURES = ["video_timestamp", "video_ts", "window_idx", "_congestion", "_signaling", "_label_count",
                "responseId", "view_label", "ID_enter", "ID_exit"]
BASE_FEATURES = ["signaling", "day_week", "hour", "minute", "is_weekend", "is_rush_hour"]
# Name parts of the features that come from tracking (fixed values).
TRACKING_PARTS = ["entry_count", "exit_count", "entry_flow", "exit_flow", "circulating", "speed", "od_", "cam1_",
                  "cam2_", "cam3_", "cam4_", "balance", "ratio", "density", "imbalance"]


def to_long(df: DataFrame) -> DataFrame:
    """G1: one row per record and direction, with the rating of that direction."""
    keep = [c for c in df.columns if c not in ("ID_enter", "ID_exit")]
    rating = F.when(F.col("ID_type") == "ID_enter", F.col("congestion_enter_rating")).otherwise(
        F.col("congestion_exit_rating")
    )
    return (
        df.unpivot(keep, ["ID_enter", "ID_exit"], "ID_type", "ID")
        .withColumn("congestion_rating", rating)
        .drop("congestion_enter_rating", "congestion_exit_rating")
    )


def append_template(long: DataFrame, template: DataFrame, sort: bool = False) -> DataFrame:
    """The rows to predict appended by column name; sort=True orders the whole table for export."""
    both = long.unionByName(parse_submission_id(template), allowMissingColumns=True)
    return both.orderBy("view_label", "ID_type", "time_segment_id", "ID") if sort else both


def candidate_features_of(name: str) -> bool:
    """Whether a name marks a tracking feature."""
    return any(p in name for p in TRACKING_PARTS)


def candidate_features(df: DataFrame) -> list[str]:
    """Base features and those whose name marks them as tracking features."""
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in ("integer", "long", "double", "float")}
    return [c for c in df.columns if c in BASE_FEATURES or (c in numeric and candidate_features_of(c))]


def feature_completeness(df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """Null share of every candidate feature; a feature with no value at all is not kept."""
    names = list(features) if features is not None else candidate_features(df)
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in names])
    long = counts.unpivot(["_n"], names, "feature", "non_null")
    percent = F.when(F.col("_n") > 0, (F.col("_n") - F.col("non_null")) * 100.0 / F.col("_n"))
    return long.select(
        "feature", "non_null", percent.alias("null_percent"), (F.col("non_null") > 0).alias("kept"),
        F.coalesce(percent > 50, F.lit(False)).alias("mostly_null"),
    )


def select_features(df: DataFrame) -> list[str]:
    """Names of the features with at least one value."""
    return [r.feature for r in feature_completeness(df).filter("kept").orderBy("feature").collect()]


def feature_columns(df: DataFrame, targets: Sequence[str] = ()) -> list[str]:
    """Every column that is neither key nor label."""
    return [c for c in df.columns if c not in targets and not any(part in c for part in NOT_FEATURES)]


def shift_features(
    df: DataFrame, features: Sequence[str], periods: int = SHIFT, order: Sequence[str] = ("time_segment_id", "ID"),
    dedupe: bool = False,
) -> DataFrame:
    """Features of `periods` rows earlier in the series; incomplete rows leave all phases but the test output.

    dedupe=True first keeps the earliest row per ID, so that rows are segments.
    """
    rows = ordered.position(df, ["ID"], list(order), "_k").filter("_k = 1").drop("_k") if dedupe else df

    def step(frame: DataFrame, w) -> DataFrame:
        return frame.withColumns({c: F.lag(c, periods).over(w) for c in features})

    kept = ["ID", "cycle_phase", "congestion_rating", *[c for c in order if c not in ("ID", *features)]]
    shifted = ordered.framed(rows.select(*SERIES, *kept, *features), SERIES, list(order), periods, 0, step)
    complete = F.lit(True)
    for c in features:
        complete = complete & F.col(c).isNotNull()
    train = F.col("cycle_phase").isin(*PHASES[:2])
    return shifted.filter((train & complete) | (F.col("cycle_phase") == PHASES[2])).select(
        "ID", "cycle_phase", "congestion_rating", *SERIES, *features
    )


def used_features(rows: DataFrame, windows: DataFrame, key: str) -> list[str]:
    """G3 for features that rows take from their window (`key`): names of those with a value in any row."""
    names = candidate_features(windows)
    used = windows.join(rows.select(key).distinct(), key, "left_semi")
    counts = used.agg(*[F.count(c).alias(c) for c in names]).first() if names else {}
    return sorted(c for c in names if counts[c])


def shift_windows(
    df: DataFrame, features: Sequence[str], windows: DataFrame, wide: Sequence[str], key: str, periods: int, order: Sequence[str]
) -> DataFrame:
    """G5 for rows whose features `wide` are those of a window: its number `key` is shifted in their place and kept beside `features`."""
    complete = F.lit(True)
    for c in wide:
        complete = complete & F.col(c).isNotNull()
    whole = windows.select(key, complete.alias("_whole"))
    # a number stands for a window where all its features are known, and is null elsewhere, so that incomplete rows leave as in G5
    known = df.join(whole, key, "left").withColumn("_known", F.when(F.col("_whole"), F.col(key))).drop("_whole") if wide else df.withColumn("_known", F.lit(0))
    shifted = shift_features(known.withColumn("_any", F.struct(key)), [*features, "_known", "_any"], periods, order)
    return shifted.withColumn(key, F.col("_any").getField(key)).drop("_known", "_any")


def split_by_phase(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training, validation and test rows."""
    return tuple(df.filter(F.col("cycle_phase") == phase) for phase in PHASES)


def medians(df: DataFrame, features: Sequence[str]) -> dict[str, float | None]:
    """Exact median of every feature."""
    return dict(zip(features, (q[0] for q in exact_quantiles(df, features, [0.5])), strict=True))


def fill_with_train_median(test: DataFrame, train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Nulls of the test rows replaced by training medians (one number per feature)."""
    return filled(test, medians(train, features))


def filled(test: DataFrame, known: dict[str, float | None]) -> DataFrame:
    """Nulls replaced by the given numbers."""
    return test.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v).cast("double")) for c, v in known.items()})


def medians_of_windows(df: DataFrame, features: Sequence[str], windows: DataFrame, wide: Sequence[str], key: str) -> dict[str, float | None]:
    """Exact medians of `features` over the rows, and of `wide` over the windows of the rows, each as often as rows name it."""
    counted = materialise(windows.join(df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")), key).select("_n", *wide))
    weighted = zip(wide, (q[0] for q in exact_quantiles(counted, wide, [0.5], "_n")), strict=True)
    return medians(df, features) | dict(weighted)


def current_state(df: DataFrame) -> DataFrame:
    """Rating of every ID now."""
    return to_long(df).select("ID", F.col("congestion_rating").alias("current_congestion"))


def historical_state(df: DataFrame, periods: int = SHIFT) -> DataFrame:
    """Rating of the series `periods` records before every ID."""

    def step(frame: DataFrame, w) -> DataFrame:
        return frame.withColumn("historical_congestion", F.lag("congestion_rating", periods).over(w))

    long = to_long(df.select("view_label", "video_time", "time_segment_id", "ID_enter", "ID_exit",
                             "congestion_enter_rating", "congestion_exit_rating"))
    done = ordered.framed(long, SERIES, ["video_time", "time_segment_id", "ID"], periods, 0, step)
    return done.select("ID", "historical_congestion")


def add_historical_state(df: DataFrame, history: DataFrame, train_phase: str = PHASES[0]) -> DataFrame:
    """The earlier state as a code; rows without one get the most frequent training code."""
    joined = df.join(history, "ID", "left")
    coded = label_encode(joined, "historical_congestion", "_code_raw")
    top = coded.filter(F.col("cycle_phase") == train_phase).agg(
        F.mode("_code_raw", deterministic=True).alias("top")
    ).scalar()
    code = F.when(F.col("_code_raw") == MISSING, top).otherwise(F.col("_code_raw"))
    return coded.withColumn("historical_congestion_encoded", code).drop("_code_raw")


def missing_lag_policy(
    df: DataFrame, columns: Sequence[str], policy: str, keys: Sequence[str] = ("video_ts", "camera_id"), depth: int = 3
) -> DataFrame:
    """What to do with lags that reach before the first window: 'ffill', 'drop' or 'zero'.

    Forward fill runs over the windows of one video, one row per window.
    """
    if policy == "drop":
        return df.filter(F.col("window_idx") >= depth)
    if policy == "zero":
        return df.fillna(0, list(columns))
    if policy != "ffill":
        raise ValueError(f"unknown policy: {policy}")
    w = Window.partitionBy(*keys).orderBy("window_idx").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def long_cells(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(keys, feature, value) rows."""
    cast = [F.col(c).cast("double").alias(c) for c in features]
    return df.select(*keys, *cast).unpivot(list(keys), list(features), "feature", "value")


def zscore_fit(cells: DataFrame) -> DataFrame:
    """Mean and population deviation per feature; a zero or unknown deviation counts as 1."""
    std = F.stddev_pop("value")
    return cells.groupBy("feature").agg(
        F.coalesce(F.avg("value"), F.lit(0.0)).alias("mean"),
        F.coalesce(F.when(std != 0, std), F.lit(1.0)).alias("std"),
    )


def zscore_apply(cells: DataFrame, fitted: DataFrame) -> DataFrame:
    """Scaled values, 0 where the value is missing."""
    return (
        cells.join(ordered.checked_broadcast(fitted), "feature", "left")
        .withColumn("value", F.coalesce((F.col("value") - F.col("mean")) / F.col("std"), F.lit(0.0)))
        .drop("mean", "std")
    )


def mean_impute_scale(cells: DataFrame, fitted: DataFrame) -> DataFrame:
    """Nulls take the mean of the same batch, then the fitted scaling applies."""
    batch = cells.groupBy("feature").agg(F.avg("value").alias("_batch_mean"))
    filled = (
        cells.join(ordered.checked_broadcast(batch), "feature", "left")
        .withColumn("value", F.coalesce("value", "_batch_mean"))
        .drop("_batch_mean")
    )
    scaled = filled.join(ordered.checked_broadcast(fitted), "feature", "left")
    return scaled.withColumn("value", (F.col("value") - F.col("mean")) / F.col("std")).drop("mean", "std")


def target_mask(df: DataFrame, column: str = "y_true") -> DataFrame:
    """Which targets are known, and the targets with 0 in place of the unknown."""
    known = F.col(column) != MISSING
    return df.withColumns({"valid": known, "y_clean": F.when(known, F.col(column)).otherwise(0)})


def grouped_lags(
    df: DataFrame, columns: Sequence[str], lags: Sequence[int] = (1, 2, 3, 5, 10), rolling: int = 5,
    order: Sequence[str] = ("time_segment_id", "ID"),
) -> DataFrame:
    """Lags and the mean of a full window of earlier rows, per series."""

    def step(frame: DataFrame, w) -> DataFrame:
        out = {f"{c}_lag_{k}": F.lag(c, k).over(w) for c in columns for k in lags}
        recent = w.rowsBetween(1 - rolling, 0)
        for c in columns:
            full = F.count(c).over(recent) == rolling
            out[f"{c}_rolling_{rolling}"] = F.when(full, F.avg(c).over(recent))
        return frame.withColumns(out)

    return ordered.framed(df, SERIES, list(order), max(*lags, rolling), 0, step)


def known(columns: Sequence[str]) -> Column:
    out = F.lit(0)
    for c in columns:
        out = out + F.col(c).isNotNull().cast("int")
    return out
