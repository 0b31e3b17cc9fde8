"""Column expressions: parsing, time features, label encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyratory.constants import CAMERA_DIRECTIONS, CONGESTION, MISSING, RUSH_HOURS
from gyratory.functions.ordered import checked_broadcast

# Fixed patterns: the timestamp and the camera number inside file names and view labels.
TIMESTAMP_PATTERN = r"(\d{4}-\d{2}-\d{2}-\d{2}-\d{2}-\d{2})"
TIMESTAMP_FORMAT = "yyyy-MM-dd-HH-mm-ss"
CAMERA_IN_FILE = r"[A-Za-z]+(\d+)[_/]"
CAMERA_IN_VIEW = r"#(\d+)"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def extract_timestamp(col: Column | str) -> Column:
    """B1: first timestamp text inside a string, null when there is none."""
    return F.nullif(F.regexp_extract(_c(col), TIMESTAMP_PATTERN, 1), F.lit(""))


def parse_video_ts(col: Column | str) -> Column:
    """B2: timestamp text -> timestamp, null when malformed."""
    return F.try_to_timestamp(_c(col), F.lit(TIMESTAMP_FORMAT))


def camera_id(col: Column | str, pattern: str = CAMERA_IN_FILE) -> Column:
    """Camera number inside a file name, null when there is none."""
    return F.nullif(F.regexp_extract(_c(col), pattern, 1), F.lit("")).try_cast("int")


def camera_of_view(col: Column | str) -> Column:
    """Camera number of a view label ('... #2' -> 2)."""
    return camera_id(col, CAMERA_IN_VIEW)


def direction_of(camera: Column | str) -> Column:
    """Approach filmed by a camera, null for an unknown camera."""
    out = F.lit(None).cast("string")
    for number, direction in CAMERA_DIRECTIONS.items():
        out = F.when(_c(camera) == number, direction).otherwise(out)
    return out


def is_rush_hour(hour: Column) -> Column:
    return F.when(hour.isNull(), None).otherwise(hour.isin(*RUSH_HOURS).cast("int"))


def window_time_features(video_ts: Column | str, start_s: Column | str) -> dict[str, Column]:
    """Time features of a window; without a video time only the relative hours are known."""
    moment = F.timestamp_micros(F.unix_micros(_c(video_ts)) + (_c(start_s) * 1_000_000).cast("bigint"))
    hour = F.hour(moment)
    day = F.weekday(moment)
    return {
        "hour_of_day": hour,
        "day_of_week": day,
        "is_weekend": (day >= 5).cast("int"),
        "is_rush_hour": is_rush_hour(hour),
        "time_since_midnight": F.coalesce(hour + F.minute(moment) / 60.0, _c(start_s) / 3600.0),
    }


def add_time_features(df: DataFrame, col: str = "video_time") -> DataFrame:
    """Calendar columns of a timestamp column; columns of the same name are replaced."""
    ts = F.col(col).cast("timestamp")
    day = F.weekday(ts)
    return df.withColumns(
        {
            "day_week": day,
            "hour": F.hour(ts),
            "Date": F.to_date(ts),
            "minute": F.minute(ts),
            "is_weekend": F.coalesce((day >= 5).cast("int"), F.lit(0)),
            "is_rush_hour": F.coalesce(is_rush_hour(F.hour(ts)), F.lit(0)),
        }
    )


def parse_submission_id(df: DataFrame) -> DataFrame:
    """Segment, view and ID type out of a submission ID."""
    ident = F.col("ID")
    return df.withColumns(
        {
            "view_label": F.split_part(ident, F.lit("_"), F.lit(4)),
            "time_segment_id": F.split_part(ident, F.lit("_"), F.lit(3)).cast("int"),
            "ID_type": F.concat(
                F.lit("ID_"),
                F.split_part(F.split_part(ident, F.lit("#"), F.lit(2)), F.lit("_"), F.lit(3)),
            ),
            "cycle_phase": F.lit("test_output_5"),
        }
    ).drop("Target", "Target_Accuracy")


def video_basename(col: Column | str) -> Column:
    """File name without folder and .mp4."""
    name = F.when(F.contains(_c(col), F.lit("/")), F.split_part(_c(col), F.lit("/"), F.lit(2))).otherwise(_c(col))
    return F.replace(name, F.lit(".mp4"), F.lit(""))


def encode_congestion(col: Column | str, unknown: str = "error") -> Column:
    """Severity 0..3, null or 'nan' -> -1; any other text raises, or is -1 with unknown='missing'."""
    value = _c(col)
    out = F.when(value.isNull() | (value == "nan"), MISSING)
    for severity, label in enumerate(CONGESTION):
        out = out.when(value == label, severity)
    if unknown == "missing":
        return out.otherwise(MISSING)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown congestion label: "), value)).cast("int"))


def severity(col: Column | str) -> Column:
    """Severity 0..3, null for anything else."""
    out = F.lit(None).cast("int")
    for value, label in enumerate(CONGESTION):
        out = F.when(_c(col) == label, value).otherwise(out)
    return out


def decode_congestion(col: Column | str) -> Column:
    """0..3 -> label, null outside."""
    out = F.lit(None).cast("string")
    for value, label in enumerate(CONGESTION):
        out = F.when(_c(col) == value, label).otherwise(out)
    return out


def appearance_codes(train: DataFrame, test: DataFrame, column: str, order: str) -> DataFrame:
    """Codes 0.. in order of first appearance, training rows before test rows.

    Only the distinct values (one row each) are numbered, never the rows.
    """
    seen = train.select(column, F.lit(0).alias("_side"), F.col(order).alias("_at")).unionByName(
        test.select(column, F.lit(1).alias("_side"), F.col(order).alias("_at"))
    )
    first = F.expr("min(_at) FILTER (WHERE _side = 0)"), F.expr("min(_at) FILTER (WHERE _side = 1)")
    firsts = seen.filter(F.col(column).isNotNull()).groupBy(column).agg(first[0].alias("_a"), first[1].alias("_b"))
    return checked_broadcast(_numbered(firsts, F.col("_a").asc_nulls_last(), F.col("_b")))


def apply_codes(df: DataFrame, codes: DataFrame, column: str) -> DataFrame:
    """The column replaced by its code, -1 where it has none."""
    return (
        df.join(codes, column, "left")
        .withColumn(column, F.coalesce("_code", F.lit(MISSING)))
        .drop("_code")
    )


def encode_by_first_appearance(
    train: DataFrame, test: DataFrame, column: str, order: str
) -> tuple[DataFrame, DataFrame]:
    """B10 for a pair of tables."""
    codes = appearance_codes(train, test, column, order)
    return apply_codes(train, codes, column), apply_codes(test, codes, column)


def label_encode(df: DataFrame, column: str, name: str) -> DataFrame:
    """Sorted distinct values -> 0..k-1, null -> -1."""
    codes = _numbered(df.filter(F.col(column).isNotNull()).select(column).distinct(), column)
    return (
        df.join(checked_broadcast(codes), column, "left")
        .withColumn(name, F.coalesce("_code", F.lit(MISSING)))
        .drop("_code")
    )


def _numbered(values: DataFrame, *order: Column | str) -> DataFrame:
    """Number the distinct values; one row per category of a categorical column."""
    code = F.row_number().over(Window.orderBy(*order)) - 1
    return values.withColumn("_code", code).drop("_a", "_b")


def rule_label(flow: Column | str) -> Column:
    """Congestion label by flow."""
    f = _c(flow)
    return (
        F.when(f < 2, CONGESTION[0]).when(f < 4, CONGESTION[1]).when(f < 6, CONGESTION[2])
        .when(f.isNotNull(), CONGESTION[3])
    )


def safe_ratio(top: Column, bottom: Column, otherwise: Column | float) -> Column:
    """top/bottom where bottom > 0, else the default (also for a null bottom)."""
    other = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return F.when(bottom > 0, top / bottom).otherwise(other)


def row_mean(cols: list[Column]) -> Column:
    """Mean of several columns of a row, nulls skipped, null when all are null."""
    n = sum((c.isNotNull().cast("int") for c in cols[1:]), cols[0].isNotNull().cast("int"))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0.0)))
    return F.when(n > 0, total / n)
