"""Readers (A1-A6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gyratory import schemas
from gyratory.functions import ordered
from gyratory.functions.scalars import camera_of_view, direction_of, extract_timestamp, parse_video_ts
from gyratory.session import materialise

# Put behind each line before it is parsed: a line with as many fields as its header has it in the next place.
_END = "\u0003"


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A1: label CSV with start and end times, video time, camera and direction."""
    rows = spark.read.csv(path, schema=schemas.LABELS, header=True)
    return rows.withColumns(
        {
            "datetime_start": F.col("datetimestamp_start"),
            "datetime_end": F.col("datetimestamp_end"),
            "video_timestamp": extract_timestamp("videos"),
            "video_ts": parse_video_ts(extract_timestamp("videos")),
            "camera_id": camera_of_view("view_label"),
            "direction": direction_of(camera_of_view("view_label")),
        }
    )


def _cells(line: Column | str, width: int) -> Column:
    """Fields of a CSV line as an array of strings, and the end mark."""
    names = [f"_{i}" for i in range(width + 1)]
    ddl = ", ".join(f"{n} STRING" for n in names)
    row = F.from_csv(F.concat(line, F.lit(f",{_END}")), ddl)
    return F.array(*[row[n] for n in names])


def _feature_lines(spark: SparkSession, folder: str, prefix: str) -> tuple[DataFrame, list[str]]:
    """Parsed lines (_name, _file, _cells, _at, _damaged) and the names of all columns; `_at` holds the place of each name in the file."""
    lines = (
        spark.read.option("pathGlobFilter", f"{prefix}*.csv").option("recursiveFileLookup", "true").text(folder)
        .select(
            "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_name").alias("_name"),
            F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"),
        )
    )
    heads = materialise(lines.filter("_block = 0 and value != ''").groupBy("_file").agg(F.min_by("value", "_line").alias("_head")))
    width = heads.agg(F.max(F.size(F.split("_head", ",")))).first()[0]
    if width is None:
        raise FileNotFoundError(f"no {prefix}*.csv in {folder}")
    parsed = _cells("_head", width)
    named = F.slice(parsed, 1, F.array_position(parsed, _END).cast("int") - 1)
    heads = heads.withColumn("_names", F.transform(named, lambda n, i: F.coalesce(n, F.concat(F.lit("_c"), i.cast("string")))))
    # one row per column name of the result, which becomes a column of the plan
    names = sorted(r[0] for r in heads.select(F.explode("_names")).distinct().collect())
    heads = heads.withColumn("_at", F.array(*[F.array_position("_names", F.lit(n)).cast("int") for n in names]))
    heads = heads.withColumn("_size", F.size("_names"))
    rows = lines.filter("value != ''").join(ordered.checked_broadcast(heads.drop("_names")), "_file").filter(F.col("value") != F.col("_head"))
    rows = rows.select("_name", "_file", "_at", "_size", _cells("value", width).alias("_cells"))
    whole = F.get("_cells", F.col("_size")).eqNullSafe(F.lit(_END))
    return rows.withColumn("_damaged", ~whole), names


def damaged_feature_files(spark: SparkSession, folder: str, prefix: str) -> DataFrame:
    """A2: files that `read_feature_files` leaves out, because a line has more or fewer fields than the header."""
    rows, _ = _feature_lines(spark, folder, prefix)
    return rows.filter("_damaged").select(F.col("_file").alias("file")).distinct()


def read_feature_files(spark: SparkSession, folder: str, prefix: str, types: dict[str, str] | None = None) -> DataFrame:
    """A2: all `{prefix}*.csv` of a folder by column name, with the timestamp of the file name (or folder).

    Files may have different columns; names may be quoted, and one without a name is called by its place. Every line is parsed once, whatever
    its layout, and its cells are picked by the place of their name. A column is numeric if every cell is empty or a number, else text;
    `types` names other types. A file with a line of more or fewer fields than its header is left out whole (`damaged_feature_files`); one that
    cannot be read at all is an error.
    """
    types = types or {}
    rows, names = _feature_lines(spark, folder, prefix)
    place = {n: i for i, n in enumerate(names)}

    def cell(name: str) -> Column:
        # no such column in the file: place 0, which becomes -1 and null
        return F.get("_cells", F.get("_at", F.lit(place[name])) - 1)

    names = [n for n in names if n != "video_timestamp"]
    open_types = [n for n in names if n not in types]
    text = [F.bool_or(cell(n).isNotNull() & cell(n).try_cast("double").isNull()).alias(f"_t{i}") for i, n in enumerate(open_types)]
    files = materialise(rows.groupBy("_file").agg(F.bool_or("_damaged").alias("_bad"), *text))
    found = files.filter("not _bad").agg(F.count(F.lit(1)), *[F.coalesce(F.bool_or(t), F.lit(False)) for t in (f"_t{i}" for i in range(len(open_types)))]).first()
    kinds = {n: "string" if is_text else "double" for n, is_text in zip(open_types, found[1:], strict=True)} | types
    good = ordered.checked_broadcast(files.filter("not _bad").select("_file"))
    stamp = F.coalesce(extract_timestamp("_name"), extract_timestamp("_file")).alias("video_timestamp")
    return rows.join(good, "_file").select(*[cell(n).try_cast(kinds[n]).alias(n) for n in names], stamp)


def tracking_documents(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return spark.read.json(path, schema=schemas.TRACKING, multiLine=multi_line)


def read_tracking(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A3: (vehicles, events, validations) of tracking documents; `seq` keeps the list order of events."""
    docs = tracking_documents(spark, path, multi_line)
    v = docs.select("video_name", F.explode("vehicles").alias("v"))
    vehicles = v.select("video_name", "v.*").drop("events", "validations")
    events = v.select(
        "video_name", "v.tracker_id", "v.class_name", F.posexplode("v.events").alias("seq", "e")
    ).select("video_name", "tracker_id", "class_name", F.col("seq").cast("bigint").alias("seq"),
             "e.event_type", "e.zone_name", "e.frame", F.col("e.timestamp").alias("t_sec"))
    validations = v.select("video_name", "v.tracker_id", F.explode("v.validations").alias("j")).select(
        "video_name", "tracker_id", "j.pattern", "j.start_zone", "j.end_zone", "j.is_valid",
        F.col("j.journey_times.t1_enter_start_zone").alias("t1"), F.col("j.journey_times.t2_exit_start_zone").alias("t2"),
        F.col("j.journey_times.t3_enter_end_zone").alias("t3"), F.col("j.journey_times.t4_exit_end_zone").alias("t4"),
        "j.journey_times.journey_type", "j.journey_times.total_journey_time", "j.journey_times.speed_km_h",
    )
    return vehicles, events, validations


def read_zones(spark: SparkSession, path: str, camera: str = r"camera_(\d+)") -> DataFrame:
    """A4: zone outlines; the camera number stands in the file path."""
    number = F.regexp_extract(F.col("_metadata.file_path"), camera, 1).try_cast("int")
    docs = spark.read.json(path, schema=schemas.ZONE_CONFIG, multiLine=True)
    return docs.select(number.alias("camera_id"), F.explode("zones").alias("zone_name", "polygon"))


def read_zone_distances(spark: SparkSession, path: str) -> DataFrame:
    """A5: (pair, metres); explanatory text entries are dropped."""
    text = spark.read.text(path, wholetext=True)  # one small document
    pairs = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("pair", "_v"))
    return pairs.withColumn("metres", F.col("_v").try_cast("double")).filter("metres is not null").drop("_v")


def distances_dict(distances: DataFrame) -> dict[str, float]:
    """The zone pairs as a dictionary (a few rows)."""
    return {r.pair: r.metres for r in distances.collect()}


def read_submission_template(spark: SparkSession, path: str) -> DataFrame:
    """Template rows with their line order."""
    rows = spark.read.csv(path, schema=schemas.SUBMISSION, header=True)
    where: dict[str, Column] = {
        "_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"),
        "_line": F.monotonically_increasing_id(),
    }
    placed = rows.withColumns(where)
    return ordered.position(placed, [], ["_file", "_block", "_line"], "row_order").drop("_file", "_block", "_line")
