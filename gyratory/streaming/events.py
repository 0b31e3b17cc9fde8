"""Streaming twins of the batch operators (K1-K3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyratory.constants import CIRCULATING, COUNTED_CLASSES, ENTER, EXIT
from gyratory.functions import ordered
from gyratory.operators.zones import TRACK, changes, zones_of_detections
from gyratory.session import materialise

# what is kept of a vehicle between batches: its last sighting, and sightings the watermark has not passed
SIGHTING = [*TRACK, "frame_num", "timestamp_s", "zones", "event_time"]
STATE = """video_name STRING, camera_id INT, tracker_id BIGINT, frame_num INT, timestamp_s DOUBLE, zones ARRAY<STRING>,
           event_time TIMESTAMP, kind STRING, version BIGINT"""


def _newest(rows: DataFrame) -> DataFrame:
    """The rows of the newest version; two are kept at most."""
    version = rows.agg(F.max("version")).scalar()
    return rows.filter(F.col("version") == version)


def _moves(rows: DataFrame) -> DataFrame:
    """Zone changes of the `ready` sightings in frame order after the `last` ones."""

    def step(frame: DataFrame, w) -> DataFrame:
        return frame.withColumn("_before", F.coalesce(F.lag("zones", 1).over(w), F.array().cast("array<string>")))

    return changes(ordered.framed(rows, TRACK, ["frame_num"], 1, 0, step).filter("kind = 'ready'"))


def _sorted_out(rows: DataFrame) -> DataFrame:
    """`ready` sightings that do not come after their vehicle's `last` one turn into `late` ones."""
    known = rows.filter("kind = 'last'").select(*[F.col(c).alias(f"_{c}") for c in TRACK], F.col("frame_num").alias("_seen"))
    same = F.lit(True)
    for c in TRACK:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    late = (F.col("kind") == "ready") & (F.col("frame_num") <= F.col("_seen"))
    met = rows.join(known, same, "left").withColumn("kind", F.when(late, F.lit("late")).otherwise(F.col("kind")))
    return met.select(*SIGHTING, "kind")


def track_zone_events(path: str, zones: DataFrame, delay: str = "5 seconds", video_seconds: float | None = None):
    """K1: foreachBatch step that turns detections with `event_time` into zone entries and exits under `path`.

    The expressions are those of the batch operator: each batch is put behind the last sighting of its vehicles and the zones of consecutive
    sightings are compared, so a vehicle that is unseen for long keeps its zones. Sightings wait until the newest event time less
    `delay` has passed them. One that then still comes before a sighting already taken goes to `late`, not away. With `video_seconds` a
    vehicle's state goes once its video is over by that length; tracker numbers belong to one video.

    A batch reads the state of the batch before and writes its own in the other of two slots, so a repeated batch replaces itself.
    """

    def advance(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = zones_of_detections(batch, zones).select(*SIGHTING).withColumn("kind", F.lit("pending"))
        if batch_id:
            fresh = spark.read.schema(STATE).parquet(f"{path}/state/slot={(batch_id - 1) % 2}").drop("version").unionByName(fresh)
        rows = materialise(fresh)
        newest = rows.agg(F.max("event_time").alias("t")).select("t", (F.col("t") - F.expr(f"INTERVAL {delay}")).alias("mark")).first()
        passed = F.col("event_time") <= F.lit(newest.mark)
        kind = F.when((F.col("kind") == "pending") & passed, F.lit("ready")).otherwise(F.col("kind"))
        rows = materialise(_sorted_out(rows.filter("kind != 'clock'").withColumn("kind", kind)))
        _moves(rows.filter("kind in ('last', 'ready')")).write.mode("overwrite").parquet(f"{path}/events/batch_id={batch_id}")
        rows.filter("kind = 'late'").drop("kind").write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}")
        values = [c for c in SIGHTING if c not in TRACK]
        last = rows.filter("kind in ('last', 'ready')").groupBy(*TRACK).agg(F.max_by(F.struct(*values), "frame_num").alias("_s"))
        last = last.select(*TRACK, "_s.*").withColumn("kind", F.lit("last"))
        if video_seconds is not None:
            over = F.col("event_time").cast("double") - F.col("timestamp_s") + F.lit(float(video_seconds))
            last = last.filter(over > F.lit(newest.mark).cast("double"))
        clock = spark.createDataFrame([(newest.t,)], "event_time timestamp").withColumn("kind", F.lit("clock"))
        state = last.unionByName(rows.filter("kind = 'pending'")).unionByName(clock, allowMissingColumns=True)
        state.withColumn("version", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{path}/state/slot={batch_id % 2}")

    return advance


def zone_events(spark: SparkSession, path: str) -> DataFrame:
    """K1: events so far, with those of sightings that still wait for the watermark; the state stays as it is."""
    done = spark.read.parquet(f"{path}/events").drop("batch_id")
    # a copy, since the next batches write over the slots
    state = materialise(_newest(spark.read.schema(STATE).parquet(f"{path}/state")).filter("kind in ('last', 'pending')"))
    waiting = state.withColumn("kind", F.when(F.col("kind") == "pending", "ready").otherwise("last"))
    return done.unionByName(_moves(_sorted_out(waiting.select(*SIGHTING, "kind")).filter("kind != 'late'")))


def run_zone_events(
    stream: DataFrame, zones: DataFrame, path: str, checkpoint: str, delay: str = "5 seconds", video_seconds: float | None = None
) -> DataFrame:
    """K1: drain the available detections and return all events. Input without rows gives none."""
    step = track_zone_events(path, zones, delay, video_seconds)
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return zone_events(stream.sparkSession, path)


def stream_window_flow(events: DataFrame, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """K2: zone entries per camera and event-time window; later rows than the watermark are dropped."""
    zone, kind = F.col("zone_name"), F.col("class_name")
    aggs = []
    for name, z in (("entry", ENTER), ("exit", EXIT)):
        aggs.append(F.count_if(zone == z).alias(f"{name}_count"))
        aggs += [F.count_if((zone == z) & (kind == c)).alias(f"{name}_count_{c}") for c in COUNTED_CLASSES]
    aggs.append(F.count_if(zone.isin(*CIRCULATING)).alias("circulating_flow_count"))
    return (
        events.filter(F.col("event_type") == "enter")
        .withWatermark("event_time", delay)
        .groupBy(F.window("event_time", window).alias("_w"), "camera_id")
        .agg(*aggs)
        .withColumn("window_start", F.col("_w.start")).drop("_w")
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> None:
    """Drain the available input into a table with one folder per micro-batch; a repeated batch replaces itself."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest version of every key of an update-mode table."""
    rows = spark.read.parquet(path).drop("batch_id")
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return newest.select(*keys, "_v.*")


def keep_last_windows(spark: SparkSession, path: str, n: int, key: str = "camera_id", order: str = "window_start"):
    """K3: foreachBatch step that keeps the last n windows of every key in a versioned table.

    Each version holds n rows per key; a batch first cuts itself down to that, then meets the rows of the batch before. Two versions are
    kept, in slots that batches use in turn.
    """

    def cut(rows: DataFrame) -> DataFrame:
        return ordered.position(rows, [key], [F.desc(order)], "_r").filter(F.col("_r") <= n).drop("_r")

    def upsert(batch: DataFrame, batch_id: int) -> None:
        fresh = cut(batch)
        if batch_id:
            old = spark.read.schema(fresh.schema).parquet(f"{path}/slot={(batch_id - 1) % 2}")
            fresh = cut(old.join(fresh.select(key, order), [key, order], "left_anti").unionByName(fresh))
        fresh.withColumn("version", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/slot={batch_id % 2}")

    return upsert


def run_last_windows(stream: DataFrame, path: str, checkpoint: str, n: int) -> DataFrame:
    """K3: drain the input and return the stored windows."""
    spark = stream.sparkSession
    query = (
        stream.writeStream.outputMode("update").foreachBatch(keep_last_windows(spark, path, n))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return materialise(_newest(spark.read.parquet(path)).drop("version", "slot"))
