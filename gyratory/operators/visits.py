"""Zone visits, dwell times and per-video summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyratory.functions import ordered
from gyratory.session import materialise

VIDEO = ["video_ts", "camera_id"]
VEHICLE = [*VIDEO, "tracker_id"]


def zone_visits(events: DataFrame) -> DataFrame:
    """Each entry paired with the exit that follows it; an unpaired side stays null."""
    keys = [*VEHICLE, "zone_name"]

    def step(frame: DataFrame, w) -> DataFrame:
        return frame.withColumns(
            {
                "_previous": F.lag("event_type").over(w),
                "_next": F.lead("event_type").over(w),
                "_next_t": F.lead("t_sec").over(w),
            }
        )

    rows = ordered.framed(events.select(*keys, "class_name", "event_type", "t_sec", "seq"), keys, ["t_sec", "seq"], 1, 1, step)
    entry = F.col("event_type") == "enter"
    orphan = ~entry & ~F.coalesce(F.col("_previous") == "enter", F.lit(False))
    left = F.when(entry, F.when(F.col("_next") == "exit", F.col("_next_t"))).otherwise(F.col("t_sec"))
    return (
        rows.filter(entry | orphan)
        .select(*keys, "class_name", "seq", F.when(entry, F.col("t_sec")).alias("time_entered"), left.alias("time_exited"))
        .withColumn("duration", F.col("time_exited") - F.col("time_entered"))
    )


def dwell_stats(visits: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Distribution of the known durations per video and zone."""
    d, keys = F.col("duration"), keys or [*VIDEO, "zone_name"]
    return ordered.aggregate_with_quantiles(
        materialise(visits.filter(d.isNotNull()).select(*keys, d)),
        keys,
        [
            F.avg(d).alias("dwell_mean"), F.min(d).alias("dwell_min"), F.max(d).alias("dwell_max"),
            F.stddev_samp(d).alias("dwell_std"), F.count(d).alias("dwell_count"),
        ],
        "duration",
        {"dwell_median": 0.5},
    )


def duration_summary(vehicles: DataFrame, visits: DataFrame) -> DataFrame:
    """Vehicles in total and per zone, for each video and over all of them.

    A vehicle belongs to one video, so the totals over all files add up per video.
    """
    total = vehicles.groupBy(*VIDEO).agg(F.count(F.lit(1)).alias("vehicles")).withColumn("zone_name", F.lit("(all)"))
    per_zone = visits.select(*VEHICLE, "zone_name").distinct().groupBy(*VIDEO, "zone_name").agg(
        F.count(F.lit(1)).alias("vehicles")
    )
    both = total.unionByName(per_zone)
    return both.unionByName(
        both.groupBy("zone_name").agg(F.sum("vehicles").alias("vehicles")).select(
            F.lit(None).cast("timestamp").alias("video_ts"), F.lit(None).cast("int").alias("camera_id"),
            "vehicles", "zone_name",
        )
    )


def vehicle_class_counts(vehicles: DataFrame, classes: list[str]) -> DataFrame:
    """C11: vehicles per class and video, one column per class."""
    return vehicles.groupBy(*VIDEO).agg(
        *[F.count_if(F.col("class_name") == c).alias(f"vehicle_class_{c}") for c in classes]
    )


def journey_stats(vehicles: DataFrame, visits: DataFrame) -> DataFrame:
    """How long vehicles were visible and how many zones they visited."""
    zones = visits.select(*VEHICLE, "zone_name").distinct().groupBy(*VEHICLE).agg(F.count(F.lit(1)).alias("_zones"))
    visible = F.col("last_seen_time") - F.col("first_seen_time")
    return (
        vehicles.join(zones, VEHICLE, "left")
        .fillna(0, ["_zones"])
        .groupBy(*VIDEO)
        .agg(
            F.avg(visible).alias("avg_journey_duration"), F.min(visible).alias("min_journey_duration"),
            F.max(visible).alias("max_journey_duration"), F.avg("_zones").alias("avg_zones_visited"),
            F.max("_zones").alias("max_zones_visited"),
        )
    )


def zone_throughput(visits: DataFrame, vehicles: DataFrame, classes: list[str]) -> DataFrame:
    """Visits, distinct vehicles, vehicles per minute of video and vehicles by class in each zone."""
    minutes = vehicles.groupBy(*VIDEO).agg((F.max("last_seen_time") / 60.0).alias("_minutes"))
    per_vehicle = visits.groupBy(*VEHICLE, "zone_name", "class_name").agg(F.count(F.lit(1)).alias("_visits"))
    per_zone = per_vehicle.groupBy(*VIDEO, "zone_name").agg(
        F.sum("_visits").alias("total_visits"),
        F.count(F.lit(1)).alias("unique_vehicles"),
        *[F.count_if(F.col("class_name") == c).alias(f"vtype_{c}") for c in classes],
    )
    rate = F.when(F.col("_minutes") > 0, F.col("unique_vehicles") / F.col("_minutes"))
    return per_zone.join(minutes, VIDEO).withColumn("throughput", rate).drop("_minutes")


def video_summary(vehicles: DataFrame, visits: DataFrame, zones: list[str], classes: list[str]) -> DataFrame:
    """C14: one wide row per video."""
    in_zone = F.col("zone_name")
    counts = visits.select(*VEHICLE, "zone_name").distinct().groupBy(*VIDEO).agg(
        *[F.count_if(in_zone == z).alias(f"zone_count_{z}") for z in zones]
    )
    names = ["dwell_mean", "dwell_median", "dwell_min", "dwell_max", "dwell_std", "dwell_count"]
    dwell = dwell_stats(visits).groupBy(*VIDEO).agg(
        *[F.max(F.when(in_zone == z, F.col(n))).alias(f"{n}_{z}") for n in names for z in zones]
    )
    total = vehicles.groupBy(*VIDEO).agg(
        F.count(F.lit(1)).alias("total_vehicles_tracked"), F.max("last_seen_time").alias("duration_seconds")
    )
    out = total
    for part in (vehicle_class_counts(vehicles, classes), journey_stats(vehicles, visits), counts, dwell):
        out = out.join(part, VIDEO, "left")
    return out.withColumns(
        {"date": F.to_date("video_ts"), "hour": F.hour("video_ts"), "minute": F.minute("video_ts")}
    )
