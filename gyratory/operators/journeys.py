"""Journeys through zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyratory.constants import JOURNEY_PATTERNS

VIDEO = ["video_ts", "camera_id"]
VEHICLE = [*VIDEO, "tracker_id"]


def validate_journeys(
    events: DataFrame, patterns: list[tuple[str, str]] = JOURNEY_PATTERNS, partial_ok: bool = True
) -> DataFrame:
    """C4: per vehicle and pattern, the four key times and whether they form a journey.

    The first event of each zone and type (in list order, `seq`) is found for all patterns in one
    aggregation per vehicle; the patterns are then unfolded from that one row.
    """
    zones = sorted({z for pair in patterns for z in pair})
    slots = {(z, e): f"_{i}_{e}" for i, z in enumerate(zones) for e in ("enter", "exit")}
    firsts = [
        F.min_by("t_sec", F.when((F.col("zone_name") == z) & (F.col("event_type") == e), F.col("seq"))).alias(slot)
        for (z, e), slot in slots.items()
    ]
    per_vehicle = events.groupBy(*VEHICLE).agg(*firsts)
    unfolded = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(f"{a} -> {b}").alias("pattern"), F.lit(a).alias("start_zone"), F.lit(b).alias("end_zone"),
                    F.col(slots[a, "enter"]).alias("t1"), F.col(slots[a, "exit"]).alias("t2"),
                    F.col(slots[b, "enter"]).alias("t3"), F.col(slots[b, "exit"]).alias("t4"),
                )
                for a, b in patterns
            ]
        )
    )
    out = per_vehicle.select(*VEHICLE, unfolded.alias("_p")).select(*VEHICLE, "_p.*")
    t1, t2, t3, t4 = (F.col(f"t{i}") for i in range(1, 5))
    head = (t1 < t2) & (t2 < t3)
    # all four present: the order of all four decides, without falling back to the first three
    valid = F.when(t4.isNotNull(), head & (t3 < t4)).otherwise(head & F.lit(partial_ok))
    return out.withColumn("is_valid", F.coalesce(valid, F.lit(False)))


def journey_times(journeys: DataFrame) -> DataFrame:
    """Durations of valid journeys, null for the others."""
    t1, t2, t3, t4 = (F.col(f"t{i}") for i in range(1, 5))

    def valid(c: Column) -> Column:
        return F.when(F.col("is_valid"), c)

    return journeys.withColumns(
        {
            "journey_type": valid(F.when(t4.isNotNull(), "complete").otherwise("partial")),
            "time_in_start_zone": valid(t2 - t1),
            "time_between_zones": valid(t3 - t2),
            "time_in_end_zone": valid(t4 - t3),
            "total_journey_time": valid(F.coalesce(t4, t3) - t1),
        }
    )


def journey_speed(journeys: DataFrame, distances: dict[str, float]) -> DataFrame:
    """Speed from the distance 'a_to_b' or else 'b_to_a'; needs a non-zero distance and a positive time."""
    table = F.create_map(*[F.lit(v) for pair in distances.items() for v in (pair[0], float(pair[1]))])
    there = F.concat_ws("_to_", "start_zone", "end_zone")
    back = F.concat_ws("_to_", "end_zone", "start_zone")
    metres = F.coalesce(F.try_element_at(table, there), F.try_element_at(table, back))
    total = F.col("total_journey_time")
    usable = (metres != 0) & (total > 0)
    return journeys.withColumn("distance_meters", F.when(usable, metres)).withColumns(
        {
            "speed_m_s": F.col("distance_meters") / total,
            "speed_km_h": F.col("distance_meters") / total * 3.6,
        }
    )


def journeys_of(
    events: DataFrame, distances: dict[str, float], patterns: list[tuple[str, str]] = JOURNEY_PATTERNS
) -> DataFrame:
    """C4-C6 in one go."""
    return journey_speed(journey_times(validate_journeys(events, patterns)), distances)


def tracking_summary(journeys: DataFrame) -> DataFrame:
    """Valid (vehicle, pattern) pairs, their ratio to the vehicles (may exceed 1), vehicles with any."""
    vehicles = journeys.groupBy(*VEHICLE).agg(F.count_if("is_valid").alias("_valid"))
    return vehicles.groupBy(*VIDEO).agg(
        F.count(F.lit(1)).alias("total_vehicles_detected"),
        F.sum("_valid").alias("valid_journeys_count"),
        (F.sum("_valid") / F.count(F.lit(1))).alias("validation_rate"),
        F.count_if(F.col("_valid") > 0).alias("vehicles_with_valid_journey"),
    )
