"""Tumbling-window features per video and camera.

Tables are keyed by (video_ts, camera_id). Row-level tables (events, journeys) are only ever aggregated,
with map-side combine, so a busy camera costs no more than a quiet one; every ordered window below runs on
already aggregated rows, of which a video has at most two per time window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyratory.constants import (
    CIRCULATING, COUNTED_CLASSES, ENTER, EXIT, LAG_METRICS, LAGS, OD_PAIRS, ROLLING, ROLLING_METRICS,
    WINDOW_SECONDS,
)
from gyratory.functions import ordered
from gyratory.functions.scalars import safe_ratio, window_time_features
from gyratory.session import materialise

VIDEO = ["video_ts", "camera_id"]
KEY = [*VIDEO, "window_idx"]


def window_of(t: Column | str, w: float) -> Column:
    """Index of the half-open window [i*w, (i+1)*w) that holds t."""
    return F.floor(F.col(t) / w if isinstance(t, str) else t / w).cast("int")


def window_spine(vehicles: DataFrame, w: float = WINDOW_SECONDS) -> DataFrame:
    """Every window of every video up to the last sighting, empty ones included.

    `vehicles` is any table of sightings with `last_seen_time`.
    """
    n = vehicles.groupBy(*VIDEO).agg(F.ceil(F.max("last_seen_time") / w).cast("int").alias("_n"))
    idx = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    return n.filter(F.col("_n") > 0).select(*VIDEO, idx.alias("window_idx")).withColumns(_span(w))


def _span(w: float) -> dict[str, Column]:
    start = F.col("window_idx") * F.lit(float(w))
    return {"start_time": start, "end_time": start + float(w), "window_duration": F.lit(float(w))}


def _entered(zones: list[str], class_name: str | None = None) -> Column:
    cond = f"zone_name IN ({', '.join(repr(z) for z in zones)})"
    if class_name:
        cond += f" AND class_name = '{class_name}'"
    return F.expr(f"count_if({cond})")


def _flow_aggs(which: list[str]) -> list[Column]:
    aggs = []
    for name, zone in (("entry", ENTER), ("exit", EXIT)):
        if name in which:
            aggs.append(_entered([zone]).alias(f"{name}_count"))
            aggs += [_entered([zone], c).alias(f"{name}_count_{c}") for c in COUNTED_CLASSES]
    if "circulating" in which:
        aggs.append(_entered(CIRCULATING).alias("circulating_flow_count"))
    return aggs


_FLOW_COUNT = {"entry": "entry_count", "exit": "exit_count", "circulating": "circulating_flow_count"}


def _flow_counts(events: DataFrame, w: float, which: tuple[str, ...]) -> DataFrame:
    """Counts of the windows that have any entry; one scan and one aggregation."""
    zones = [z for name, zs in (("entry", [ENTER]), ("exit", [EXIT]), ("circulating", CIRCULATING))
             if name in which for z in zs]
    return (
        events.filter((F.col("event_type") == "enter") & F.col("zone_name").isin(*zones))
        .groupBy(*VIDEO, window_of("t_sec", w).alias("window_idx"))
        .agg(*_flow_aggs(list(which)))
    )


def _counted(base: DataFrame, sparse: DataFrame, names: list[str]) -> DataFrame:
    return base.join(sparse, KEY, "left").fillna(0, names)


def _rates(w: float, which: tuple[str, ...]) -> dict[str, Column]:
    return {f"{name}_flow_rate": F.col(_FLOW_COUNT[name]) / F.lit(w / 60.0) for name in which}


def flows(
    events: DataFrame, spine: DataFrame, w: float = WINDOW_SECONDS,
    which: tuple[str, ...] = ("entry", "exit", "circulating"),
) -> DataFrame:
    """Zone entries per window, by class, and per minute."""
    counted = _flow_counts(events, w, which)
    names = [c for c in counted.columns if c not in KEY]
    return _counted(spine.select(*KEY), counted, names).withColumns(_rates(w, which))


def entry_flow(events: DataFrame, spine: DataFrame, w: float = WINDOW_SECONDS) -> DataFrame:
    """D2"""
    return flows(events, spine, w, ("entry",))


def exit_flow(events: DataFrame, spine: DataFrame, w: float = WINDOW_SECONDS) -> DataFrame:
    """D3"""
    return flows(events, spine, w, ("exit",))


def circulating_flow(events: DataFrame, spine: DataFrame, w: float = WINDOW_SECONDS) -> DataFrame:
    """D4"""
    return flows(events, spine, w, ("circulating",))


def _changes(events: DataFrame, w: float, place: list[str]) -> DataFrame:
    """Net number of vehicles that a place gains or loses at each sample step i*w/2.

    A vehicle is inside while its last event of the zone is an entry. Per sample step only the last event
    of a vehicle matters, so events are first reduced to that one (map-side as well); each change of state
    is then +1 or -1. Nothing is expanded per covered sample.
    """
    vehicle = [*VIDEO, "tracker_id", "zone_name"]
    # (time, list order) as one number: a fixed-width buffer keeps this a hash aggregation with map-side combine
    at = F.expr("CAST(round(t_sec * 1e9D) AS DECIMAL(20, 0)) * CAST(1000000000000000000 AS DECIMAL(19, 0)) + seq")
    entered, left = F.col("_entered"), F.col("_left")
    last = (
        events.withColumn("_at", at)
        .groupBy(*vehicle, F.ceil(F.col("t_sec") * 2 / w).cast("int").alias("sample"))
        .agg(
            F.expr("max(_at) FILTER (WHERE event_type = 'enter')").alias("_entered"),
            F.expr("max(_at) FILTER (WHERE event_type = 'exit')").alias("_left"),
        )
        .withColumn("_inside", F.coalesce(entered > left, entered.isNotNull()).cast("int"))
    )
    previous = F.lag("_inside", 1, 0).over(Window.partitionBy(*vehicle).orderBy("sample"))
    return (
        last.withColumn("_step", F.col("_inside") - previous)
        .filter(F.col("_step") != 0)
        .groupBy(*place, "sample")
        .agg(F.sum("_step").alias("_step"))
    )


def zone_occupancy(events: DataFrame, spine: DataFrame, w: float = WINDOW_SECONDS) -> DataFrame:
    """Vehicles inside each zone of a video at every sample i*w/2 (start, middle, end of each window).

    A running sum of the changes over the samples of a video: two rows per window, however busy it is.
    """
    place = [*VIDEO, "zone_name"]
    grid = (
        spine.groupBy(*VIDEO).agg((F.max("window_idx") * 2 + 2).alias("_last"))
        .join(events.select(*place).distinct(), VIDEO)
        .select(*place, F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("sample"))
    )
    running = Window.partitionBy(*place).orderBy("sample").rowsBetween(Window.unboundedPreceding, 0)
    return (
        grid.join(_changes(events, w, place), [*place, "sample"], "left")
        .withColumn("occupancy", F.coalesce(F.sum("_step").over(running), F.lit(0)).cast("bigint"))
        .withColumn("sample_time", F.col("sample") * F.lit(w / 2))
        .select(*place, "sample", "sample_time", "occupancy")
    )


def occupancy_stats(events: DataFrame, spine: DataFrame, w: float = WINDOW_SECONDS) -> DataFrame:
    """Average, largest and smallest circulating occupancy at start, middle and end of each window."""
    ring = events.filter(F.col("zone_name").isin(*CIRCULATING))
    first = F.col("sample") % 2 == 0
    steps = _changes(ring, w, VIDEO).groupBy(*VIDEO, F.floor(F.col("sample") / 2).cast("int").alias("window_idx")).agg(
        F.sum(F.when(first, F.col("_step")).otherwise(0)).alias("_at_start"),
        F.sum(F.when(first, 0).otherwise(F.col("_step"))).alias("_at_middle"),
    )
    # the step at the end of the last window belongs to the window after it, hence the outer join
    rows = (
        spine.select(*KEY, F.lit(True).alias("_in_spine")).join(steps, KEY, "full_outer")
        .fillna(0, ["_at_start", "_at_middle"])
    )
    video = Window.partitionBy(*VIDEO).orderBy("window_idx")
    before = F.sum(F.col("_at_start") + F.col("_at_middle")).over(video.rowsBetween(Window.unboundedPreceding, -1))
    return (
        rows.withColumn("_start", F.coalesce(before, F.lit(0)) + F.col("_at_start"))
        .withColumn("_middle", F.col("_start") + F.col("_at_middle"))
        .withColumn("_end", F.col("_middle") + F.lead("_at_start", 1, 0).over(video))
        .filter("_in_spine")
        .select(
            *KEY,
            ((F.col("_start") + F.col("_middle") + F.col("_end")) / 3.0).alias("circulating_occupancy_avg"),
            F.greatest("_start", "_middle", "_end").alias("circulating_occupancy_max"),
            F.least("_start", "_middle", "_end").alias("circulating_occupancy_min"),
        )
    )


def _started(journeys: DataFrame, w: float) -> DataFrame:
    return journeys.filter("is_valid").withColumn("window_idx", window_of("t1", w))


OD_NAMES = [f"od_{a}_to_{b}" for a, b in OD_PAIRS] + ["od_total_flow"]


def _od_aggs() -> list[Column]:
    pairs = [F.count_if((F.col("start_zone") == a) & (F.col("end_zone") == b)) for a, b in OD_PAIRS]
    return [c.alias(n) for c, n in zip([*pairs, F.count(F.lit(1))], OD_NAMES)]


def _speed_aggs() -> list[Column]:
    v = F.col("speed_km_h")
    return [
        F.avg(v).alias("speed_avg_km_h"),
        F.stddev_pop(v).alias("speed_std_km_h"),
        F.min(v).alias("speed_min_km_h"),
        F.max(v).alias("speed_max_km_h"),
        F.avg(F.when(F.col("start_zone") == ENTER, v)).alias("entry_speed_avg_km_h"),
        F.avg(F.when(F.contains("start_zone", F.lit("circulating")), v)).alias("circulating_speed_avg_km_h"),
    ]


_MEDIAN = ("speed_km_h", {"speed_median_km_h": 0.5})


def od_matrix(journeys: DataFrame, spine: DataFrame, w: float = WINDOW_SECONDS) -> DataFrame:
    """Valid journeys begun in a window, by origin and destination."""
    return _counted(spine.select(*KEY), _started(journeys, w).groupBy(*KEY).agg(*_od_aggs()), OD_NAMES)


def speed_stats(journeys: DataFrame, spine: DataFrame, w: float = WINDOW_SECONDS) -> DataFrame:
    """Speed statistics of journeys begun in a window; population deviation, null when empty."""
    begun = materialise(_started(journeys, w).select(*KEY, "start_zone", "speed_km_h"))
    stats = ordered.aggregate_with_quantiles(begun, KEY, _speed_aggs(), *_MEDIAN)
    return spine.select(*KEY).join(stats, KEY, "left")


def derived_features(df: DataFrame) -> DataFrame:
    """Balances and ratios of a window; ratios fall back to their numerator."""
    entry, exit_ = F.col("entry_count"), F.col("exit_count")
    entry_rate, ring_rate = F.col("entry_flow_rate"), F.col("circulating_flow_rate")
    occupancy = F.col("circulating_occupancy_avg")
    flow = entry_rate + F.col("exit_flow_rate")
    return df.withColumns(
        {
            "entry_exit_balance": safe_ratio(entry - exit_, entry + exit_, 0.0),
            "entry_circulating_ratio": safe_ratio(entry_rate, ring_rate, entry_rate),
            "flow_imbalance_index": F.lit(0.0),
            "occupancy_flow_ratio": safe_ratio(occupancy, flow, occupancy),
            "circulating_density": safe_ratio(occupancy, ring_rate, occupancy),
        }
    )


def extract_features(
    events: DataFrame, vehicles: DataFrame, journeys: DataFrame, w: float = WINDOW_SECONDS
) -> DataFrame:
    """All window features of every video in one job.

    Journeys are written once and then read for both the size check and the aggregation.
    """
    which = ("entry", "exit", "circulating")
    spine = window_spine(vehicles, w)
    flow = _flow_counts(events, w, which)
    begun = materialise(_started(journeys, w).select(*KEY, "start_zone", "end_zone", "speed_km_h"))
    moves = ordered.aggregate_with_quantiles(begun, KEY, [*_od_aggs(), *_speed_aggs()], *_MEDIAN)
    out = _counted(occupancy_stats(events, spine, w), flow, [c for c in flow.columns if c not in KEY])
    out = _counted(out, moves, OD_NAMES).withColumns({**_span(w), **_rates(w, which)})
    return derived_features(out.withColumns(window_time_features("video_ts", "start_time")))


def _per_sequence(df: DataFrame, keys: list[str], back: int, step) -> DataFrame:
    # Inside one video a key has one row per window. A key across videos can grow without end.
    order = [c for c in ("video_ts", "window_idx") if c not in keys]
    if "video_ts" in keys:
        return step(df, Window.partitionBy(*keys).orderBy(*order))
    return ordered.framed(df, keys, order, back, 0, step)


def add_lags(
    df: DataFrame, lags: list[int] = LAGS, keys: list[str] = VIDEO, metrics: list[str] = LAG_METRICS
) -> DataFrame:
    """Metrics of earlier windows. keys=['camera_id'] looks back across videos."""

    def step(frame: DataFrame, w) -> DataFrame:
        return frame.withColumns(
            {f"{m}_lag_{k}": F.lag(m, k).over(w) for m in metrics if m in frame.columns for k in lags}
        )

    return _per_sequence(df, keys, max(lags), step)


def add_rolling(
    df: DataFrame, sizes: list[int] = ROLLING, keys: list[str] = VIDEO, metrics: list[str] = ROLLING_METRICS
) -> DataFrame:
    """Rolling mean and sample deviation over the last windows, nulls skipped."""

    def step(frame: DataFrame, w) -> DataFrame:
        out = {}
        for m in metrics:
            for size in sizes if m in frame.columns else []:
                recent = w.rowsBetween(1 - size, 0)
                out[f"{m}_rolling_mean_{size}"] = F.avg(m).over(recent)
                out[f"{m}_rolling_std_{size}"] = F.stddev_samp(m).over(recent)
        return frame.withColumns(out)

    return _per_sequence(df, keys, max(sizes) - 1, step)
