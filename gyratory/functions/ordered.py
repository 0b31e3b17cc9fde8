"""Ordered computations over groups of any size.

A plain ``Window.partitionBy(key)`` sorts a whole key in one task. That is the best plan while every
key is small, and the wrong one when a key holds a large share of the rows. Every function here first
checks the group sizes (one partially aggregated count). Keys below the limit take the plain window;
larger keys are range-partitioned by (key, order), given exact positions, and cut into tiles of bounded
size that overlap by the frame length, so that the result is the same and no task sees a whole key.

Orders must be total: end them with a unique column.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gyratory.session import group_rows, materialise

_BEFORE = (Window.unboundedPreceding, -1)


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for key in keys:
        cond = cond & left[key].eqNullSafe(right[f"_r_{key}"])
    return cond


def _renamed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({key: f"_r_{key}" for key in keys})


def split_by_size(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame | None, DataFrame | None, int]:
    """(rows of small keys, rows of large keys, number of the latter); a side without rows is None.

    There are at most rows/limit large keys, so the list of them stays small.
    """
    limit = group_rows(df.sparkSession)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > limit)
    rows = sizes.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    if not rows:
        return df, None, 0
    if not keys:
        return None, df, rows
    large = _renamed(sizes.drop("_rows"), keys)
    cond = _same(df, large, keys)
    return df.join(large, cond, "left_anti"), df.join(large, cond, "left_semi"), rows


def _parts(df: DataFrame, rows: int) -> int:
    """Range partitions for that many rows: the session's number, more if a task would get over ten limits."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // (10 * group_rows(spark)) + 1)


def _placed(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str, rows: int) -> DataFrame:
    """Exact 1-based position inside each key by range partitioning; no task holds a whole key."""
    ranged = df.repartitionByRange(_parts(df, rows), *keys, *order).sortWithinPartitions(*keys, *order)
    # monotonically_increasing_id = partition number << 33 | row number in the sorted partition
    tagged = materialise(ranged.withColumn("_at", F.monotonically_increasing_id()))
    tagged = tagged.withColumn("_part", F.shiftright("_at", 33))
    runs = tagged.groupBy(*keys, "_part").agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    earlier = F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(*_BEFORE))
    runs = runs.withColumn("_before", F.coalesce(earlier, F.lit(0))).drop("_rows")
    runs = _renamed(runs, [*keys, "_part"])
    joined = tagged.join(runs, _same(tagged, runs, [*keys, "_part"]))
    return joined.withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1).drop(
        "_at", "_part", "_first", "_before", *[f"_r_{key}" for key in [*keys, "_part"]]
    )


def _positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], rows: int, placed: str | None
) -> DataFrame:
    if placed:
        return df.withColumn("_pos", F.col(placed))
    return _placed(df, keys, order, "_pos", rows)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _result(parts: list[DataFrame], large: DataFrame | None) -> DataFrame:
    """Results with large keys are written once, so that steps built on them do not repeat the sorts."""
    return _union(parts) if large is None else materialise(_union(parts))


def position(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """row_number() over (keys; order), as bigint."""
    small, large, rows = split_by_size(df, keys)
    parts = []
    if small is not None:
        w = Window.partitionBy(*keys).orderBy(*order)
        parts.append(small.withColumn(name, F.row_number().over(w).cast("bigint")))
    if large is not None:
        parts.append(_placed(large, keys, order, name, rows))
    return _result(parts, large)


def framed(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    back: int,
    ahead: int,
    step: Callable[[DataFrame, WindowSpec], DataFrame],
    placed: str | None = None,
) -> DataFrame:
    """Apply ``step(frame, window)``, whose frames reach at most ``back`` rows behind and ``ahead`` rows ahead.

    ``placed`` names a column that already holds the position inside the key; it saves the sort of large keys.
    """
    small, large, rows = split_by_size(df, keys)
    parts = []
    if small is not None:
        parts.append(step(small, Window.partitionBy(*keys).orderBy(*order)))
    if large is not None:
        tile_rows = max(group_rows(df.sparkSession), back + ahead + 1)
        offset = F.col("_pos") - 1
        home = F.floor(offset / tile_rows)
        inside = offset % tile_rows
        copies = F.array_compact(
            F.array(
                home,
                F.when(inside >= tile_rows - back, home + 1) if back else F.lit(None).cast("bigint"),
                F.when(inside < ahead, home - 1) if ahead else F.lit(None).cast("bigint"),
            )
        )
        tiled = (
            _positions(large, keys, order, rows, placed)
            .withColumn("_home", home)
            .withColumn("_tile", F.explode(copies))
        )
        done = step(tiled, Window.partitionBy(*keys, "_tile").orderBy("_pos"))
        parts.append(done.filter(F.col("_tile") == F.col("_home")).drop("_pos", "_home", "_tile"))
    return _result(parts, large)


def running_last(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: str, name: str, placed: str | None = None
) -> DataFrame:
    """Last non-null value up to and including the row (forward fill); ``placed`` as in `framed`."""
    upto = (Window.unboundedPreceding, Window.currentRow)
    small, large, rows = split_by_size(df, keys)
    parts = []
    if small is not None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*upto)
        parts.append(small.withColumn(name, F.last(value, ignorenulls=True).over(w)))
    if large is not None:
        tile_rows = group_rows(df.sparkSession)
        tiled = _positions(large, keys, order, rows, placed).withColumn(
            "_tile", F.floor((F.col("_pos") - 1) / tile_rows)
        )
        newest = F.max(F.when(F.col(value).isNotNull(), F.struct("_pos", F.col(value).alias("_v"))))
        tiles = tiled.groupBy(*keys, "_tile").agg(newest.alias("_newest"))
        across = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(*_BEFORE)
        tiles = tiles.withColumn("_carry", F.max("_newest").over(across)["_v"]).drop("_newest")
        tiles = _renamed(tiles, [*keys, "_tile"])
        inside = F.last(value, ignorenulls=True).over(
            Window.partitionBy(*keys, "_tile").orderBy("_pos").rowsBetween(*upto)
        )
        joined = tiled.join(tiles, _same(tiled, tiles, [*keys, "_tile"]))
        parts.append(
            joined.withColumn(name, F.coalesce(inside, F.col("_carry"))).drop(
                "_pos", "_tile", "_carry", *[f"_r_{key}" for key in [*keys, "_tile"]]
            )
        )
    return _result(parts, large)


def aggregate_with_quantiles(
    df: DataFrame, keys: Sequence[str], aggs: Sequence[Column], value: str, probs: dict[str, float]
) -> DataFrame:
    """``groupBy(keys).agg(aggs)`` plus exact linear quantiles of ``value``.

    The built-in exact percentile keeps every distinct value of a group in one buffer, so large groups
    read their quantiles off exact positions instead.
    """
    small, large, rows = split_by_size(df, keys)
    parts = []
    if small is not None:
        exact = [F.percentile(value, F.lit(p)).alias(n) for n, p in probs.items()]
        parts.append(small.groupBy(*keys).agg(*aggs, *exact))
    if large is not None:
        base = large.groupBy(*keys).agg(*aggs, F.count(value).alias("_n"))
        spans = _value_spans(large, keys, value, rows)
        sizes = _renamed(base.select(*keys, "_n"), keys)
        ranked = spans.join(sizes, _same(spans, sizes, keys))
        picks = []
        for n, p in probs.items():
            rank = 1 + F.lit(p) * (F.col("_n") - 1)

            def at(spot: Column) -> Column:
                inside = (F.col("_from") <= spot) & (spot <= F.col("_to"))
                return F.max(F.when(inside, F.col(value).cast("double")))

            low, high = at(F.floor(rank)), at(F.ceil(rank))
            picks.append((low + (high - low) * F.max(rank - F.floor(rank))).alias(n))
        picked = _renamed(ranked.groupBy(*keys).agg(*picks), keys)
        joined = base.join(picked, _same(base, picked, keys), "left")
        parts.append(joined.drop("_n", *[f"_r_{key}" for key in keys]))
    return _union(parts)


def _value_spans(df: DataFrame, keys: Sequence[str], value: str, rows: int) -> DataFrame:
    """Positions `_from`..`_to` that each distinct value takes in the sorted order of its key.

    Equal values are counted before the range partitioning, so a value that fills half the table is one row.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    ranged = materialise(
        counts.repartitionByRange(_parts(df, rows), *keys, value).withColumn("_part", F.spark_partition_id())
    )
    inside = Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    runs = ranged.groupBy(*keys, "_part").agg(F.sum("_c").alias("_rows"))
    earlier = F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(*_BEFORE))
    runs = _renamed(runs.withColumn("_before", F.coalesce(earlier, F.lit(0))).drop("_rows"), [*keys, "_part"])
    placed = ranged.withColumn("_upto", F.sum("_c").over(inside))
    joined = placed.join(runs, _same(placed, runs, [*keys, "_part"]))
    end = F.col("_before") + F.col("_upto")
    return joined.select(*keys, value, (end - F.col("_c") + 1).alias("_from"), end.alias("_to"))


def chronological_position(
    df: DataFrame, ts: str, tie: Sequence[Column | str], name: str, total: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Position by time over the whole table (per ``keys``), and the row total, without a global sort.

    Counts per timestamp are summed up the calendar: a day table (one row per day), at most 86,400
    seconds inside a day, at most a million timestamps inside a second. Only rows that share a timestamp
    are ranked against each other.
    """
    keys = list(keys)
    counts = df.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_sec", F.date_trunc("second", ts)).withColumn("_day", F.date_trunc("day", ts))
    seconds = counts.groupBy(*keys, "_day", "_sec").agg(F.sum("_n").alias("_sn"))
    days = seconds.groupBy(*keys, "_day").agg(F.sum("_sn").alias("_dn"))

    def before(column: str, parts: list[str], order: str) -> Column:
        w = Window.partitionBy(*parts).orderBy(order).rowsBetween(*_BEFORE)
        return F.coalesce(F.sum(column).over(w), F.lit(0))

    days = days.withColumn("_d0", before("_dn", keys, "_day")).withColumn(
        total, F.sum("_dn").over(Window.partitionBy(*keys))
    )
    seconds = seconds.withColumn("_s0", before("_sn", [*keys, "_day"], "_sec"))
    counts = counts.withColumn("_t0", before("_n", [*keys, "_sec"], ts))
    start = (
        counts.join(seconds.drop("_day", "_sn"), [*keys, "_sec"])
        .join(days.drop("_dn"), [*keys, "_day"])
        .select(*keys, ts, total, (F.col("_d0") + F.col("_s0") + F.col("_t0")).alias("_start"))
    )
    ranked = position(df, [*keys, ts], tie, "_rank")
    return (
        ranked.join(start, [*keys, ts])
        .withColumn(name, F.col("_start") + F.col("_rank"))
        .drop("_start", "_rank")
    )


def checked_broadcast(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """A small table ready for broadcast, but only when it proves small; otherwise it is returned as it is.

    The table is computed once: at most max_rows + 1 rows come to the driver, as they would for a broadcast.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) <= max_rows:
        return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
    return df
