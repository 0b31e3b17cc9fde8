"""Detections to zone events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyratory.functions import ordered

TRACK = ["video_name", "camera_id", "tracker_id"]
#: Rows and columns of the grid over the zones of a camera.
CELLS = 32


EDGE = "struct<xa:double,ya:double,xb:double,yb:double>"
ZONE = f"struct<name:string,odd:boolean,x0:double,x1:double,y0:double,y1:double,edges:array<{EDGE}>>"


def _touched(low: np.ndarray, high: np.ndarray, at: float, step: float, count: int) -> np.ndarray:
    """Whether each of `count` columns is met by one of the ranges low..high."""
    first = np.clip(np.floor((low - at) / step), 0, count - 1).astype(int)
    last = np.clip(np.floor((high - at) / step), 0, count - 1).astype(int)
    ends = np.bincount(first, minlength=count + 1) - np.bincount(last + 1, minlength=count + 1)[: count + 1]
    return np.cumsum(ends[:count]) > 0


def _rows_of(polygon: np.ndarray, grid: np.ndarray, cells: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, state by column, edges, their least x, their largest x) of each grid row: 0 outside, 1 inside, 2 border. Edges are those that cross the row."""
    gx, gy, dx, dy = grid
    edges = np.concatenate((polygon, np.roll(polygon, -1, axis=0)), axis=1)
    slack_x, slack_y = 1e-7 * (abs(gx) + dx * cells), 1e-7 * (abs(gy) + dy * cells)
    for row in range(cells):
        low, high = gy + row * dy - slack_y, gy + (row + 1) * dy + slack_y
        near = edges[(np.minimum(edges[:, 1], edges[:, 3]) <= high) & (np.maximum(edges[:, 1], edges[:, 3]) >= low)]
        if not len(near):
            continue
        xa, ya, xb, yb = near.T
        flat = ya == yb
        rise = np.where(flat, 1.0, yb - ya)
        ends = [np.where(flat, x, xa + (xb - xa) * (np.clip(y, np.minimum(ya, yb), np.maximum(ya, yb)) - ya) / rise) for x, y in ((xa, low), (xb, high))]
        left, right = np.minimum(*ends) - slack_x, np.maximum(*ends) + slack_x
        border = _touched(left, right, gx, dx, cells)
        # a column that no edge meets is wholly inside or outside, like its middle
        y, x = gy + (row + 0.5) * dy, gx + (np.arange(cells) + 0.5) * dx
        spans = (ya > y) != (yb > y)
        at = xa + (xb - xa) * (y - ya) / rise
        inside = ((x[:, None] < at[None, :]) & spans[None, :]).sum(axis=1) % 2
        yield row, np.where(border, 2, inside), near[~flat], left[~flat], right[~flat]


def grid_cells(zones: DataFrame, cells: int = CELLS) -> tuple[DataFrame, DataFrame]:
    """(grid, cells) of the cameras' zones.

    The grid (camera_id, gx, gy, dx, dy) lays `cells` x `cells` cells over all zones of a camera. A row of `cells` (camera_id, cell, inside, border) names the
    zones that hold the whole cell and those whose border meets it, with the edges that a point of the cell can meet to its right. Edges that every
    such point meets are told by `odd` alone. Cells that no zone meets have no row.
    """
    xs, ys = F.transform("polygon", lambda p: p[0]), F.transform("polygon", lambda p: p[1])
    box = zones.groupBy("camera_id").agg(F.min(F.array_min(xs)).alias("gx"), F.min(F.array_min(ys)).alias("gy"), F.max(F.array_max(xs)).alias("_x"), F.max(F.array_max(ys)).alias("_y"))

    def side(low: str, high: str) -> Column:
        return F.when(F.col(high) > F.col(low), (F.col(high) - F.col(low)) / cells).otherwise(1.0)

    grid = box.select("camera_id", "gx", "gy", side("gx", "_x").alias("dx"), side("gy", "_y").alias("dy"))

    def build(table: pa.Table) -> pa.Table:
        made: dict[int, tuple[list, list]] = {}
        at = np.array([table.column(c)[0].as_py() for c in ("gx", "gy", "dx", "dy")])
        for name, corners in zip(table.column("zone_name").to_pylist(), table.column("polygon").to_pylist(), strict=True):
            polygon = np.array(corners, float)
            (x0, y0), (x1, y1) = polygon.min(axis=0).tolist(), polygon.max(axis=0).tolist()
            for row, states, edges, left, right in _rows_of(polygon, at, cells):
                low, high = at[1] + row * at[3], at[1] + (row + 1) * at[3]
                margin = 1e-7 * (abs(at[1]) + at[3] * cells)
                through = (np.minimum(edges[:, 1], edges[:, 3]) < low - margin) & (np.maximum(edges[:, 1], edges[:, 3]) > high + margin)
                for column in np.flatnonzero(states).tolist():
                    inside, border = made.setdefault(row * cells + column, ([], []))
                    if states[column] == 1:
                        inside.append(name)
                        continue
                    start, stop = at[0] + column * at[2], at[0] + (column + 1) * at[2]
                    sure = through & (left > stop)
                    open_edges = edges[~sure & (right >= start)]
                    border.append({"name": name, "odd": bool(sure.sum() % 2), "x0": x0, "x1": x1, "y0": y0, "y1": y1, "edges": [dict(zip(("xa", "ya", "xb", "yb"), e)) for e in open_edges.tolist()]})
        return pa.table({
            "camera_id": pa.array([table.column("camera_id")[0].as_py()] * len(made), table.column("camera_id").type), "cell": pa.array(list(made), pa.int32()),
            "inside": pa.array([v[0] for v in made.values()], pa.list_(pa.string())),
            "border": pa.array([v[1] for v in made.values()], pa.list_(pa.struct([("name", pa.string()), ("odd", pa.bool_()), *((c, pa.float64()) for c in ("x0", "x1", "y0", "y1")),
                ("edges", pa.list_(pa.struct([(c, pa.float64()) for c in ("xa", "ya", "xb", "yb")])))]))),
        })

    kind = dict(zones.dtypes)["camera_id"]
    drawn = zones.select("camera_id", "zone_name", "polygon").join(grid, "camera_id").groupBy("camera_id")
    return grid, drawn.applyInArrow(build, f"camera_id {kind}, cell int, inside array<string>, border array<{ZONE}>")


def _inside(zone: Column, x: Column, y: Column) -> Column:
    """Even-odd rule; lower and left borders belong to the zone, upper and right ones do not."""

    def crosses(edge: Column) -> Column:
        spans = (edge["ya"] > y) != (edge["yb"] > y)
        at = edge["xa"] + (edge["xb"] - edge["xa"]) * (y - edge["ya"]) / (edge["yb"] - edge["ya"])
        return F.when(spans, x < at).otherwise(False)

    box = (x >= zone["x0"]) & (x <= zone["x1"]) & (y >= zone["y0"]) & (y <= zone["y1"])
    odd = F.aggregate(zone["edges"], zone["odd"], lambda acc, edge: acc != crosses(edge))
    return F.when(box, odd).otherwise(False)


def zones_of_detections(detections: DataFrame, zones: DataFrame) -> DataFrame:
    """Detections with `zones`, the sorted names of the zones that hold the box's bottom centre.

    A detection looks up its grid cell: most cells are wholly inside or outside a zone, and only in border cells are the few edges that matter there
    tested. Both lookups are equi-joins with tables of at most one row a camera or a cell, broadcast once they have proved small.
    """
    grid, cells = (t.withColumnsRenamed({c: f"_{c}" for c in t.columns if c != "camera_id"}) for t in grid_cells(zones))
    x, y = (F.col("x1") + F.col("x2")) / 2, F.col("y2")

    def place(value: Column, low: str, step: str) -> Column:
        at = F.floor((value - F.col(low)) / F.col(step))
        # the last cell holds its upper end
        return F.when((at == CELLS) & (value <= F.col(low) + F.col(step) * (CELLS + 1e-7)), CELLS - 1).when((at >= 0) & (at < CELLS), at)

    located = detections.join(ordered.checked_broadcast(grid), "camera_id", "left")
    located = located.withColumn("_cell", (place(y, "_gy", "_dy") * CELLS + place(x, "_gx", "_dx")).cast("int")).drop("_gx", "_gy", "_dx", "_dy")
    met = located.join(ordered.checked_broadcast(cells, 20_000), ["camera_id", "_cell"], "left")
    crossed = F.transform(F.filter(F.coalesce("_border", F.array()), lambda z: _inside(z, x, y)), lambda z: z["name"])
    return met.withColumn("zones", F.array_sort(F.concat(F.coalesce("_inside", F.array().cast("array<string>")), crossed))).drop("_cell", "_inside", "_border")


def point_in_zone(detections: DataFrame, zones: DataFrame) -> DataFrame:
    """One row per (detection, zone that contains it)."""
    return zones_of_detections(detections, zones).withColumn("zone_name", F.explode("zones")).drop("zones")


def detect_zone_events(detections: DataFrame, zones: DataFrame) -> DataFrame:
    """Entries and exits between consecutive sightings of a vehicle, entries first within a frame."""
    seen = zones_of_detections(detections, zones).select(*TRACK, "frame_num", "timestamp_s", "zones")

    def step(frame: DataFrame, w) -> DataFrame:
        return frame.withColumn("_before", F.coalesce(F.lag("zones", 1).over(w), F.array().cast("array<string>")))

    moved = ordered.framed(seen, TRACK, ["frame_num"], 1, 0, step)
    return changes(moved)


def changes(moved: DataFrame) -> DataFrame:
    """Rows with `zones` and `_before` -> one row per zone entered or left."""

    def events(names: Column, kind: str) -> Column:
        return F.transform(
            F.array_sort(names), lambda z: F.struct(F.lit(kind).alias("event_type"), z.alias("zone_name"))
        )

    both = F.concat(
        events(F.array_except("zones", "_before"), "enter"), events(F.array_except("_before", "zones"), "exit")
    )
    return moved.select(*TRACK, "frame_num", "timestamp_s", F.posexplode(both).alias("_i", "_e")).select(
        *TRACK, "frame_num", "timestamp_s", "_e.event_type", "_e.zone_name",
        (F.col("frame_num").cast("bigint") * 1000 + F.col("_i")).alias("seq"),
    )


def vehicle_lifecycle(detections: DataFrame) -> DataFrame:
    """First and last sighting of a vehicle; its class is the one of the first sighting."""
    return detections.groupBy(*TRACK).agg(
        F.min_by("class_id", "frame_num").alias("class_id"),
        F.min_by("class_name", "frame_num").alias("class_name"),
        F.min("frame_num").alias("first_seen_frame"),
        F.max("frame_num").alias("last_seen_frame"),
        F.min("timestamp_s").alias("first_seen_time"),
        F.max("timestamp_s").alias("last_seen_time"),
        F.count(F.lit(1)).alias("frames_seen"),
    )
