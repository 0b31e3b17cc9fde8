"""Connected components: blocks of links are contracted where they lie, then stars alternate."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyratory.session import materialise

#: Links that a task contracts together; its memory does not depend on the table.
BLOCK = 1 << 16


def _stars(edges: DataFrame) -> DataFrame:
    """One round: hang larger neighbours on the smallest neighbour, then smaller ones."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.filter("a <> b").distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    joined = large.join(least, "a")
    up = joined.select("a", F.col("m").alias("b"))
    across = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return up.union(across).distinct()


def _least_of(links: list[tuple]) -> dict:
    """Smallest node that each node of `links` reaches inside them."""
    up: dict = {}

    def root(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def _contracted(edges: DataFrame, block: int) -> DataFrame:
    """Links (a > b) that connect what `edges` does: those of each block become a star on the smallest node of each of its parts."""
    kind = dict(edges.dtypes)["a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in chain(batches, [None]):
            if batch is not None:
                of = batch.schema.field("a").type
                held += zip(*(batch.column(c).to_pylist() for c in ("a", "b")), strict=True)
            while held and (batch is None or len(held) >= block):
                stars = [(x, y) for x, y in _least_of(held[:block]).items() if x != y]
                held = held[block:]
                yield pa.RecordBatch.from_arrays([pa.array([s[i] for s in stars], of) for i in range(2)], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, f"a {kind}, b {kind}")


def components(edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, root) of every node of `edges` (a, b: comparable ids of one type), root being the smallest node reachable.

    Tasks first contract the links they hold, `block` at a time, in as few tasks as give each that many; if they are one block, that is all.
    Otherwise stars alternate: each round is two aggregations and two joins whose rows never exceed twice the edges, so a hub is neither gathered
    nor squared. Rounds grow with the logarithm of the longest chain; each ends in a checkpoint. A table without edges
    gives no rows; loops and repeated edges do not matter; edges with a null end are left out.
    """
    state = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n = state.count()
    state = materialise(_contracted(state.coalesce(max(1, -(-n // block))), block))
    mark = None
    while n > block:
        now = state.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("a", "b"), 20))).first()
        if now == mark:
            break
        mark, state = now, materialise(_stars(state))
    return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
