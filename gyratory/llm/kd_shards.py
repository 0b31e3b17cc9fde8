"""Sharding by a k-d tree over document metadata, cut at distributed weighted medians."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyratory.session import materialise

BINS, DIGITS = 1024, 4096


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text (none for null) plus 8."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def name_position(value: Column) -> Column:
    """A number in the order of the first six UTF-8 bytes of a name; null is empty."""
    head = F.hex(F.substring(F.coalesce(value, F.lit("")).cast("binary"), 1, 6))
    return F.conv(F.rpad(head, 12, "0"), 16, 10).cast("double")


def count_position(value: Column) -> Column:
    """Logarithm of a count; null and negative ones are 0."""
    return F.log2(F.greatest(F.coalesce(value, F.lit(0)), F.lit(0)).cast("double") + 1)


def metadata_axes(docs: DataFrame) -> dict[str, Column]:
    return {"source": name_position(docs["source"]), "lang": name_position(docs["lang"]), "length": count_position(F.octet_length(docs["text"]))}


@dataclass
class Cut:
    """Left of the cut: lower bins of the axis; in the bin itself lower text digits; in that digit lower row digits."""

    axis: str
    low: float
    high: float
    bin: int = 0
    text: int = 0
    row: int = 0

    def bin_of(self) -> Column:
        if not self.high > self.low:
            return F.lit(0)
        scaled = (F.col(self.axis) - F.lit(self.low)) * F.lit(BINS / (self.high - self.low))
        return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(scaled).cast("int")))

    def left(self) -> Column:
        at = self.bin_of()
        in_digit = (F.col("_text") < self.text) | ((F.col("_text") == self.text) & (F.col("_row") < self.row))
        return (at < self.bin) | ((at == self.bin) & in_digit)


@dataclass
class Node:
    first: int
    leaves: int
    cut: Cut | None = None
    children: list[Node] = field(default_factory=list)


def _stepped(rows: DataFrame, level: list[Node]) -> DataFrame:
    """`rows` with `_node` moved from this level's nodes to their children."""
    moved = F.col("_node")
    for n in level:
        moved = F.when(F.col("_node") == n.first, F.when(n.cut.left(), n.children[0].first).otherwise(n.children[1].first)).otherwise(moved)
    return rows.withColumn("_node", moved)


def _chosen(rows: DataFrame, digit: Column, goals: dict[int, float]) -> dict[int, tuple[int, float, float]]:
    """For each node the digit in which the running weight reaches the goal: (digit, weight before it, its weight).

    Weights are summed by node and digit before they are ordered, so the window has at most nodes times digits rows.
    """
    sums = rows.groupBy("_node", digit.alias("_digit")).agg(F.sum("size").alias("w"))
    running = sums.withColumn("upto", F.sum("w").over(Window.partitionBy("_node").orderBy("_digit")))
    goal = F.create_map(*[F.lit(x) for item in goals.items() for x in (item[0], float(item[1]))])
    hit = running.filter((F.col("upto") >= goal[F.col("_node")]) & (F.col("upto") - F.col("w") < goal[F.col("_node")]))
    return {r["_node"]: (r["_digit"], float(r["upto"] - r["w"]), float(r["w"])) for r in hit.collect()}


def _any(columns: list[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out


def fit_tree(points: DataFrame, axes: list[str], shards: int, tolerance: float = 0.005) -> tuple[list[list[Node]], DataFrame]:
    """Split until each leaf is one shard. `points` has size, _text, _row (digits) and the axes.

    A node of k shards is cut where the running bytes along its widest axis reach (k//2)/k of its own. Four
    aggregations a level find it: ranges, bins of the axis, text digits of the bin, row digits of that digit. A bin or digit lighter than
    `tolerance` of a shard is not cut further, so equal texts at the same place stay together unless they weigh more. The driver
    holds a few numbers a node. Returned are the levels of the tree and the points with `_node`, which ends as the shard.
    """
    level, levels = [Node(0, shards)] if shards > 1 else [], []
    span = points.agg(*[F.min(a).alias(f"l_{a}") for a in axes], *[F.max(a).alias(f"h_{a}") for a in axes]).first()
    whole = {a: (span[f"h_{a}"] or 0.0) - (span[f"l_{a}"] or 0.0) for a in axes}
    points = points.withColumn("_node", F.lit(0))
    while level:
        at = {n.first: n for n in level}
        placed = points.filter(F.col("_node").isin(list(at)))
        ranges = placed.groupBy("_node").agg(
            F.sum("size").alias("w"), *[F.min(a).alias(f"l_{a}") for a in axes], *[F.max(a).alias(f"h_{a}") for a in axes]
        ).collect()
        cuts, goals, slack = {}, {}, {}
        for r in ranges:
            n = at[r["_node"]]
            width = {a: (r[f"h_{a}"] - r[f"l_{a}"]) / whole[a] if whole[a] else 0.0 for a in axes}
            axis = max(axes, key=lambda a: (width[a], -axes.index(a)))
            cuts[n.first] = Cut(axis, r[f"l_{axis}"], r[f"h_{axis}"])
            goals[n.first] = r["w"] * (n.leaves // 2) / n.leaves
            slack[n.first] = tolerance * r["w"] / n.leaves

        def narrowed(step: str, digit_of, rows: DataFrame) -> dict[int, float]:
            """Set this step of the cuts; the goals that remain inside digits too heavy to stay whole."""
            rest = {}
            for node, (digit, before, weight) in _chosen(rows, digit_of, goals_now).items():
                inside = goals_now[node] - before
                if weight > slack[node]:
                    setattr(cuts[node], step, digit)
                    rest[node] = inside
                else:
                    setattr(cuts[node], step, digit + (1 if 2 * inside >= weight else 0))
            return rest

        def pick(value_of) -> Column:
            out = F.lit(None).cast("int")
            for node, cut in cuts.items():
                out = F.when(F.col("_node") == node, value_of(cut)).otherwise(out)
            return out

        goals_now = goals
        if goals_now:
            goals_now = narrowed("bin", pick(lambda c: c.bin_of()), placed)
        if goals_now:
            inside = _any([(F.col("_node") == n) & (cuts[n].bin_of() == cuts[n].bin) for n in goals_now])
            binned = placed.filter(inside)
            goals_now = narrowed("text", F.col("_text"), binned)
            if goals_now:
                inside = _any([(F.col("_node") == n) & (F.col("_text") == cuts[n].text) for n in goals_now])
                goals_now = narrowed("row", F.col("_row"), binned.filter(inside))
        following = []
        for n in level:
            n.cut = cuts.get(n.first, Cut(axes[0], 0.0, 0.0))
            half = n.leaves // 2
            n.children = [Node(n.first, half), Node(n.first + half, n.leaves - half)]
            following += [c for c in n.children if c.leaves > 1]
        # written once a level, so that no expression grows with the depth
        points = materialise(_stepped(points, level))
        levels.append(level)
        level = following
    return levels, points


def points_of(docs: DataFrame, axes: dict[str, Column], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A narrow row per document: doc_id, size, text_crc32, the axes, and the digits that break ties."""
    body = F.coalesce(docs[text], F.lit(""))
    digest = F.xxhash64(body)
    return docs.select(
        docs[doc_id].alias("doc_id"), text_bytes(docs[text]).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), *[c.alias(f"_axis_{a}") for a, c in axes.items()],
        F.pmod(digest, F.lit(DIGITS)).cast("int").alias("_text"), F.pmod(F.xxhash64(F.lit(7), docs[doc_id], digest), F.lit(DIGITS)).cast("int").alias("_row"),
        F.xxhash64(F.lit(11), docs[doc_id], digest).alias("_deal"),
    )


def _slotted(placed: DataFrame, shards: int, rows: int, bucket_rows: int) -> DataFrame:
    """Gapless slots: each shard is dealt into buckets by a hash, numbered alone, and shifted by the rows of its earlier buckets."""
    buckets = max(1, -(-rows // (shards * bucket_rows)))
    dealt = placed.withColumn("_bucket", F.pmod("_deal", F.lit(buckets)).cast("int"))
    sums = dealt.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("_bucket")) - F.col("n")
    offsets = sums.select(F.col("shard").alias("_s"), F.col("_bucket").alias("_b"), before.alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32"))
    numbered = dealt.withColumn("own", own).join(offsets, (F.col("shard") == F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    return numbered.withColumn("slot", F.col("before") + F.col("own") - 1)


def shard_documents(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, axes: dict[str, Column] | None = None, doc_id: str = "doc_id", text: str = "text", bucket_rows: int = 5000) -> DataFrame:
    """(doc_id, size long, text_crc32 long, shard int, slot long): near-equal bytes in each shard, one row per row of `docs`.

    Give `shards`, or `target_bytes` of a shard. Size is the text's UTF-8 bytes plus 8; a null text counts as empty. Null names are empty names, null
    counts zero. Rows at one place of the metadata are told apart by a hash of the text, then of the doc_id; rows equal in both stay in
    one shard. Slots start at 0 in each shard without gaps. An empty table gives no rows.

    Texts are read once into narrow rows; medians come from partial sums of those, and only (shard, bucket) groups of about
    `bucket_rows` rows are sorted.
    """
    axes = axes or metadata_axes(docs)
    points = materialise(points_of(docs, axes, doc_id, text))
    total = points.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("w")).first()
    shards = shards or max(1, -(-total["w"] // target_bytes))
    _, points = fit_tree(points, [f"_axis_{a}" for a in axes], shards)
    out = _slotted(points.withColumnRenamed("_node", "shard"), shards, total["n"], bucket_rows)
    return out.select("doc_id", "size", "text_crc32", "shard", "slot")


def with_shard(docs: DataFrame, shards: int, axes: dict[str, Column] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with its shard number, which replaces a column `shard`: the tree is an expression, so rows do not move."""
    axes = axes or metadata_axes(docs)
    narrow = points_of(docs, axes, doc_id, text)
    levels, _ = fit_tree(materialise(narrow), [f"_axis_{a}" for a in axes], shards)
    body = F.coalesce(docs[text], F.lit(""))
    digest = F.xxhash64(body)
    wide = docs.select(
        *[docs[c] for c in docs.columns if c != "shard"], *[c.alias(f"_axis_{a}") for a, c in axes.items()],
        F.pmod(digest, F.lit(DIGITS)).cast("int").alias("_text"), F.pmod(F.xxhash64(F.lit(7), docs[doc_id], digest), F.lit(DIGITS)).cast("int").alias("_row"),
    )
    wide = wide.withColumn("_node", F.lit(0))
    for level in levels:
        wide = _stepped(wide, level)
    return wide.select(*[c for c in docs.columns if c != "shard"], F.col("_node").alias("shard"))


def write_shards(docs: DataFrame, path: str) -> None:
    """One folder a shard, as Parquet; each shard's rows are spread over tasks of even size first."""
    docs.hint("rebalance", "shard").write.partitionBy("shard").parquet(path)
