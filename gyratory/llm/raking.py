"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyratory.session import materialise

AXES = ("source", "lang", "topic")


def token_weight(text: Column) -> Column:
    """Tokens of a text taken as a quarter of its UTF-8 bytes, rounded up; null has none."""
    return F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4).cast("long")


def topic_of(text: Column, markers: dict[str, list[str]], other: str = "other") -> Column:
    """The topic whose markers occur most often in the whole text; the first of equals, `other` without any."""
    body = F.coalesce(text, F.lit(""))

    def count(words: list[str]) -> Column:
        total = F.lit(0)
        for w in words:
            total = total + (F.octet_length(body) - F.octet_length(F.replace(body, F.lit(w), F.lit("")))) / len(w.encode())
        return total

    scores = [F.struct(count(words).alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("topic")) for i, (name, words) in enumerate(markers.items())]
    best = F.array_max(F.array(*scores))
    return F.when(best["n"] > 0, best["topic"]).otherwise(other)


def _shares(axis: str, target: float | dict[str, float], named_tokens: float) -> Column:
    """Target share of a cell's value on an axis.

    A number is an exponent: shares in proportion to natural tokens to that power. A dict names shares; values that it does not name divide
    the rest in proportion to their natural tokens, or keep their natural share where the named ones leave no rest (an empty or foreign name is
    never dropped for not being named); values that do not occur leave their share to all others.
    """
    natural = F.col(f"n_{axis}")
    if not isinstance(target, dict):
        return F.pow(natural, F.lit(float(target)))
    named = F.create_map(*[F.lit(x) for item in target.items() for x in (item[0], float(item[1]))]) if target else None
    rest = max(0.0, 1.0 - sum(target.values()))
    share = natural * F.lit(rest) / F.col(f"r_{axis}") if rest > 1e-9 else natural / F.lit(float(named_tokens) or 1.0)
    return share if named is None else F.when(F.col(axis).isin(list(target)), named[F.col(axis)]).otherwise(share)


def _factor(rows: DataFrame, weight: Column, cap: Column, goal: float) -> float:
    """The factor at which the sum of the weights, each at most its cap, is the goal; at most 50 sums over `rows`."""
    whole = rows.agg(F.sum(weight)).first()[0]
    factor = goal / whole if whole else 0.0
    for _ in range(50):
        full = weight * F.lit(factor) >= cap
        capped, free = rows.agg(F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, weight)), F.lit(0.0))).first()
        more = (goal - capped) / free if free > 0 else factor
        if more <= factor * (1 + 1e-12):
            break
        factor = more
    return factor


def _small(df: DataFrame, rows: int, per_task: int) -> DataFrame:
    return df.coalesce(max(1, -(-rows // per_task)))


def _aimed(cells: DataFrame, targets: dict[str, float | dict[str, float]], fraction: float, total: int, rows: int, per_task: int, whole: bool) -> DataFrame:
    """`cells` with the target share (share_) of its value on each axis; with `whole` also the tokens to aim at (aim_).

    No value has more than its own tokens, so what a share asks beyond them is handed to the other values in proportion to their shares.
    """
    for axis in targets:
        target = targets[axis]
        named = list(target) if isinstance(target, dict) else []
        natural = cells.groupBy(axis).agg(F.sum("tokens").cast("double").alias(f"n_{axis}"))
        rest = total - (natural.filter(F.col(axis).isin(named)).agg(F.coalesce(F.sum(f"n_{axis}"), F.lit(0.0))).first()[0] if named else 0)
        natural = natural.withColumn(f"r_{axis}", F.lit(float(rest) or 1.0))
        natural = natural.withColumn("share", _shares(axis, target, total - rest))
        full = natural.agg(F.coalesce(F.sum("share"), F.lit(1.0))).first()[0] or 1.0
        natural = natural.select(axis, f"n_{axis}", (F.col("share") / F.lit(full)).alias(f"share_{axis}"))
        columns = [axis, f"share_{axis}"]
        if whole:
            natural = materialise(_small(natural, rows, per_task))
            factor = _factor(natural, F.col(f"share_{axis}"), F.col(f"n_{axis}"), fraction * total)
            natural = natural.withColumn(f"aim_{axis}", F.least(F.col(f"share_{axis}") * F.lit(factor), F.col(f"n_{axis}")))
            columns.append(f"aim_{axis}")
        cells = cells.join(natural.select(*columns), axis)
    return cells


def rake(cells: DataFrame, targets: dict[str, float | dict[str, float]], fraction: float, sweeps: int | None = None, per_task: int = 100_000, tolerance: float = 1e-3, most: int = 40) -> DataFrame:
    """`cells` (axes, tokens) with `weight`: tokens to take, at most the cell's own, raked to the target shares.

    Each sweep scales the weights to every axis in turn. Cells that are taken whole stay so, and the others of a value make up what is missing.
    Shares that ask more than a value has are first made feasible. Sweeps end when no axis misses its tokens by more than `tolerance` of all
    to take, when it gets no nearer (caps of cells leave no solution), or after `most` of them; all tokens to take are `fraction` of those there in
    either case, unless values with a share of nothing are needed for it. `margins` tells what was reached.

    A number of `sweeps` asks for just so many of plain scaling with a cap, as the SQL twin of op3 has them: excess over a cap is then lost. Cells are
    one row per combination of values, not per document; up to `per_task` of them are handled without a shuffle.
    """
    axes = list(targets)
    rows = cells.count()
    cells = _small(cells, rows, per_task)
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    goal = fraction * total
    cells = _aimed(cells, targets, fraction, total, rows, per_task, sweeps is None)
    state = materialise(_small(cells.withColumn("weight", F.col("tokens") * F.lit(float(fraction))), rows, per_task))
    own = F.col("tokens").cast("double")
    missed = float("inf")
    for sweep in range(most if sweeps is None else sweeps):
        for axis in axes:
            of = Window.partitionBy(axis)
            now = F.sum("weight").over(of)
            if sweeps is None:
                full = F.col("weight") >= own * (1 - 1e-12)
                taken = F.sum(F.when(full, F.col("weight")).otherwise(0.0)).over(of)
                aim = F.col(f"aim_{axis}")
                up = F.when(full | (now <= taken), F.col("weight")).otherwise(F.col("weight") * (aim - taken) / (now - taken))
                scaled = F.when(now >= aim, F.col("weight") * aim / now).otherwise(up)
            else:
                scaled = F.col("weight") * F.lit(goal) * F.col(f"share_{axis}") / now
            state = state.withColumn("weight", F.when(now > 0, F.least(scaled, own)).otherwise(0.0))
        if sweep % 4 == 3:
            state = materialise(state)
            if sweeps is None:
                missed, before = _missed(state, axes), missed
                if missed <= tolerance * goal or missed > 0.98 * before:
                    break
    if sweeps is None and goal > 0:
        factor = _factor(state, F.col("weight"), own, goal)
        state = state.withColumn("weight", F.least(F.col("weight") * F.lit(factor), own))
    return state.select(*axes, "tokens", "weight")


def _missed(state: DataFrame, axes: list[str]) -> float:
    """Tokens by which the axis that is farthest off misses its aims."""
    off = [state.groupBy(a).agg(F.abs(F.sum("weight") - F.first(f"aim_{a}")).alias("off")).agg(F.coalesce(F.sum("off"), F.lit(0.0)).alias("off")) for a in axes]
    both = off[0]
    for x in off[1:]:
        both = both.union(x)
    return both.agg(F.max("off")).first()[0]


def margins(raked: DataFrame, targets: dict[str, float | dict[str, float]], fraction: float, per_task: int = 100_000) -> DataFrame:
    """(axis, value, target, feasible, reached) of what `rake` returned: shares of the tokens to take, as asked, as far as the value's tokens allow, as taken."""
    rows = raked.count()
    total = raked.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    goal = F.lit(fraction * total or 1.0)
    aimed = materialise(_aimed(raked, targets, fraction, total, rows, per_task, True))
    parts = [
        aimed.groupBy(a).agg(F.first(f"share_{a}").alias("target"), F.first(f"aim_{a}").alias("aim"), F.sum("weight").alias("w")).select(
            F.lit(a).alias("axis"), F.col(a).alias("value"), "target", (F.col("aim") / goal).alias("feasible"), (F.col("w") / goal).alias("reached"))
        for a in targets
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def uniform(doc_id: Column) -> Column:
    """A number in [0, 1) fixed by the doc_id (null is empty), so a rerun task draws the same."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def mix_documents(docs: DataFrame, targets: dict[str, float | dict[str, float]], fraction: float = 0.5, topic: Column | None = None, tokens: Column | None = None, doc_id: str = "doc_id", text: str = "text", sweeps: int | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, probability, kept) of each row: documents drawn once at most, by calibrated probabilities.

    Weights of tokens are raked to the shares of source, language and topic, `sweeps` as in `rake`; a document's probability is the raked weight of its cell over the
    cell's tokens, at most 1, so a cell too small for its share is taken whole. Null names count as empty names. Cells without tokens
    get `fraction`. Repeated rows have the same draw. An empty table gives no rows.

    Texts are read once into narrow rows. Cells are sums with a partial step, so a source with a third of all rows is a few partial sums; the
    join back is by cell.
    """
    names = {a: F.coalesce(F.col(a), F.lit("")) for a in ("source", "lang")}
    topic = topic if topic is not None else F.lit("all")
    tokens = tokens if tokens is not None else token_weight(F.col(text))
    rows = materialise(docs.select(F.col(doc_id).alias("doc_id"), names["source"].alias("source"), names["lang"].alias("lang"), topic.alias("topic"), tokens.alias("tokens")))
    cells = materialise(rows.groupBy(*AXES).agg(F.sum("tokens").alias("tokens")))
    raked = rake(cells, targets, fraction, sweeps)
    chance = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(F.lit(float(fraction)))
    raked = materialise(raked.select(*AXES, F.least(chance, F.lit(1.0)).alias("probability")))
    out = rows.join(raked, list(AXES))
    return out.select("doc_id", *AXES, "tokens", "probability", (uniform(F.col("doc_id")) < F.col("probability")).alias("kept"))


def draw_documents(docs: DataFrame, targets: dict[str, float | dict[str, float]], fraction: float = 0.5, topic: Column | None = None, doc_id: str = "doc_id", text: str = "text", sweeps: int | None = None, broadcast_cells: int = 50_000) -> DataFrame:
    """The rows of `docs` that `mix_documents` keeps, with their own columns. Up to `broadcast_cells` cells travel to the rows; more are joined."""
    topic = topic if topic is not None else F.lit("all")
    wide = docs.select("*", F.coalesce(F.col("source"), F.lit("")).alias("_source"), F.coalesce(F.col("lang"), F.lit("")).alias("_lang"), topic.alias("_topic"))
    keys = ["_source", "_lang", "_topic"]
    cells = materialise(wide.groupBy(*keys).agg(F.sum(token_weight(F.col(text))).alias("tokens")).withColumnsRenamed(dict(zip(keys, AXES, strict=True))))
    raked = rake(cells, targets, fraction, sweeps)
    chance = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(F.lit(float(fraction)))
    raked = materialise(raked.select(*[F.col(a).alias(k) for a, k in zip(AXES, keys, strict=True)], F.least(chance, F.lit(1.0)).alias("_chance")))
    if raked.count() <= broadcast_cells:
        raked = F.broadcast(raked)
    return wide.join(raked, keys).filter(uniform(F.col(doc_id)) < F.col("_chance")).select(*docs.columns)
