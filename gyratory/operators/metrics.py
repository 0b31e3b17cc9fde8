"""Class balance, evaluation and prediction tables.

Metrics are computed from the confusion counts (classes squared rows), so the prediction rows are read
once and reduced before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyratory.constants import CONGESTION, MISSING
from gyratory.functions import ordered
from gyratory.functions.scalars import decode_congestion, safe_ratio

CLASSES = list(range(len(CONGESTION)))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """H1: n / (k * n_c) and the share of every class."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy()  # one row per class
    total, k = F.sum("n").over(whole), F.count(F.lit(1)).over(whole)
    return counts.withColumns({"weight": total / (k * F.col("n")), "percent": F.col("n") * 100.0 / total})


def confusion_matrix(
    df: DataFrame, keys: Sequence[str] = (), true: str = "y_true", pred: str = "y_pred", classes: Sequence[int] = CLASSES
) -> DataFrame:
    """H2: counts of every (true, predicted) pair, zeros included."""
    keys = list(keys)
    cells = [
        F.count_if((F.col(true) == a) & (F.col(pred) == b)).alias(f"{a}_{b}") for a in classes for b in classes
    ]
    wide = df.groupBy(*keys).agg(*cells)
    rows = F.array(
        *[
            F.struct(F.lit(a).alias(true), F.lit(b).alias(pred), F.col(f"{a}_{b}").alias("n"))
            for a in classes for b in classes
        ]
    )
    return wide.select(*keys, F.explode(rows).alias("_c")).select(*keys, "_c.*")


def per_class_prf(confusion: DataFrame, keys: Sequence[str] = (), true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """H3: precision, recall, F1 and support of every class; 0 where a denominator is empty."""
    keys = list(keys)
    sides = F.array(
        F.struct(F.col(true).alias("label"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col(pred).alias("label"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("predicted")),
    )
    hit = F.when(F.col(true) == F.col(pred), F.col("n")).otherwise(0)
    long = confusion.withColumn("_hit", hit).select(*keys, "_hit", F.explode(sides).alias("_s"))
    sums = long.select(*keys, "_hit", "_s.*").groupBy(*keys, "label").agg(
        (F.sum("_hit") / 2).cast("bigint").alias("_tp"), F.sum("actual").alias("support"),
        F.sum("predicted").alias("_predicted"),
    )
    precision = safe_ratio(F.col("_tp"), F.col("_predicted"), 0.0)
    recall = safe_ratio(F.col("_tp"), F.col("support"), 0.0)
    return (
        sums.withColumns({"precision": precision, "recall": recall})
        .withColumn("f1", safe_ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0))
        .select(*keys, "label", "precision", "recall", "f1", "support", F.col("_tp").alias("hits"), F.col("_predicted").alias("predicted"))
    )


def summary_scores(prf: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """H4: macro F1, weighted F1, accuracy and balanced accuracy; classes never seen or predicted do not count."""
    n = F.sum("support")
    scored = prf.filter((F.col("support") > 0) | (F.col("predicted") > 0))
    return scored.groupBy(*keys).agg(
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"),
        (F.sum("hits") / n).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
    )


def competition_score(df: DataFrame, camera: str = "camera_id", f1_weight: float = 0.7) -> DataFrame:
    """H5: weighted macro F1 and accuracy, taken per camera and then averaged."""
    scores = summary_scores(per_class_prf(confusion_matrix(df, [camera]), [camera]), [camera])
    both = scores.agg(F.avg("macro_f1").alias("avg_f1"), F.avg("accuracy").alias("avg_accuracy"))
    return both.withColumn("score", f1_weight * F.col("avg_f1") + (1 - f1_weight) * F.col("avg_accuracy"))


def masked_accuracy(df: DataFrame, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """H6: accuracy per direction over known labels, and the mean of the directions that have any."""
    per = df.filter(F.col(true) != MISSING).groupBy("direction").agg(
        F.avg((F.col(true) == F.col(pred)).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("valid")
    )
    mean = per.agg(F.lit("(mean)").alias("direction"), F.avg("accuracy").alias("accuracy"), F.sum("valid").alias("valid"))
    return per.unionByName(mean)


def masked_cross_entropy(df: DataFrame, true: str = "y_true", probs: str = "probs", eps: float = 1e-7) -> DataFrame:
    """H7: mean -ln p of the true class over known labels, p clipped; 0 when nothing is known.

    `loss_unclipped` is the older form: no clipping, eps added to the count.
    """
    known = F.col(true) != MISSING
    p = F.when(known, F.col(probs)[F.greatest(F.col(true), F.lit(0))])
    # greatest() skips nulls, so the clipping must not touch unknown labels
    clipped = F.when(known, F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps)))
    n = F.count_if(known)
    return df.agg(
        n.alias("n_valid"), F.coalesce(F.sum(-F.ln(clipped)), F.lit(0.0)).alias("loss_sum"),
        (F.coalesce(F.sum(-F.ln(p)), F.lit(0.0)) / (n + eps)).alias("loss_unclipped"),
    ).withColumn("loss", safe_ratio(F.col("loss_sum"), F.col("n_valid"), 0.0))


def argmax(probs: Column) -> Column:
    """Index of the first largest entry."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def argmax_predictions(df: DataFrame, probs: str = "probs") -> DataFrame:
    """H8: predicted class, its label text and its probability."""
    return df.withColumn("y_pred", argmax(F.col(probs))).withColumns(
        {"prediction": decode_congestion("y_pred"), "confidence": F.array_max(probs)}
    )


def prediction_table(df: DataFrame, directions: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """H8 wide: `{direction}_prediction` and `{direction}_confidence` per sequence."""
    rows = argmax_predictions(df)
    return rows.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("direction") == d, F.col(c))).alias(f"{d}_{c}")
            for d in directions for c in ("prediction", "confidence")
        ]
    )


def explode_probabilities(df: DataFrame, probs: str = "probs") -> DataFrame:
    """H9: one column per class."""
    names = [c.replace(" ", "_") for c in CONGESTION]
    return df.withColumns({f"prob_{n}": F.col(probs)[i] for i, n in enumerate(names)}).drop(probs)


def _times(weight: float):
    return lambda p: p * F.lit(float(weight))


def soft_vote(models: Sequence[DataFrame], weights: Sequence[float] | None = None, key: str = "sequence_id") -> DataFrame:
    """(weighted) mean of the models' probabilities, then argmax."""
    weights = list(weights or [1.0] * len(models))
    total = float(sum(weights))
    out = models[0].select(key, F.col("probs").alias("_p0"))
    for i, model in enumerate(models[1:], 1):
        out = out.join(model.select(key, F.col("probs").alias(f"_p{i}")), key)
    mixed = F.transform(F.col("_p0"), _times(weights[0]))
    for i in range(1, len(models)):
        weighted = F.transform(F.col(f"_p{i}"), _times(weights[i]))
        mixed = F.zip_with(mixed, weighted, lambda a, b: a + b)
    out = out.withColumn("probs", F.transform(mixed, lambda p: p / F.lit(total)))
    return out.select(key, "probs", argmax(F.col("probs")).alias("y_pred"))


def tune_thresholds(df: DataFrame, start: float = 0.1, step: float = 0.05, count: int = 16) -> DataFrame:
    """Per class the threshold with the best one-against-rest F1; the smallest wins ties.

    Rows are counted by the highest threshold they pass, then summed downwards over the grid: the rows are
    never repeated per threshold.
    """
    grid = [start + step * i for i in range(count)]
    passed = F.lit(0)
    for t in grid:
        passed = passed + (F.col("p") >= F.lit(t)).cast("int")
    cells = (
        df.select("y_true", F.posexplode("probs").alias("label", "p"))
        .groupBy("label", passed.alias("_passed"))
        .agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("y_true") == F.col("label")).alias("_pos"))
    )
    spread = cells.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).groupBy("label", "_i").agg(
        F.sum(F.when(F.col("_passed") > F.col("_i"), F.col("_n")).otherwise(0)).alias("_predicted"),
        F.sum(F.when(F.col("_passed") > F.col("_i"), F.col("_pos")).otherwise(0)).alias("_tp"),
        F.sum("_pos").alias("_actual"),
    )
    f1 = safe_ratio(2.0 * F.col("_tp"), F.col("_predicted") + F.col("_actual"), 0.0)
    best = Window.partitionBy("label").orderBy(F.desc("f1"), "_i")
    threshold = F.element_at(F.array(*[F.lit(t) for t in grid]), F.col("_i") + 1)
    return (
        spread.withColumn("f1", f1).withColumn("_r", F.row_number().over(best))
        .filter((F.col("_r") == 1) & (F.col("f1") > 0))
        .select("label", threshold.alias("threshold"), "f1")
    )


def build_submission(predictions: DataFrame, template: DataFrame, sort: bool = False) -> DataFrame:
    """ID, Target and Target_Accuracy for every ID of the template (which carries its row order)."""
    out = template.select("ID", "row_order").join(predictions.select("ID", "Target"), "ID", "left").select(
        "row_order", "ID", "Target", F.col("Target").alias("Target_Accuracy")
    )
    return out.orderBy("row_order") if sort else out


def validate_submission(submission: DataFrame, template: DataFrame) -> DataFrame:
    """Row counts, missing and extra IDs, rows out of template order, missing targets."""
    a = submission.select("ID", F.col("row_order").alias("_a"), "Target", F.lit(1).alias("_in_a"))
    b = template.select("ID", F.col("row_order").alias("_b"), F.lit(1).alias("_in_b"))
    both = a.join(b, "ID", "full_outer")
    return both.agg(
        F.count("_in_a").alias("rows"), F.count("_in_b").alias("expected_rows"),
        F.count_if(F.col("_in_a").isNull()).alias("missing_ids"), F.count_if(F.col("_in_b").isNull()).alias("extra_ids"),
        F.count_if(F.col("_a") != F.col("_b")).alias("out_of_order"),
        F.count_if(F.col("_in_a").isNotNull() & F.col("Target").isNull()).alias("empty_targets"),
    )


def prediction_distribution(df: DataFrame, label: str = "Target", classes: Sequence[str] = CONGESTION) -> DataFrame:
    """Count and share of every label, zeros included."""
    counts = df.agg(F.count(label).alias("_all"), *[F.count_if(F.col(label) == c).alias(c) for c in classes])
    share = safe_ratio(F.col("n") * 100.0, F.col("_all"), 0.0)
    return counts.unpivot(["_all"], list(classes), "label", "n").select("label", "n", share.alias("percent"))


def undersample(df: DataFrame, label: str, key: str, seed: int = 0) -> DataFrame:
    """As many rows of every class as the rarest one has, chosen by a hash of the key."""
    rows = df.filter(F.col(label).isNotNull())
    smallest = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("n")).scalar()
    mixed = rows.withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))))
    ranked = ordered.position(mixed, [label], ["_h", key], "_r")
    return ranked.filter(F.col("_r") <= smallest).drop("_h", "_r")
