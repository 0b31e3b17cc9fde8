"""End-to-end compositions: training tables, forecasting tables, sequences."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyratory.constants import PHASES, SHIFT, WINDOW_SECONDS
from gyratory.functions.ordered import checked_broadcast
from gyratory.functions.scalars import add_time_features, encode_by_first_appearance, encode_congestion
from gyratory.operators import fusion, labels, prep, sequences, windows
from gyratory.session import materialise


def training_dataset(
    events: DataFrame, vehicles: DataFrame, journeys: DataFrame, ratings: DataFrame, w: float = WINDOW_SECONDS,
    aggregation: str = "mode", lag_keys: list[str] = windows.VIDEO,
) -> DataFrame:
    """Zone events, journeys and labels of any number of videos -> one labelled wide row per window.

    The fused features are written once: the label join needs their bounds and then all their columns.
    """
    per_camera = windows.extract_features(events, vehicles, journeys, w)
    per_camera = windows.add_rolling(windows.add_lags(per_camera, keys=lag_keys), keys=lag_keys)
    return labels.attach_labels(materialise(fusion.fuse(per_camera)), ratings, int(w), aggregation)


@dataclass
class ForecastingTables:
    training: DataFrame
    validation: DataFrame
    testing: DataFrame
    features: list[str]


def forecasting_dataset(
    train: DataFrame, test: DataFrame, template: DataFrame, features: DataFrame | None = None, periods: int = SHIFT,
    order: str = "label_id", window: int | None = None,
) -> ForecastingTables:
    """Label records, test segments and a submission template -> shifted training, validation and test rows.

    `features` are window features joined by video timestamp; every window of a video then gives a row, or only the one with the index `window`.
    Rows are joined, shifted and counted with the number of their window alone, which gets its features at the end.
    """
    numbered = keys = None
    if features is not None:
        side = features if window is None else features.filter(F.col("window_idx") == window)
        numbered = materialise(side.withColumn("_window", F.monotonically_increasing_id()))
        keys = checked_broadcast(numbered.select(*[c for c in numbered.columns if c in ("video_ts", "window_idx", "_window")]))
        train, test = (labels.join_features_on_timestamp(df, keys) for df in (train, test))
    train, test = (add_time_features(df) for df in (train, test))
    train, test = encode_by_first_appearance(train, test, "signaling", order)
    long = prep.to_long(train.unionByName(test, allowMissingColumns=True))
    full = materialise(prep.append_template(long, template))
    series = ["time_segment_id", *[c for c in ("window_idx",) if c in full.columns], "ID"]
    if numbered is None:
        names = prep.select_features(full)
        shifted = materialise(prep.shift_features(full, names, periods, series))
        training, validation, testing = prep.split_by_phase(shifted)
        return ForecastingTables(training, validation, prep.fill_with_train_median(testing, training, names), names)
    numbered = checked_broadcast(numbered.drop(*[c for c in numbered.columns if c in full.columns and c != "_window"]))
    own, wide = prep.select_features(full.drop("_window")), prep.used_features(full, numbered, "_window")
    shifted = materialise(prep.shift_windows(full, own, numbered, wide, "_window", periods, series))
    known = prep.medians_of_windows(shifted.filter(F.col("cycle_phase") == PHASES[0]), own, numbered, wide, "_window")
    names = sorted([*own, *wide])
    rows = shifted.join(numbered.select("_window", *wide), "_window", "left").drop("_window")
    training, validation, testing = prep.split_by_phase(rows.select("ID", "cycle_phase", "congestion_rating", *prep.SERIES, *names))
    return ForecastingTables(training, validation, prep.filled(testing, known), names)


def sequence_dataset(
    labelled: DataFrame, features: list[str], size: int = 6, stride: int = 1, min_valid: int = 3, test: float = 0.2
) -> DataFrame:
    """Labelled windows -> sequences with encoded targets, split in time (column `part`)."""
    made = materialise(sequences.sequences(labelled, features, size=size, stride=stride, min_valid=min_valid))
    coded = made.withColumn("y_encoded", F.transform("y", lambda v: encode_congestion(v)))
    return sequences.temporal_split(coded, test)
