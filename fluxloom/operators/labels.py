"""Forward labels: strongest class in a horizon, and censored time to the next event."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from fluxloom.functions.classes import LABEL_RANK, rank_name, rank_of
from fluxloom.functions.timing import from_micros, hours_between, hours_to_us
from fluxloom.operators.features import TS, in_window, named, trailing
from fluxloom.plans.ranges import Part

CLASSES = ("B", "C", "M", "X")


def class_labels(
    grid: DataFrame, events: DataFrame, *, keys: Sequence[str] = (), windows: Sequence[int] = (24, 48), classes: Sequence[str] = CLASSES, ts: str = TS
) -> DataFrame:
    """Per window [t, t + w) on start time: strongest class, count, top magnitude, classes seen.

    B events count but never name the label. Classes are listed by first appearance: only the
    first time per class is carried, so nothing is collected.
    """
    spec = [(f"{w}h", 0, hours_to_us(w) - 1) for w in windows]
    parts = [
        Part("n", F.lit(1).cast("bigint"), "sum"),
        Part("top", rank_of("class_category", LABEL_RANK), "max"),
        Part("mag", F.col("class_magnitude"), "max"),
        *[Part(f"at_{c}", F.when(F.col("class_category") == c, F.col("us")), "min") for c in classes],
    ]
    finals = []
    for w, _, _ in spec:
        first = {c: f"min({in_window(w, f'at_{c}')})" for c in classes}
        seen = ", ".join(f"CASE WHEN {t} IS NOT NULL THEN named_struct('t', {t}, 'c', '{c}') END" for c, t in first.items())
        finals += [
            rank_name(F.expr(f"coalesce(max({in_window(w, 'top')}), 0)"), LABEL_RANK).alias(f"label_{w}"),
            named(f"coalesce(sum({in_window(w, 'n')}), 0L)", f"num_flares_{w}"),
            named(f"coalesce(max({in_window(w, 'mag')}), 0e0)", f"max_magnitude_{w}"),
            named(f"array_join(transform(array_sort(array_compact(array({seen}))), e -> e.c), ',')", f"flare_classes_{w}"),
        ]
    return trailing(grid, events, keys=keys, windows=spec, parts=parts, finals=finals, ts=ts, series_ts="start_time")


def next_event(grid: DataFrame, events: DataFrame, *, keys: Sequence[str] = (), horizon_hours: int = 168, ts: str = TS) -> DataFrame:
    """Start of the first event strictly after t and at most the horizon away, or null."""
    return trailing(
        grid,
        events,
        keys=keys,
        windows=[("w", -1, hours_to_us(horizon_hours))],
        parts=[Part("at", F.col("us"), "min")],
        finals=[from_micros(F.min("at")).alias("event_time")],
        ts=ts,
        series_ts="start_time",
    )


def survival_labels(
    grid: DataFrame, events: DataFrame, *, keys: Sequence[str] = (), target: str = "X", max_hours: int = 168, ts: str = TS
) -> DataFrame:
    """Hours to the next target event (event 1), or the horizon (event 0)."""
    found = next_event(grid, events.where(F.col("class_category") == target), keys=keys, horizon_hours=max_hours, ts=ts)
    waited = hours_between(F.col("event_time"), F.col(ts))
    return found.select(
        *keys,
        ts,
        F.coalesce(waited, F.lit(float(max_hours))).alias("duration"),
        F.col("event_time").isNotNull().cast("int").alias("event"),
        "event_time",
    )


def classification_set(features: DataFrame, labels: DataFrame, *, keys: Sequence[str] = (), label: str, ts: str = TS) -> DataFrame:
    """Features with their labels; rows without a label are dropped."""
    return features.join(labels, [*keys, ts], "left").where(F.col(label).isNotNull())


def survival_set(covariates: DataFrame, labels: DataFrame, *, keys: Sequence[str] = (), ts: str = TS) -> DataFrame:
    return covariates.join(labels, [*keys, ts])
