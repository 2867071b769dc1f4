"""Observation grids: regular, data-driven, before events, and their union."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from fluxloom.functions.timing import plus_hours
from fluxloom.plans.ordering import running_index


def coverage_bounds(series: DataFrame, *, keys: Sequence[str] = (), ts: str = "timestamp") -> DataFrame:
    """Midnight of the first day and the last time per key."""
    return series.groupBy(*keys).agg(F.min(ts).cast("date").cast("timestamp_ntz").alias("start"), F.max(ts).alias("end"))


def regular_grid(bounds: DataFrame, *, keys: Sequence[str] = (), hours: int, ts: str = "timestamp") -> DataFrame:
    """Every ``hours`` from start to end, both ends in, for each key."""
    steps = F.sequence("start", "end", F.expr(f"INTERVAL '{hours}' HOUR"))
    return bounds.select(*keys, F.explode(steps).alias(ts))


def sampled_grid(series: DataFrame, *, keys: Sequence[str] = (), every: int, ts: str = "timestamp") -> DataFrame:
    """Times of every ``every``-th row of the series, the first row included."""
    indexed = running_index(series.select(*keys, ts), [ts], keys, name="_i")
    return indexed.where(F.pmod("_i", F.lit(every)) == 0).select(*keys, ts)


def before_events(
    events: DataFrame, bounds: DataFrame, *, keys: Sequence[str] = (), leads: Sequence[int] = (12, 24, 48), ts: str = "timestamp"
) -> DataFrame:
    """Times ``leads`` hours before each event start that fall inside the coverage."""
    early = events.select(*keys, F.explode(F.array(*[plus_hours("start_time", -h) for h in leads])).alias(ts))
    limits = F.broadcast(bounds) if not keys else bounds  # one row without keys
    joined = early.join(limits, list(keys)) if keys else early.join(limits, F.lit(True))
    return joined.where(F.col(ts).between(F.col("start"), F.col("end"))).select(*keys, ts)


def union_grids(*grids: DataFrame) -> DataFrame:
    """Distinct union."""
    out = grids[0]
    for g in grids[1:]:
        out = out.unionByName(g)
    return out.distinct()


def training_grid(
    series: DataFrame, events: DataFrame, *, keys: Sequence[str] = (), hours: int = 12, leads: Sequence[int] = (12, 24, 48), ts: str = "timestamp"
) -> DataFrame:
    """Regular grid over the coverage plus the times before events."""
    bounds = coverage_bounds(series, keys=keys, ts=ts)
    return union_grids(regular_grid(bounds, keys=keys, hours=hours, ts=ts), before_events(events, bounds, keys=keys, leads=leads, ts=ts))
