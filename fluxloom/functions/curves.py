"""Survival curves held as arrays: interpolation, bucket probabilities, sanity figures."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

# Bucket boundaries in hours.
BUCKET_HOURS = (0, 6, 12, 24, 48, 72, 96, 120, 168)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once per row."""
    return F.get(F.transform(F.array(value), body), 0)


def _interpolated(points: Column, h: Column) -> Column:
    below = F.try_element_at(F.filter(points, lambda p: p["t"] <= h), F.lit(-1))
    above = F.get(F.filter(points, lambda p: p["t"] > h), 0)
    ends = F.struct(below.alias("a"), above.alias("b"))
    return _let(
        ends,
        lambda e: F.when(e["a"].isNull(), e["b"]["s"])
        .when(e["b"].isNull(), e["a"]["s"])
        .otherwise(e["a"]["s"] + (e["b"]["s"] - e["a"]["s"]) * (h - e["a"]["t"]) / (e["b"]["t"] - e["a"]["t"])),
    )


def curve_at(curve: Column, hour: Column | float) -> Column:
    """Linear interpolation in an array of structs (t, s); flat outside its range."""
    h = hour if isinstance(hour, Column) else F.lit(float(hour))
    return _let(F.array_sort(curve), lambda points: _interpolated(points, h))


def beside_hours(points: Sequence, times: Sequence[float], hours: Sequence[float]) -> list:
    """The points, of those at ``times``, that interpolation at ``hours`` reads: the last one up to each hour and the first one after it."""
    order = sorted(range(len(times)), key=lambda i: times[i])
    kept = set()
    for h in hours:
        kept |= set([i for i in order if times[i] <= h][-1:] + [i for i in order if times[i] > h][:1])
    return [points[i] for i in order if i in kept]


def bucket_labels(bounds: Sequence[int] = BUCKET_HOURS) -> list[str]:
    return [f"{a}h-{b}h" for a, b in zip(bounds, bounds[1:])]


def bucket_probabilities(curve: Column, bounds: Sequence[int] = BUCKET_HOURS) -> Column:
    """Map bucket -> S(start) - S(end), clamped to 0..1; an empty curve gives zeros."""
    hours = F.array(*[F.lit(float(b)) for b in bounds])
    at = _let(F.array_sort(curve), lambda points: F.transform(hours, lambda h: _interpolated(points, h)))
    n = len(bounds) - 1
    drops = _let(
        at,
        lambda s: F.zip_with(
            F.slice(s, 1, n),
            F.slice(s, 2, n),
            lambda a, b: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(a - b, F.lit(0.0)))),
        ),
    )
    return F.map_from_arrays(F.array(*[F.lit(x) for x in bucket_labels(bounds)]), drops)


def bucket_start(label: Column | str) -> Column:
    """Sort key of a bucket label; unreadable labels sort as 0."""
    c = F.col(label) if isinstance(label, str) else label
    return F.coalesce(F.regexp_extract(c, r"^\s*(\d+)h?(-|$)", 1).try_cast("int"), F.lit(0))


def curve_checks(values: Column) -> dict[str, Column]:
    """Range, largest one-step drop and smallest value before the last point."""
    n = F.size(values)
    head = F.slice(values, F.lit(1), F.greatest(n - 1, F.lit(1)))
    tail = F.slice(values, F.lit(2), F.greatest(n - 1, F.lit(0)))
    steps = F.filter(F.zip_with(head, tail, lambda a, b: a - b), lambda d: d.isNotNull())
    return {
        "curve_range": F.array_max(values) - F.array_min(values),
        "max_drop": F.coalesce(F.array_max(steps), F.lit(0.0)),
        "min_before_end": F.array_min(head),
    }
