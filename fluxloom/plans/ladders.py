"""Nearest higher value on either side of a row, from a ladder of block extremes.

A numbered series is cut into blocks of ``FAN`` samples, those into blocks of ``FAN`` blocks, and so on; a block is one row with the greatest and the
least value of each of its entries. A row looks through the entries of its own block on one side; where none is higher it climbs to the
block above, else it goes down into the nearest entry that is. Every step is one equi-join with one block per row, so no group grows with the
series, and a series of n samples takes 2 * log(n, FAN) - 1 steps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

FAN = 256


def block_ladder(series: DataFrame, *, keys: Sequence[str], value: str, steps: int, idx: str = "idx", fan: int = FAN) -> DataFrame:
    """(keys, step, block, highs, lows): entries of every block, in order; at step 0 the samples themselves."""
    keys = list(keys)
    out, level = None, series.select(*keys, F.col(idx).alias("entry"), F.col(value).alias("high"), F.col(value).alias("low"))
    for step in range(steps):
        block = F.expr(f"entry div {fan}").alias("block")
        entries = F.array_sort(F.collect_list(F.struct("entry", "high", "low")))
        rows = level.groupBy(*keys, block).agg(entries.alias("_e"))
        rows = rows.select(*keys, F.lit(step).alias("step"), "block", F.transform("_e", lambda e: e["high"]).alias("highs"), F.transform("_e", lambda e: e["low"]).alias("lows"))
        out = rows if out is None else out.unionByName(rows)
        level = rows.select(*keys, F.col("block").alias("entry"), F.array_max("highs").alias("high"), F.array_min("lows").alias("low"))
    return out


def _span(a: str, b: str) -> str:
    return f"if({a} <= {b}, sequence({a}, {b}), cast(array() as array<bigint>))"


def _nearest(before: str, after: str) -> str:
    """Place of the nearest higher entry: the last of those before on the left side (-1), the first of those after on the right."""
    higher = "p -> highs[int(p)] > v"
    return f"if(side < 0, array_max(filter({before}, {higher})), array_min(filter({after}, {higher})))"


def _least(a: str, b: str) -> str:
    """The least of ``low`` and the entries a to b, if any; least() passes over nulls."""
    return f"least(low, if({a} <= {b}, array_min(slice(lows, int({a}) + 1, int({b}) - int({a}) + 1)), null))"


def lowest_before_higher(points: DataFrame, ladder: DataFrame, *, keys: Sequence[str], steps: int, idx: str = "idx", fan: int = FAN) -> DataFrame:
    """For every point (keys, idx, v): the least values between it and the nearest strictly higher sample on either side, or the end of the
    series, as ``low_before`` and ``low_after``; null where nothing lies between."""
    keys = list(keys)
    names = [*keys, idx, "v", "side"]
    both = points.select(*keys, idx, "v", F.explode(F.array(F.lit(-1), F.lit(1))).alias("side"))
    going = both.select(*names, F.expr(f"{idx} div {fan}").alias("block"), F.expr(f"{idx} % {fan}").alias("at"), F.lit(None).cast("double").alias("low"))

    def at_step(rows: DataFrame, step: int) -> DataFrame:
        return rows.join(ladder.where(F.col("step") == step).drop("step"), [*keys, "block"])

    last = "size(highs) - 1L"
    done = None
    entered: list[DataFrame | None] = [None] * steps  # by step: rows that go down into a block of it

    def end(rows: DataFrame) -> None:
        nonlocal done
        part = rows.select(*names, "low")
        done = part if done is None else done.unionByName(part)

    for step in range(steps):
        there = at_step(going, step).withColumn("q", F.expr(_nearest(_span("0L", "at - 1"), _span("at + 1", last))))
        there = there.withColumn("low", F.expr(f"if(side < 0, {_least('coalesce(q + 1, 0L)', 'at - 1')}, {_least('at + 1', f'coalesce(q - 1, {last})')})"))
        found, rest = there.where("q is not null"), there.where("q is null")
        if step == 0:
            end(found)
        else:
            entered[step - 1] = found.select(*names, F.expr(f"block * {fan} + q").alias("block"), "low")
        going = rest.select(*names, F.expr(f"block div {fan}").alias("block"), F.expr(f"block % {fan}").alias("at"), "low")
    end(going)  # nothing higher on this side of the series
    down = None
    for step in range(steps - 2, -1, -1):
        here = entered[step] if down is None else entered[step].unionByName(down)
        there = at_step(here, step).withColumn("q", F.expr(_nearest(f"sequence(0L, {last})", f"sequence(0L, {last})")))
        there = there.withColumn("low", F.expr(f"if(side < 0, {_least('q + 1', last)}, {_least('0L', 'q - 1')})"))
        if step == 0:
            end(there)
        else:
            down = there.select(*names, F.expr(f"block * {fan} + q").alias("block"), "low")
    return done.groupBy(*keys, idx).agg(F.max(F.expr("if(side < 0, low, null)")).alias("low_before"), F.max(F.expr("if(side > 0, low, null)")).alias("low_after"))
