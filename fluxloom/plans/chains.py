"""Greedy spacing: keep the first event, then always the next one more than a gap later.

The rule is sequential, yet a pause longer than the gap always restarts it, so the series
falls apart into sessions. Short sessions are folded in one expression. Long ones (a busy
series may never pause) are solved by pointer doubling: every event points at the event
that would follow it, and reachability from the session start is found in about
log2(kept events) joins, whatever the session's size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fluxloom.plans.ordering import running_sums, with_previous
from fluxloom.plans.ranges import Part, range_aggregate
from fluxloom.session import durable


def _fold_anchors(times: Column, gap_us: int) -> Column:
    """Anchors of one sorted array of times."""
    start = F.slice(times, 1, 1)
    return F.aggregate(
        times,
        start,
        lambda kept, t: F.when(t > F.element_at(kept, -1) + gap_us, F.concat(kept, F.array(t))).otherwise(kept),
    )


def _doubled_anchors(times: DataFrame, keys: Sequence[str], gap_us: int) -> DataFrame:
    """Anchors of long sessions; ``times`` has keys, session and unique ``us``."""
    ident = [*keys, "session"]
    ranges = times.select(*ident, F.col("us").alias("at"), (F.col("us") + gap_us + 1).alias("lo"), (F.col("us") + 2 * gap_us).alias("hi"))
    jump = range_aggregate(
        ranges,
        times,
        keys=ident,
        group=[*ident, "at"],
        parts=[Part("nxt", F.col("us"), "min")],
        finals=[F.min("nxt").alias("nxt")],
        base=max(gap_us // 8, 1),
        longest=gap_us,
        keep_empty=False,
    )
    jump = durable(jump)
    reached = durable(times.groupBy(*ident).agg(F.min("us").alias("us")))
    while True:
        step = reached.join(jump.withColumnRenamed("at", "us"), [*ident, "us"]).select(*ident, F.col("nxt").alias("us"))
        fresh = durable(step.join(reached, [*ident, "us"], "left_anti").distinct())
        if fresh.isEmpty():
            return reached
        reached = durable(reached.unionByName(fresh))
        far = jump.select(*ident, F.col("at").alias("nxt"), F.col("nxt").alias("far"))
        jump = durable(jump.join(far, [*ident, "nxt"]).select(*ident, "at", F.col("far").alias("nxt")))


def spaced_anchors(events: DataFrame, *, keys: Sequence[str] = (), us: str = "us", gap_us: int, fold_limit: int = 256) -> DataFrame:
    """Times (keys, us) that the greedy spacing rule keeps."""
    keys = list(keys)
    times = events.where(F.col(us).isNotNull()).select(*keys, F.col(us).alias("us")).distinct()
    breaks = with_previous(times, "us", keys).withColumn(
        "_opens", (F.col("prev").isNull() | (F.col("us") - F.col("prev") > gap_us)).cast("bigint")
    )
    sessions = durable(running_sums(breaks, ["us"], {"session": F.col("_opens")}, keys).select(*keys, "us", "session"))
    sizes = sessions.groupBy(*keys, "session").agg(F.count("*").alias("_n"))
    long_ones = durable(sizes.where(F.col("_n") > fold_limit).select(*keys, "session"))
    ident = [*keys, "session"]
    short = (
        sessions.join(long_ones, ident, "left_anti")
        .groupBy(*ident)
        .agg(F.array_sort(F.collect_list("us")).alias("_times"))
        .select(*keys, F.explode(_fold_anchors(F.col("_times"), gap_us)).alias("us"))
    )
    if long_ones.isEmpty():
        return short
    busy = durable(sessions.join(long_ones, ident, "left_semi"))
    return short.unionByName(_doubled_anchors(busy, keys, gap_us).select(*keys, "us"))


def anchor_groups(
    events: DataFrame, *, keys: Sequence[str] = (), us: str = "us", gap_us: int, fold_limit: int = 256
) -> DataFrame:
    """Events with ``anchor_group``: the running number of the anchor each one falls under."""
    keys = list(keys)
    anchors = spaced_anchors(events, keys=keys, us=us, gap_us=gap_us, fold_limit=fold_limit)
    times = events.where(F.col(us).isNotNull()).select(*keys, F.col(us).alias("us")).distinct()
    marked = times.join(anchors.withColumn("_a", F.lit(1).cast("bigint")), [*keys, "us"], "left")
    grouped = running_sums(marked, ["us"], {"anchor_group": F.coalesce("_a", F.lit(0).cast("bigint"))}, keys).drop("_a")
    return events.join(grouped.withColumnRenamed("us", us), [*keys, us])
