"""Event detection in a flux series and event de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from fluxloom.functions.classes import CLASS_FLOORS, class_label, class_letter, class_magnitude
from fluxloom.functions.timing import MINUTE_US, from_micros, hours_to_us, micros
from fluxloom.operators.features import TS
from fluxloom.plans.chains import anchor_groups, spaced_anchors
from fluxloom.plans.ladders import FAN, block_ladder, lowest_before_higher
from fluxloom.plans.ordering import beside, carried_values, numbered, range_chunks, running_index
from fluxloom.plans.ranges import Part, range_aggregate, range_join
from fluxloom.session import Cuts, durable, scratch, staging_path
from fluxloom.sources.store import CommittedTables
from fluxloom.sources.tables import upsert

# Spacing of peaks in samples, reach of start and end in samples, share of the
# peak flux that ends an event, share of the threshold a peak must stand out by.
PEAK_SPACING = 10
REACH = 60
EDGE_SHARE = 0.1
PROMINENCE_SHARE = 0.1


# --- regions ------------------------------------------------------------------------------


def attach_region(events: DataFrame, regions: DataFrame, *, keys: Sequence[str] = (), hours: int = 6, ident: str = "event_id") -> DataFrame:
    """Number of the newest region row within ``hours`` of each event's peak, either side.

    That is the last region row up to the later end, if it is not before the earlier one: one ordered pass over both tables, however dense they are.
    """
    at, us = micros("peak_time"), micros(TS)
    asks = events.select(*keys, ident, (at - hours_to_us(hours)).alias("lo"), (at + hours_to_us(hours)).alias("us"), F.lit(1).alias("_side"))
    known = regions.select(*keys, us.alias("us"), "region_number", F.struct(us.alias("us"), "region_number").alias("r"), F.lit(0).alias("_side"))
    known = known.dropna(subset=[*keys, "us"])  # null keys belong to no series
    both = asks.unionByName(known, allowMissingColumns=True)
    last = carried_values(both, ["us", "_side", "region_number"], ["r"], keys).where("_side = 1")
    found = last.groupBy(ident).agg(F.max(F.when(F.col("_fill_r.us") >= F.col("lo"), F.col("_fill_r"))).alias("r")).select(ident, F.col("r.region_number").alias("active_region"))
    return events.drop("active_region").join(found, ident, "left")


# --- de-duplication -----------------------------------------------------------------------


def merge_close_events(events: DataFrame, *, keys: Sequence[str] = (), gap_minutes: int = 60, tie: Sequence[str] = ("event_id",)) -> DataFrame:
    """One event per anchor group: the strongest, the earliest on ties.

    An event more than the gap after the group's first peak opens a new group; magnitudes are
    compared across classes.
    """
    grouped = anchor_groups(events.withColumn("_us", micros("peak_time")), keys=keys, us="_us", gap_us=gap_minutes * MINUTE_US)
    columns = events.columns
    best = F.min_by(F.struct(*columns), F.struct(-F.col("class_magnitude"), F.col("_us"), *tie))
    return grouped.groupBy(*keys, "anchor_group").agg(best.alias("_e")).select("_e.*")


def dedupe_append(
    existing: DataFrame, batch: DataFrame, *, keys: Sequence[str] = (), tolerance_minutes: int = 30, tie: Sequence[str] = ("event_id",)
) -> DataFrame:
    """Rows of the batch to append: no stored event of the class peaks within the tolerance,
    and no kept event of the batch does (the earlier one wins)."""
    tol = tolerance_minutes * MINUTE_US
    on = [*keys, "class_category"]
    fresh = batch.withColumn("us", micros("peak_time"))
    stored = existing.select(*on, micros("peak_time").alias("us"))
    times = fresh.select(*on, "us").distinct()
    ranges = times.select(*on, F.col("us").alias("at"), (F.col("us") - tol).alias("lo"), (F.col("us") + tol).alias("hi"))
    taken = range_aggregate(
        ranges,
        stored,
        keys=on,
        group=[*on, "at"],
        parts=[Part("n", F.lit(1).cast("bigint"), "sum")],
        finals=[F.sum("n").alias("n")],
        base=tol // 4,
        longest=2 * tol,
        keep_empty=False,
    )
    free = fresh.join(taken.select(*on, F.col("at").alias("us")), [*on, "us"], "left_anti")
    kept = spaced_anchors(free, keys=on, us="us", gap_us=tol)
    columns = batch.columns
    first = F.min_by(F.struct(*columns), F.struct(*tie))
    return free.join(kept, [*on, "us"], "left_semi").groupBy(*on, "us").agg(first.alias("_e")).select("_e.*")


def append_new(existing: DataFrame, batch: DataFrame, *, on: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of the batch whose key is not stored; the first of equal keys in the batch wins."""
    rest = [c for c in batch.columns if c not in on]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    fresh = batch.join(existing.select(*on), list(on), "left_anti")
    return fresh.groupBy(*on).agg(first.alias("_v")).select(*on, "_v.*").select(*batch.columns)


# --- peaks --------------------------------------------------------------------------------


def _spaced(at: np.ndarray, height: np.ndarray, known: np.ndarray, first: int, stop: int, spacing: int) -> tuple[np.ndarray, np.ndarray]:
    """(kept, gone) of the candidates of a piece: higher ones first, dropping all closer than ``spacing``.

    Rounds of "keep what beats every undecided neighbour" give the same result as one pass by falling height. Candidates outside of
    ``first`` <= at < ``stop`` have neighbours that are not here: only those ``known`` to be kept count as kept, the others as undecided.
    """
    n = at.size
    rank = np.empty(n, dtype=np.int64)
    rank[np.lexsort((at, height))] = np.arange(n)  # equal heights: the later one goes first
    kept, gone = known.copy(), np.zeros(n, bool)
    outside = (at < first) | (at >= stop)
    # maxima are two samples apart at least, so few positions away can be too close
    near = [(k, at[k:] - at[:-k] < spacing) for k in range(1, min(spacing // 2 + 1, n))]

    def drop() -> None:
        for k, close in near:
            gone[:-k] |= close & kept[k:]
            gone[k:] |= close & kept[:-k]
        gone[kept] = False

    drop()
    while True:
        beaten = np.zeros(n, bool)
        for k, close in near:
            beaten[:-k] |= close & ~gone[k:] & (rank[k:] > rank[:-k])
            beaten[k:] |= close & ~gone[:-k] & (rank[:-k] > rank[k:])
        fresh = ~kept & ~gone & ~beaten & ~outside
        if not fresh.any():
            return kept, gone
        kept |= fresh
        drop()


def spaced_peaks(candidates: DataFrame, *, keys: Sequence[str], spacing: int = PEAK_SPACING, core: int = 65_536, cuts: Cuts) -> DataFrame:
    """Candidates (keys, idx, v, anything) that stay when higher ones drop all closer than ``spacing``.

    The series is cut by sample number into pieces of ``core`` samples, which see the candidates within ``spacing`` beside them. What hangs on a
    decision of another piece stays open and goes to the next round, in pieces cut half way between; a piece is bounded whatever
    the series looks like, and a round settles at least the highest open candidate's piece.
    """
    keys = list(keys)
    columns = [*candidates.columns, "known", "state"]
    schema = T.StructType([*candidates.schema.fields, T.StructField("known", T.BooleanType()), T.StructField("state", T.IntegerType())])
    left, done, turn = candidates.withColumn("known", F.lit(False)), None, 0
    while True:
        shift = core // 2 if turn % 2 else 0
        piece = F.sequence(F.expr(f"(idx + {shift + core - spacing}) div {core}"), F.expr(f"(idx + {shift + core + spacing}) div {core}"))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("idx")
            first = (int(pdf["piece"].iloc[0]) - 1) * core - shift  # noqa: B023
            at, known = pdf["idx"].to_numpy(np.int64), pdf["known"].to_numpy(bool)
            kept, gone = _spaced(at, pdf["v"].to_numpy(float), known, first, first + core, spacing)
            mine = (at >= first) & (at < first + core) & ~known & ~gone
            return pdf[mine].assign(state=kept[mine].astype("int32"))[columns]

        found = cuts.cut(left.withColumn("piece", F.explode(piece)).groupBy(*keys, "piece").applyInPandas(run, schema))
        settled = found.where("state = 1")
        done = settled if done is None else done.unionByName(settled)
        open_ = found.where("state = 0")
        if open_.isEmpty():
            return done.select(*candidates.columns)
        # only what was kept beside an edge can touch what is open
        edge = F.pmod(F.col("idx") + shift, F.lit(core))
        beside_edge = settled.where((edge < spacing) | (edge >= core - spacing)).withColumn("known", F.lit(True))
        left, turn = open_.unionByName(beside_edge).drop("state"), turn + 1


def local_peaks(flux: DataFrame, *, keys: Sequence[str] = (), min_class: str = "C", column: str = "flux_long", core: int = 65_536) -> DataFrame:
    """Peaks of the series: at least the class floor, ten samples apart (higher first), standing out by a tenth of the floor and one sample
    wide at half of that. Gives keys, idx, us, v.

    Candidates are runs of equal values above both neighbours. How far a peak stands out is looked up in a ladder of block extremes: the lowest
    value on the way to the nearest higher sample on either side, however far that is.
    """
    keys = list(keys)
    floor = CLASS_FLOORS[min_class]
    clean = flux.where(F.col(column).isNotNull() & ~F.isnan(column)).select(*keys, micros(TS).alias("us"), F.col(column).cast("double").alias("v"))
    with scratch() as cuts:
        rows = numbered(range_chunks(clean, [*keys, "us"]), keys)
        rows = cuts.cut(beside(rows, F.col("v"), keys, "before", after=False))
        top = rows.agg(F.max("idx")).first()[0] or 0
        steps = 1
        while FAN**steps <= top:
            steps += 1
        begins = rows.where("before is null or before <> v")
        runs = beside(begins, F.struct("idx", "v"), keys, "next")
        candidates = runs.where(f"before < v and next.v < v and v >= {floor!r}").select(
            *keys, F.expr("(idx + next.idx - 1) div 2").alias("idx"), "v", (F.col("next.idx") - F.col("idx")).alias("samples"), "before", F.col("next.v").alias("after")
        )
        peaks = spaced_peaks(candidates, keys=keys, core=core, cuts=cuts)
        ladder = cuts.cut(block_ladder(rows, keys=keys, value="v", steps=steps))
        low = lowest_before_higher(peaks.select(*keys, "idx", "v"), ladder, keys=keys, steps=steps)
        stands = peaks.join(low, [*keys, "idx"]).withColumn("by", F.expr("v - greatest(low_before, low_after)")).withColumn("level", F.expr("v - by / 2"))
        # one sample away the level is crossed, unless that sample is above it
        wide = "samples > 1 or before > level or after > level or (1 - (level - before) / (v - before)) + (1 - (level - after) / (v - after)) >= 1"
        good = stands.where(f"by >= {floor * PROMINENCE_SHARE!r} and ({wide})").select(*keys, "idx", "v")
        return durable(good.join(rows.select(*keys, "idx", "us"), [*keys, "idx"]).select(*keys, "idx", "us", "v"))


def event_edges(flux: DataFrame, peaks: DataFrame, *, keys: Sequence[str] = (), column: str = "flux_long") -> DataFrame:
    """Start and end time of each peak (keys, idx): where the flux is under a tenth of it.

    Start: the latest such sample of the 60 before the peak, else the oldest of them. End: the
    first such sample after it among the next 60 (the series' last sample is out of reach),
    else the last one in reach. The reach is found by sample number, so it is two range
    aggregations over numbers instead of times.
    """
    keys = list(keys)
    clean = flux.where(F.col(column).isNotNull() & ~F.isnan(column)).select(*keys, TS, F.col(column).alias("v"))
    rows = running_index(clean, [TS], keys).select(*keys, "idx", micros(TS).alias("at"), "v")
    sizes = rows.groupBy(*keys).agg((F.max("idx") + 1).alias("series_rows"))
    sized = peaks.join(sizes, keys) if keys else peaks.join(F.broadcast(sizes), F.lit(True))
    spans = sized.select(
        *keys,
        F.col("idx").alias("peak_idx"),
        F.col("v").alias("peak"),
        F.expr(
            f"""inline(array(
                named_struct('side', 'a', 'lo', greatest(0, idx - {REACH}), 'hi', idx),
                named_struct('side', 'b', 'lo', idx, 'hi',
                             greatest(idx, idx + least({REACH}, series_rows - idx - 1) - 1))))"""
        ),
    )
    # at most 61 samples a side: the pairs are bounded by the reach, not by the data
    near = range_join(spans, rows.withColumnRenamed("idx", "us"), keys=keys, width=REACH)
    low = f"v < peak * {EDGE_SHARE}"
    return near.groupBy(*keys, F.col("peak_idx").alias("idx")).agg(
        from_micros(F.expr(f"coalesce(max(case when side = 'a' and {low} then at end), min(case when side = 'a' then at end))")).alias("start_time"),
        from_micros(F.expr(f"coalesce(min(case when side = 'b' and {low} then at end), max(case when side = 'b' then at end))")).alias("end_time"),
    )


def detect_events(flux: DataFrame, regions: DataFrame | None = None, *, keys: Sequence[str] = (), min_class: str = "C", column: str = "flux_long") -> DataFrame:
    """Detected events: peaks, class, start and end, nearby region, close ones merged."""
    keys = list(keys)
    peaks = local_peaks(flux, keys=keys, min_class=min_class, column=column)
    edges = event_edges(flux, peaks, keys=keys, column=column)
    events = peaks.join(edges, [*keys, "idx"]).select(
        *keys,
        F.col("idx").alias("event_no"),
        "start_time",
        from_micros("us").alias("peak_time"),
        "end_time",
        class_label("v").alias("flare_class"),
        class_letter("v").alias("class_category"),
        class_magnitude("v").alias("class_magnitude"),
        F.lit("auto_detected").alias("source"),
        F.lit(False).alias("verified"),
    )
    events = durable(events)  # merging and what follows read them several times; the series is gone through once
    merged = merge_close_events(events, keys=keys, tie=["event_no"])
    if regions is None:
        return merged.withColumn("active_region", F.lit(None).cast("int"))
    ident = merged.withColumn("_id", F.struct(*keys, "event_no"))
    return attach_region(ident, regions, keys=keys, ident="_id").drop("_id")


def _new_events(flux: DataFrame, stored: DataFrame) -> DataFrame:
    return dedupe_append(stored, detect_events(flux, keys=[]), tie=["event_no"])


def _totals(flux: DataFrame, fresh: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """One row: rows, new events and days without any sample."""
    days = flux.sparkSession.range(1).select(
        F.explode(F.sequence(F.to_date(lo), F.to_date(hi), F.expr("interval 1 day"))).alias("day")
    )
    missing = days.join(flux.select(F.to_date(TS).alias("day")).distinct(), "day", "left_anti")
    one = F.lit(True)
    return (
        flux.agg(F.count("*").alias("rows"))
        .join(fresh.agg(F.count("*").alias("events")), one)
        .join(missing.agg(F.count("*").alias("missing_days")), one)
    )


def _span(start: str, end: str) -> tuple[Column, Column]:
    return F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")


def backfill(archive: DataFrame, stored: DataFrame, *, start: str, end: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Archive rows of a date range as one plan: (valid flux, events to append, totals).

    The range is processed whole, so no event is cut at a batch edge. Totals count rows,
    new events and days without any sample.
    """
    lo, hi = _span(start, end)
    flux = archive.where(F.col(TS).between(lo, hi))
    fresh = _new_events(flux, stored)
    return flux, fresh, _totals(flux, fresh, lo, hi)


FLUX_SCHEMA = T.StructType().add("timestamp", T.TimestampNTZType()).add("flux_short", "double").add("flux_long", "double").add("satellite", "string")
EVENT_SCHEMA = (
    T.StructType().add("start_time", T.TimestampNTZType()).add("peak_time", T.TimestampNTZType()).add("end_time", T.TimestampNTZType())
    .add("flare_class", "string").add("class_category", "string").add("class_magnitude", "double").add("source", "string")
)


def backfill_tables(store: CommittedTables, archive: DataFrame, *, start: str, end: str) -> DataFrame:
    """Stores what an archive's date range holds: its flux is upserted, its new events are appended, and both become visible in one commit.

    The tables are ``flux`` and ``events`` of the store; only the days of the range are read and rewritten. Running it again, also after a crash at any point, gives
    the same tables: flux rows replace themselves, and events that are stored are not new. Returns the totals of ``backfill``.
    """
    spark = archive.sparkSession
    columns = FLUX_SCHEMA.fieldNames()
    lo, hi = _span(start, end)
    # both are read several times, and before the tables change: the archive is parsed once, events are looked for once
    flux = durable(archive.where(F.col(TS).between(lo, hi)).select(*columns))
    fresh = durable(_new_events(flux, store.read("events", EVENT_SCHEMA)))
    totals = durable(_totals(flux, fresh, lo, hi))
    days = [r["day"] for r in flux.select(F.to_date(TS).cast("string").alias("day")).distinct().collect()]
    merged = upsert(store.read("flux", FLUX_SCHEMA, days), flux.withColumn("_given", F.lit(1)), keys=[TS], order=["_given", "flux_long", "flux_short"])
    replaced = store.stage("flux", merged, TS, staging_path(spark, "flux"))
    added = store.stage("events", fresh.select(*EVENT_SCHEMA.fieldNames()), "peak_time", staging_path(spark, "events"))
    store.commit({"flux": replaced}, {"events": added})
    return totals
