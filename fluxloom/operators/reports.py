"""Filters, rankings and summary tables over events, logs and predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fluxloom.functions.classes import FILTER_RANK, rank_of
from fluxloom.functions.curves import bucket_start
from fluxloom.functions.missing import nan_as_null
from fluxloom.functions.timing import micros, plus_hours

CLASS_PROBS = ("None", "C", "M", "X")


# --- filters ------------------------------------------------------------------------------


def _between(c: str, start, end) -> Column:
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col(c) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        cond = cond & (F.col(c) <= F.lit(end).cast("timestamp_ntz"))
    return cond


def events_at_least(
    events: DataFrame, *, start=None, end=None, min_class: str = "C", region: int | None = None, by: str = "start"
) -> DataFrame:
    """Events of at least a class in a time range, in time order.

    ``by='start'`` filters on start time and the stored category; ``by='peak'`` on peak time and
    the first letter of the class text (unknown letters rank lowest).
    """
    column = "start_time" if by == "start" else "peak_time"
    floor = FILTER_RANK.get(min_class, 0)
    if by == "start":
        strong = F.col("class_category").isin(*[c for c, r in FILTER_RANK.items() if r >= floor])
    else:
        strong = rank_of(F.upper(F.substring("flare_class", 1, 1)), FILTER_RANK) >= floor
    out = events.where(_between(column, start, end) & strong)
    if region is not None:
        out = out.where(F.col("active_region") == region)
    return out.orderBy(column)


# --- counts -------------------------------------------------------------------------------


def class_counts(events: DataFrame, *, start=None, end=None) -> DataFrame:
    return events.where(_between("start_time", start, end)).groupBy("class_category").agg(F.count("*").alias("n"))


def coverage(flux: DataFrame, events: DataFrame, classes: Sequence[str] = ("C", "M", "X")) -> DataFrame:
    """Count, first and last time of the flux table and of each class (zero rows included)."""
    zero = events.sparkSession.createDataFrame([(c,) for c in classes], "name string")
    found = events.where(F.col("class_category").isin(*classes)).groupBy(F.col("class_category").alias("name")).agg(
        F.count("*").alias("n"), F.min("start_time").alias("first_time"), F.max("start_time").alias("last_time")
    )
    per_class = zero.join(found, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"), "first_time", "last_time")
    total = flux.agg(F.count("*").alias("n"), F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time"))
    return total.select(F.lit("flux").alias("name"), "n", "first_time", "last_time").unionByName(per_class)


# Events of each class that training needs.
TRAINING_TARGET = {"C": 200, "M": 50, "X": 10}


def sufficiency(events: DataFrame, target: dict[str, int] | None = None) -> DataFrame:
    """One row: counts per class, total, covered days, and whether every target is met."""
    want = target or TRAINING_TARGET
    n = {c: F.count_if(F.col("class_category") == c) for c in want}
    enough = F.lit(True)
    for c, k in want.items():
        enough = enough & (n[c] >= k)
    seconds = F.floor((micros(F.max("start_time")) - micros(F.min("start_time"))) / 1_000_000)
    days = seconds / F.lit(86400.0)
    return events.agg(
        *[n[c].alias(f"n_{c.lower()}") for c in want], F.count("*").alias("total"), days.alias("period_days"), enough.alias("sufficient")
    )


def latest(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Newest time and row count of each named (table, time column)."""
    rows = [df.agg(F.max(c).alias("latest"), F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "latest", "n") for name, (df, c) in tables.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def source_breakdown(events: DataFrame, source: str = "nasa_donki") -> DataFrame:
    """Counts per class and in total (class null): all sources, and the named one."""
    return events.rollup("class_category").agg(F.count("*").alias("n_all"), F.count_if(F.col("source") == source).alias("n_source"))


def label_distribution(labels: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per label value of each label column."""
    return (
        labels.select(*columns).unpivot([], list(columns), "label_column", "label").groupBy("label_column", "label").agg(F.count("*").alias("n"))
    )


def event_rate(survival: DataFrame) -> DataFrame:
    return survival.agg(F.avg(F.col("event").cast("double")).alias("event_rate"))


def missing_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing (null or NaN) count and fraction of each column, and of all cells (``*``), in one pass."""
    counted = nan_as_null(df, columns).agg(F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    total = sum((F.col(c) for c in columns), F.lit(0).cast("bigint"))
    entries = F.array(
        F.struct(F.lit("*").alias("column_name"), total.alias("missing"), (F.col("_rows") * len(columns)).alias("cells")),
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing"), F.col("_rows").alias("cells")) for c in columns],
    )
    return counted.select(F.inline(entries)).select(
        "column_name", "missing", F.try_divide(F.col("missing").cast("double"), F.col("cells")).alias("fraction")
    )


def probability_summary(preds: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Mean, population std, min and max of each class probability."""
    renamed = preds.select(*[F.col(c).alias(name) for name, c in columns.items()])
    return (
        renamed.unpivot([], list(columns), "class_name", "p")
        .groupBy("class_name")
        .agg(F.avg("p").alias("mean_p"), F.stddev_pop("p").alias("std_p"), F.min("p").alias("min_p"), F.max("p").alias("max_p"))
    )


def last_by_class(events: DataFrame, now: Column, *, days: int = 90, classes: Sequence[str] = ("M", "X")) -> DataFrame:
    """Newest start of each class in the trailing days (null when there is none), one row."""
    recent = (F.col("start_time") >= plus_hours(now, -24 * days)) & (F.col("start_time") <= now)
    return events.agg(*[F.max(F.when(recent & (F.col("class_category") == c), F.col("start_time"))).alias(f"last_{c.lower()}") for c in classes])


def recent_events(events: DataFrame, now: Column, *, days: int = 7, classes: Sequence[str] = ("C", "M", "X")) -> DataFrame:
    """Events of the trailing days, newest first, with the count of their class in the list."""
    recent = events.where(
        F.col("class_category").isin(*classes) & (F.col("start_time") >= plus_hours(now, -24 * days)) & (F.col("start_time") <= now)
    )
    counts = recent.groupBy("class_category").agg(F.count("*").alias("class_total"))
    return recent.join(F.broadcast(counts), "class_category").orderBy(F.desc("start_time"))  # at most one row per class


def outcome_metrics(log: DataFrame) -> DataFrame:
    """Totals and accuracy of completed predictions; a missing actual class counts as None."""
    done = F.col("outcome_recorded_at").isNotNull()
    classified = done & (F.col("prediction_type") == "classification")
    right = classified & (F.col("predicted_class") == F.coalesce("actual_flare_class", F.lit("None")))
    return log.agg(
        F.count("*").alias("total_predictions"),
        F.count_if(done).alias("with_outcomes"),
        F.count_if(classified).alias("classification_completed"),
        F.count_if(done & (F.col("prediction_type") == "survival")).alias("survival_completed"),
        F.try_divide(F.count_if(right).cast("double"), F.count_if(classified)).alias("accuracy"),
    )


def pipeline_status(loads: DataFrame, predictions: DataFrame, validations: DataFrame) -> DataFrame:
    """One row: newest successful load, prediction total, newest validation and its result."""
    ok = F.when(F.col("status") == "success", F.col("run_timestamp"))
    a = loads.agg(F.max(ok).alias("last_load"), F.max_by("source_name", ok).alias("last_source"))
    b = predictions.agg(F.count("*").alias("total_predictions"))
    c = validations.agg(
        F.max("run_timestamp").alias("last_validation"),
        F.max_by("status", "run_timestamp").alias("validation_status"),
        F.max_by("guardrail_triggered", "run_timestamp").alias("guardrail_triggered"),
    )
    one = F.lit(True)  # three one-row tables
    return a.join(b, one).join(c, one)


# --- rankings -----------------------------------------------------------------------------


def ranked_classes(preds: DataFrame, probs: str, keep: Sequence[str]) -> DataFrame:
    """Class probabilities in percent, most likely first; ties by class name."""
    long = preds.select(*keep, F.explode(probs).alias("class_name", "p"))
    order = W.partitionBy(*keep).orderBy(F.desc("p"), "class_name")
    return long.select(*keep, "class_name", (F.floor(F.col("p") * 1e4 + 0.5) / F.lit(100.0)).alias("percent"), F.row_number().over(order).alias("rank"))


def ranked_in_row(probs: Column) -> Column:
    """The same ranking inside one row, without a shuffle: array of (class, p) by falling p."""
    pairs = F.transform(F.map_entries(probs), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("c")))
    return F.transform(F.array_sort(pairs), lambda e: F.struct(e["c"].alias("class_name"), (-e["n"]).alias("p")))


def ordered_buckets(df: DataFrame, label: str = "bucket") -> DataFrame:
    return df.withColumn("bucket_start", bucket_start(label)).orderBy("bucket_start", label)


def top_contributions(df: DataFrame, features: Sequence[str], keep: Sequence[str], n: int = 15) -> DataFrame:
    """The n features of largest absolute value in every row; ranked inside the row."""
    entries = F.array(*[F.struct((-F.abs(F.col(f))).alias("size"), F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    best = F.slice(F.array_sort(F.filter(entries, lambda e: e["size"].isNotNull())), 1, n)
    return df.select(*keep, F.posexplode(best).alias("_pos", "_e")).select(*keep, (F.col("_pos") + 1).alias("rank"), "_e.feature", "_e.value")


def likely_bucket(distribution: Column) -> tuple[Column, Column]:
    """(bucket, probability) of the most likely bucket; ties go to the earlier bucket."""
    pairs = F.transform(
        F.map_entries(distribution), lambda e: F.struct((-e["value"]).alias("n"), bucket_start(e["key"]).alias("s"), e["key"].alias("b"))
    )
    first = F.get(F.array_sort(pairs), 0)
    return first["b"], -first["n"]


def hazard_band(score: Column | str) -> Column:
    h = F.col(score) if isinstance(score, str) else score
    return F.when(h > 1.5, "high").when(h > 1.0, "moderate").when(h.isNotNull(), "low")


def probability_delta(baseline: DataFrame, scenario: DataFrame, *, on: Sequence[str] = ("class_name",)) -> DataFrame:
    """Scenario minus baseline per class; a missing side counts as 0; under 0.001 is flat."""
    a = baseline.select(*on, F.col("p").alias("p_base"))
    b = scenario.select(*on, F.col("p").alias("p_scenario"))
    delta = F.coalesce("p_scenario", F.lit(0.0)) - F.coalesce("p_base", F.lit(0.0))
    return (
        a.join(b, list(on), "full_outer")
        .withColumn("delta", delta)
        .withColumn("direction", F.when(F.abs("delta") < 0.001, "flat").when(F.col("delta") > 0, "up").otherwise("down"))
    )

