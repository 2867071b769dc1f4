"""Matching predictions with what happened: hits, misses, metrics, recorded outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fluxloom.functions.classes import LABEL_RANK, rank_name, rank_of
from fluxloom.functions.timing import HOUR_US, from_micros, hours_to_us, micros
from fluxloom.plans.ordering import carried_values
from fluxloom.plans.ranges import Part, range_aggregate

PRED_TS = "timestamp"


def _ahead(predictions: DataFrame, keys: Sequence[str], default_hours: int) -> DataFrame:
    hours = F.coalesce("window_hours", F.lit(default_hours)) if "window_hours" in predictions.columns else F.lit(default_hours)
    at = micros(PRED_TS)
    return predictions.select(*keys, "id", PRED_TS, at.alias("lo"), (at + hours.cast("bigint") * HOUR_US).alias("hi"))


def match_predictions(
    predictions: DataFrame, actuals: DataFrame, *, keys: Sequence[str] = (), default_hours: int = 48
) -> DataFrame:
    """Per prediction: events peaking in [t, t + window], hit flag, earliest matched peak."""
    found = range_aggregate(
        _ahead(predictions, keys, default_hours),
        actuals.withColumn("us", micros("peak_time")),
        keys=keys,
        group=[*keys, "id", PRED_TS],
        parts=[Part("n", "1L", "sum"), Part("first", "us", "min")],
        finals=[F.coalesce(F.sum("n"), F.lit(0)).alias("n_matched"), from_micros(F.min("first")).alias("first_peak")],
        base=hours_to_us(default_hours) // 16,
        longest=hours_to_us(default_hours),
    )
    return found.withColumn("hit", F.col("n_matched") > 0)


def missed_actuals(matches: DataFrame, actuals: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Events whose peak is no prediction's earliest match."""
    firsts = matches.where("hit").select(*keys, F.col("first_peak").alias("peak_time")).distinct()
    return actuals.join(firsts, [*keys, "peak_time"], "left_anti")


def backtest_metrics(
    predictions: DataFrame, actuals: DataFrame, *, keys: Sequence[str] = (), probability: str | None = None, default_hours: int = 48
) -> DataFrame:
    """One row of counts, precision, recall, F1 and mean squared error of the probability.

    ``recall_ref`` mixes predictions and events (hits over hits plus unmatched events);
    ``event_recall`` is the share of events some prediction matched first.
    """
    matches = match_predictions(predictions, actuals, keys=keys, default_hours=default_hours)
    miss = missed_actuals(matches, actuals, keys=keys).agg(F.count("*").alias("false_negatives"))
    events = actuals.agg(F.count("*").alias("n_actuals"))
    error = F.lit(None).cast("double")
    scored = matches
    if probability is not None:
        scored = matches.join(predictions.select(*keys, "id", F.col(probability).alias("_p")), [*keys, "id"])
        error = F.avg(F.pow(F.col("_p") - F.col("hit").cast("double"), 2))
    counts = scored.agg(F.count("*").alias("n_predictions"), F.count_if("hit").alias("n_hits"), error.alias("brier_score"))
    one = F.lit(True)  # three one-row tables
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    hits = F.col("n_hits").cast("double")
    enough = (F.col("n_predictions") > 0) & (F.col("n_actuals") > 0)
    out = (
        counts.join(events, one)
        .join(miss, one)
        .withColumn("n_misses", F.col("n_predictions") - F.col("n_hits"))
        .withColumn("precision", ratio(hits, F.col("n_predictions")))
        .withColumn("recall_ref", ratio(hits, F.col("n_hits") + F.col("false_negatives")))
        .withColumn("event_recall", ratio((F.col("n_actuals") - F.col("false_negatives")).cast("double"), F.col("n_actuals")))
    )
    f1 = ratio(2 * F.col("precision") * F.col("recall_ref"), F.col("precision") + F.col("recall_ref"))
    out = out.withColumn("f1_score", f1).withColumn("error", F.when(~enough, "insufficient data"))
    measured = ("n_hits", "n_misses", "false_negatives", "precision", "recall_ref", "event_recall", "f1_score", "brier_score")
    return out.select("n_predictions", "n_actuals", *[F.when(enough, F.col(c)).alias(c) for c in measured], "error")


def record_outcomes(
    log: DataFrame, events: DataFrame, *, keys: Sequence[str] = (), recorded_at: Column, default_hours: int = 24
) -> DataFrame:
    """Log rows with the strongest class that followed, its first time, and when it was recorded.

    Every row looks up the next event of each class, one ordered pass over both tables; those after the row's window do not count.
    """
    rank = rank_of("class_category", LABEL_RANK)
    ranks = sorted((r for r in LABEL_RANK.values() if r > 0), reverse=True)
    asks = _ahead(log, keys, default_hours).select(*keys, "id", F.col("lo").alias("us"), "hi", F.lit(0).alias("_side"))
    known = events.select(*keys, micros("peak_time").alias("us"), rank.alias("_rank")).where("_rank > 0").dropna(subset=[*keys, "us"])  # null keys belong to no series
    known = known.select(*keys, "us", *[F.when(F.col("_rank") == r, F.col("us")).alias(f"at_{r}") for r in ranks], F.lit(1).alias("_side"))
    both = asks.unionByName(known, allowMissingColumns=True)
    ahead = carried_values(both, ["us", "_side"], [f"at_{r}" for r in ranks], keys, backward=True).where("_side = 0")
    inside = [F.min(F.when((F.col("us") <= F.col(f"_fill_at_{r}")) & (F.col(f"_fill_at_{r}") <= F.col("hi")), F.col(f"_fill_at_{r}"))).alias(f"at_{r}") for r in ranks]
    found = ahead.groupBy(*keys, "id").agg(*inside)
    top = F.coalesce(*[F.when(F.col(f"at_{r}").isNotNull(), r) for r in ranks], F.lit(0))
    seen = found.select(
        *keys,
        "id",
        rank_name(top, LABEL_RANK).alias("actual_flare_class"),
        from_micros(F.coalesce(*[F.col(f"at_{r}") for r in ranks])).alias("actual_flare_time"),
        recorded_at.alias("outcome_recorded_at"),
    )
    old = [c for c in ("actual_flare_class", "actual_flare_time", "outcome_recorded_at") if c in log.columns]
    return log.drop(*old).join(seen, [*keys, "id"])
