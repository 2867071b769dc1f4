"""Batch scoring runs: all models at once, guarded runs with drift check, and backtests."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, functions as F

from fluxloom.functions.curves import BUCKET_HOURS
from fluxloom.operators import backtest, monitor
from fluxloom.operators.classify import ClassModel, score_classes
from fluxloom.operators.survival import HORIZON, score_survival
from fluxloom.session import durable
from fluxloom.sources.tables import append, prediction_log_rows

TS = "timestamp"


def score_all(
    grid: DataFrame,
    classifiers: dict[int, tuple[ClassModel, DataFrame]],
    survival: dict[str, tuple[object, DataFrame]],
    *,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Every model's result per grid row. A model that cannot score leaves nulls and its message;
    the others still do."""
    on = [*keys, TS]
    out = grid.select(*on).distinct()
    for hours, (model, features) in classifiers.items():
        out = _attach(out, on, f"{hours}h", model, features, lambda m=model, f=features, h=hours: score_classes(m, f, on, window_hours=h), ["predicted_class", "class_probabilities"], ["string", "map<string,double>"])
    for kind, (model, features) in survival.items():
        out = _attach(out, on, kind, model, features, lambda m=model, f=features, k=kind: score_survival(m, f, on, kind=k), ["hazard_score", "probability_distribution"], ["double", "map<string,double>"])
    return out


# What a model that does not fit its rows raises: a column that is missing, a plan that cannot be built, a job that fails while it runs.
FAILURES = (PySparkException, Py4JJavaError, ValueError, KeyError)


def _attach(out: DataFrame, on: list[str], tag: str, model, features: DataFrame, score: Callable[[], DataFrame], columns: list[str], types: list[str]) -> DataFrame:
    """``out`` with one model's results. They are written down inside the guard, so a failure while scoring is seen here and not later."""
    try:
        missing = [c for c in getattr(model, "columns", []) if c not in features.columns]
        if missing:
            raise ValueError(f"missing columns: {missing}")
        part = durable(score().select(*on, *[F.col(c).alias(f"{c}_{tag}") for c in columns]))
    except FAILURES as e:
        nulls = {f"{c}_{tag}": F.lit(None).cast(t) for c, t in zip(columns, types)}
        return out.withColumns({**nulls, f"error_{tag}": F.lit(str(e)[:500])})
    return out.join(part, on, "left").withColumn(f"error_{tag}", F.lit(None).cast("string"))


def score_run(
    features: DataFrame,
    columns: Sequence[str],
    reference: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    *,
    log_path: str,
    logged_at: Column,
    order: Sequence[str],
) -> tuple[DataFrame, DataFrame]:
    """One guarded run: (drift tests, new reference).

    Drift of the incoming rows is measured against the old reference, before they extend it;
    then the rows are scored and appended to the prediction log.
    """
    tests = durable(monitor.ks_drift(reference, monitor.long_form(features, columns)))
    append(prediction_log_rows(score(features), logged_at=logged_at), log_path)
    fresh = monitor.drift_reference(features, columns, order)
    both = reference.select(fresh.columns).unionByName(fresh)
    newest = monitor.newest_per_feature(both, order)
    return tests, durable(newest)


def run_backtest(
    model, features: DataFrame, actuals: DataFrame, *, keys: Sequence[str] = (), window_hours: int = 48, within: Sequence[str] | None = None
) -> DataFrame:
    """Score a grid of rows and compare with what followed within the horizon: one row of backtest metrics.

    A row's probability is the sum of the buckets that end by ``window_hours``; ``within`` names others.
    """
    on = [*keys, TS]
    if within is None:
        within = [f"{a}h-{b}h" for a, b in zip(BUCKET_HOURS, BUCKET_HOURS[1:]) if b <= window_hours]
    scored = score_survival(model, features, on)
    p = sum((F.coalesce(F.col("probability_distribution")[b], F.lit(0.0)) for b in within), F.lit(0.0))
    preds = durable(scored.select(*on, F.struct(*on).alias("id"), F.lit(window_hours).alias("window_hours"), p.alias("p")))
    return backtest.backtest_metrics(preds, actuals, keys=keys, probability="p", default_hours=window_hours)


def split_backtest(
    fit: Callable[[DataFrame], object], rows: DataFrame, actuals: DataFrame, *, since: str, keys: Sequence[str] = (), window_hours: int = 48, embargo_hours: int = HORIZON
) -> tuple[object, DataFrame]:
    """Backtest on rows the model has not seen: (model, one row of metrics).

    It is fitted to rows whose whole look ahead (``embargo_hours``) lies before ``since`` and tested on the rows and events from then on.
    """
    start = F.lit(since).cast("timestamp_ntz")
    model = fit(rows.where(F.col(TS) <= start - F.expr(f"interval {int(embargo_hours)} hours")))
    later = actuals.where(F.col("peak_time") >= start)
    return model, run_backtest(model, rows.where(F.col(TS) >= start), later, keys=keys, window_hours=window_hours)
