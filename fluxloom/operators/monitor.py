"""Drift, prediction validity, guardrails and model health."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fluxloom.functions.curves import curve_checks
from fluxloom.plans.ordering import running_sums, with_previous

# Rows kept per feature as reference, and the fewest that allow a test.
REFERENCE_ROWS = 1000
FEWEST_REFERENCE = 10
_KNOWN = "value is not null and not isnan(value)"


def drift_reference(df: DataFrame, features: Sequence[str], order: Sequence[str], *, rows: int = REFERENCE_ROWS) -> DataFrame:
    """The newest ``rows`` values, neither null nor NaN, of each feature: (feature, value, order columns).

    The rank filter is pushed below the shuffle (a per-task top-k), so each task sends at most
    ``rows`` values per feature.
    """
    long = df.select(*order, *[F.col(c).cast("double").alias(c) for c in features]).unpivot(list(order), list(features), "feature", "value")
    return newest_per_feature(long.where(_KNOWN), order, rows=rows)


def newest_per_feature(long: DataFrame, order: Sequence[str], *, rows: int = REFERENCE_ROWS) -> DataFrame:
    newest = W.partitionBy("feature").orderBy(*[F.desc(c) for c in order])
    return long.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= rows).drop("_k")


def long_form(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in features]).unpivot([], list(features), "feature", "value").where(_KNOWN)


def _value_counts(reference: DataFrame, current: DataFrame) -> DataFrame:
    both = reference.select("feature", "value", F.lit(1).alias("r"), F.lit(0).alias("c")).unionByName(
        current.select("feature", "value", F.lit(0).alias("r"), F.lit(1).alias("c"))
    )
    return both.where(_KNOWN).groupBy("feature", "value").agg(F.sum("r").alias("n_ref"), F.sum("c").alias("n_cur"))


def _kolmogorov_tail(x: Column, terms: int = 60) -> Column:
    """P(K > x) of the limiting distribution; under 0.2 it is 1 to ten digits."""
    series = F.lit(0.0)
    for k in range(1, terms + 1):
        series = series + 2.0 * (-1.0) ** (k - 1) * F.exp(-2.0 * k * k * x * x)
    return F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def _normal_tail(z: Column) -> Column:
    """Two-sided P(|Z| > z), by a rational approximation good to 1.5e-7."""
    # Published coefficients of the error-function approximation.
    a = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = F.lit(0.0)
    for coefficient in reversed(a):
        poly = (poly + coefficient) * t
    return poly * F.exp(-x * x)


def ks_drift(reference: DataFrame, current: DataFrame, *, alpha: float = 0.05) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov test per feature of two (feature, value) tables.

    Values are counted, then both distribution functions run as one prefix sum, so a feature is
    never sorted in one task. Features with too few reference values or no current ones drop out.
    """
    counted = _value_counts(reference, current)
    placed = running_sums(counted, ["value"], {"cum_ref": F.col("n_ref"), "cum_cur": F.col("n_cur")}, ["feature"])
    sizes = counted.groupBy("feature").agg(F.sum("n_ref").alias("ref_rows"), F.sum("n_cur").alias("cur_rows"))
    tested = sizes.where((F.col("ref_rows") >= FEWEST_REFERENCE) & (F.col("cur_rows") > 0))
    gap = F.abs(F.col("cum_ref") / F.col("ref_rows") - F.col("cum_cur") / F.col("cur_rows"))
    found = placed.join(tested, "feature").groupBy("feature", "ref_rows", "cur_rows").agg(F.max(gap).alias("statistic"))
    size = F.sqrt(F.col("ref_rows") * F.col("cur_rows") / (F.col("ref_rows") + F.col("cur_rows")))
    return found.withColumn("p_value", _kolmogorov_tail(size * F.col("statistic"))).withColumn(
        "p_method", F.lit("asymptotic")
    ).withColumn("drift_detected", F.col("p_value") < alpha)


def rank_drift(reference: DataFrame, current: DataFrame, *, alpha: float = 0.05) -> DataFrame:
    """Mann-Whitney U of the reference against the current values per feature, two-sided."""
    counted = _value_counts(reference, current).withColumn("n", F.col("n_ref") + F.col("n_cur"))
    placed = running_sums(counted, ["value"], {"upto": F.col("n")}, ["feature"])
    mid = F.col("upto") - F.col("n") + (F.col("n") + 1) / 2
    n = F.col("n").cast("double")
    summed = placed.groupBy("feature").agg(
        F.sum(F.col("n_ref") * mid).alias("rank_sum"), F.sum("n_ref").alias("ref_rows"), F.sum("n_cur").alias("cur_rows"), F.sum(n * n * n - n).alias("_ties")
    )
    tested = summed.where((F.col("ref_rows") >= FEWEST_REFERENCE) & (F.col("cur_rows") > 0))
    n1, n2 = F.col("ref_rows").cast("double"), F.col("cur_rows").cast("double")
    u = F.col("rank_sum") - n1 * (n1 + 1) / 2
    total = n1 + n2
    sd = F.sqrt(n1 * n2 / 12 * (total + 1 - F.col("_ties") / (total * (total - 1))))
    z = F.greatest(F.abs(u - n1 * n2 / 2) - 0.5, F.lit(0.0)) / sd
    return tested.select(
        "feature", "ref_rows", "cur_rows", u.alias("statistic"), F.coalesce(_normal_tail(z), F.lit(1.0)).alias("p_value"), F.lit("asymptotic").alias("p_method")
    ).withColumn("drift_detected", F.col("p_value") < alpha)


def drift_summary(tests: DataFrame) -> DataFrame:
    """One row: drifted features and whether any drifted."""
    return tests.agg(
        F.array_sort(F.collect_list(F.when(F.col("drift_detected"), F.col("feature")))).alias("drifted_features"),
        F.count("*").alias("tested"),
        F.coalesce(F.bool_or("drift_detected"), F.lit(False)).alias("overall_drift"),
    )


# --- validity -----------------------------------------------------------------------------

# Texts of the guardrail messages.
ZERO = "survival prediction total probability is zero"
LOW = "survival prediction total probability too low"
HIGH = "survival prediction total probability too high"
FLAT = "survival function nearly flat"
COLLAPSE = "survival function collapses to zero inside prediction horizon"
DROP = "survival function has abrupt drop"
GUARDRAIL_MESSAGES = (ZERO, LOW, HIGH, FLAT, "survival function collapses to zero", DROP)


def class_reasons(probabilities: Column) -> Column:
    """What is wrong with a class-probability map (empty array: nothing)."""
    values = F.map_values(probabilities)
    bad = F.exists(values, lambda v: F.isnan(v))
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return F.array_compact(
        F.array(
            F.when(bad, "classification prediction contains NaN"),
            F.when(~bad & (F.abs(total - 1.0) > 0.1), "classification probabilities don't sum to 1"),
        )
    )


def survival_reasons(distribution: Column, hazard: Column, curve: Column) -> Column:
    """What is wrong with a bucket map, hazard and curve (empty array: nothing)."""
    values = F.map_values(distribution)
    bad = F.exists(values, lambda v: F.isnan(v))
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    risky = F.coalesce(hazard > 0, F.lit(False))
    zero = (total == 0) & F.coalesce(hazard == 0, F.lit(True))
    low = ~zero & (total < 0.0001) & ~risky
    checks = curve_checks(curve)
    examined = ~bad & ((total >= 0.0001) | risky) & (F.size(curve) > 0)
    flat = examined & (checks["curve_range"] < 0.001)
    collapse = examined & ~flat & (checks["min_before_end"] <= 0.01)
    drop = examined & ~flat & ~collapse & (checks["max_drop"] > 0.9)
    return F.array_compact(
        F.array(
            F.when(bad, "survival prediction contains NaN"),
            F.when(~bad & zero, ZERO),
            F.when(~bad & low, LOW),
            F.when(~bad & (total > 1.5), HIGH),
            F.when(flat, FLAT),
            F.when(collapse, COLLAPSE),
            F.when(drop, DROP),
        )
    )


def guardrail_rollup(checks: DataFrame, run: str, reasons: str) -> DataFrame:
    """Per run: pass / fail, whether a guardrail message occurred, and its texts (500 characters).

    Distinct messages are few and known, so what is collected per run is bounded.
    """
    long = checks.select(run, F.explode_outer(reasons).alias("reason"))
    known = F.lit(False)
    for text in GUARDRAIL_MESSAGES:
        known = known | F.col("reason").contains(text)
    guard = F.when(known, F.col("reason"))
    out = long.groupBy(run).agg(
        F.count("reason").alias("errors"),
        F.coalesce(F.bool_or(known), F.lit(False)).alias("guardrail_triggered"),
        F.array_sort(F.collect_set(guard)).alias("_texts"),
    )
    return out.select(
        run,
        F.when(F.col("errors") == 0, "pass").otherwise("fail").alias("status"),
        "errors",
        "guardrail_triggered",
        F.when(F.size("_texts") > 0, F.substring(F.array_join("_texts", "; "), 1, 500)).alias("guardrail_reason"),
    )


def validation_confidence(validations: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Newest validation's result as a confidence word."""
    newest = validations.groupBy(*by).agg(
        F.max_by("status", "run_timestamp").alias("status"), F.max_by("guardrail_triggered", "run_timestamp").alias("guardrail_triggered")
    )
    word = F.when(F.col("guardrail_triggered"), "low").when(F.col("status") == "pass", "normal").when(F.col("status").isNull(), "unknown").otherwise("low")
    return newest.withColumn("confidence", word)


def clear_guardrail(validations: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The table with the flag and reason of the newest triggered row of each group cleared."""
    newest = validations.where("guardrail_triggered").groupBy(*by).agg(F.max("run_timestamp").alias("_newest"))
    joined = validations.join(newest, list(by), "left") if by else validations.join(F.broadcast(newest), F.lit(True))  # one row
    hit = F.col("guardrail_triggered") & (F.col("run_timestamp") == F.col("_newest"))
    return joined.select(
        *[
            F.when(hit, False).otherwise(F.col(c)).alias(c) if c == "guardrail_triggered"
            else F.when(hit, None).otherwise(F.col(c)).alias(c) if c == "guardrail_reason"
            else F.col(c)
            for c in validations.columns
        ]
    )


def version_comparison(metrics: DataFrame, *, model: str = "model", version: str = "version", value: str = "c_index") -> DataFrame:
    """Change of the concordance against the version before: improved, worse (< -0.05) or similar."""
    paired = metrics.withColumn("_pair", F.struct(version, value))
    before = with_previous(paired, "_pair", [model]).withColumn("previous", F.col(f"prev.{value}"))
    change = F.col(value) - F.col("previous")
    word = F.when(F.col("previous").isNull(), None).when(change > 0, "improved").when(change < -0.05, "worse").otherwise("similar")
    return before.select(*metrics.columns, "previous", change.alias("change"), word.alias("verdict"))


def retrain_trigger(current: DataFrame, baseline: DataFrame, on: Sequence[str]) -> DataFrame:
    """Whether a model needs training again: Brier score up by over 10 %, precision or recall under 0.5."""
    both = current.join(baseline.select(*on, F.col("brier").alias("brier_base")), list(on), "left")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("brier") > F.col("brier_base") * 1.1, "brier"),
            F.when(F.col("precision") < 0.5, "precision"),
            F.when(F.col("recall") < 0.5, "recall"),
        )
    )
    return both.withColumn("reasons", F.array_join(reasons, ",")).withColumn("retrain", F.size(reasons) > 0)
