"""Freshness and load-status scalars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fluxloom.functions.timing import hours_between

# Sources that decide a load's status, and those that can only lift it.
REQUIRED_SOURCES = ("xray_flux", "solar_regions", "magnetogram", "flare_events")
OPTIONAL_SOURCES = ("donki_flares",)


def freshness(latest: Column, now: Column) -> tuple[Column, Column]:
    """(age in hours, fresh / stale / outdated / unknown)."""
    age = hours_between(now, latest)
    word = F.when(latest.isNull(), "unknown").when(age < 24, "fresh").when(age < 48, "stale").otherwise("outdated")
    return age, word


def load_status(
    runs: DataFrame,
    *,
    run: str = "run_id",
    source: str = "source_name",
    status: str = "status",
    required=REQUIRED_SOURCES,
    optional=OPTIONAL_SOURCES,
) -> DataFrame:
    """One row per run: success / partial / failed from its sources' results."""
    needed = F.col(source).isin(*required)
    worked = F.col(status) == "success"
    return (
        runs.groupBy(run)
        .agg(
            F.count_if(needed).alias("required_total"),
            F.count_if(needed & worked).alias("required_success"),
            F.count_if(F.col(source).isin(*optional) & worked).alias("optional_success"),
        )
        .withColumn(
            "overall_status",
            F.when(F.col("required_total") == 0, "failed")
            .when(F.col("required_success") == F.col("required_total"), "success")
            .when(F.col("required_success") > 0, "partial")
            .when(F.col("optional_success") > 0, "partial")
            .otherwise("failed"),
        )
    )
