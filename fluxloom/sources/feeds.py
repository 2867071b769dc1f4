"""Landed feeds to typed tables: X-ray samples, regions, magnetograms, event catalogs, archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fluxloom import schemas
from fluxloom.functions.classes import parsed_class
from fluxloom.functions.magnetic import magnetic_complexity, polarity
from fluxloom.functions.timing import as_utc, parse_utc

# The feed's two bands.
SHORT_BAND, LONG_BAND = "0.05-0.4nm", "0.1-0.8nm"


def read_xray_feed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.XRAY_FEED).json(path, multiLine=False)


def _numeric(c: str) -> Column:
    return F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double"))


def widen_bands(df: DataFrame, layout: str = "long") -> DataFrame:
    """One row per time with both bands; a value that is not a number becomes null.

    ``long`` rows carry one band each. One aggregation replaces a full outer join: map-side
    combine, one shuffle. The satellite comes from the short band only.
    """
    when = as_utc(df, "time_tag")
    if layout == "wide":
        return df.select(
            when.alias("timestamp"), _numeric("A_FLUX").alias("flux_short"), _numeric("B_FLUX").alias("flux_long"), "satellite"
        )
    short, long = F.col("energy") == SHORT_BAND, F.col("energy") == LONG_BAND
    return (
        df.where(F.col("energy").isin(SHORT_BAND, LONG_BAND))
        .groupBy(when.alias("timestamp"))
        .agg(
            F.max(F.when(short, _numeric("flux"))).alias("flux_short"),
            F.max(F.when(long, _numeric("flux"))).alias("flux_long"),
            F.max(F.when(short, F.col("satellite"))).alias("satellite"),
        )
    )


def read_region_feed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.REGION_FEED).json(path)


def whole_number(c: Column | str) -> Column:
    """Integer part of a number given as text or number; unreadable becomes null."""
    col = F.col(c) if isinstance(c, str) else c
    return col.try_cast("double").try_cast("int")


def normalize_regions(df: DataFrame) -> DataFrame:
    return (
        df.select(
            as_utc(df, "observed_date").alias("timestamp"),
            whole_number("region").alias("region_number"),
            F.col("latitude").try_cast("double").alias("latitude"),
            F.col("longitude").try_cast("double").alias("longitude"),
            F.col("spot_class").alias("mcintosh_class"),
            F.col("mag_class").alias("mount_wilson_class"),
            whole_number("area").alias("area"),
            whole_number("number_spots").alias("num_sunspots"),
            F.col("mag_class").alias("magnetic_type"),
        )
        .where(F.col("region_number").isNotNull())
    )


def derive_magnetograms(regions: DataFrame, source: str = "noaa_swpc") -> DataFrame:
    kind = F.col("magnetic_type")
    return regions.where(F.col("region_number").isNotNull()).select(
        "timestamp",
        "region_number",
        F.lit(None).cast("double").alias("magnetic_field_strength"),
        polarity(kind).alias("magnetic_field_polarity"),
        magnetic_complexity(kind).alias("magnetic_complexity"),
        "latitude",
        "longitude",
        F.lit(source).alias("source"),
        F.when(F.coalesce(kind, F.lit("")) != "", "good").otherwise("fair").alias("data_quality"),
    )


def read_catalog_feed(spark: SparkSession, path: str) -> DataFrame:
    """Catalog records, one JSON document per line, with the raw text kept as ``payload``."""
    raw = spark.read.text(path).withColumnRenamed("value", "payload")
    return with_payload_fields(raw)


def with_payload_fields(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds the catalog record's fields, read from its JSON text."""
    return raw.withColumn("_r", F.from_json(payload, schemas.CATALOG_FEED)).select(*raw.columns, "_r.*")


def catalog_to_events(df: DataFrame, *, verified: bool = True, source: str = "nasa_donki", rebuilt_class: bool = False) -> DataFrame:
    """Event rows from catalog records; an unreadable class, start or peak drops the record.

    ``rebuilt_class`` writes the class text from its parsed letter and magnitude and keeps
    the record's location (the one-shot import's form).
    """
    letter, magnitude = parsed_class("classType")
    text = F.concat(F.col("class_category"), F.format_string("%.1f", F.col("class_magnitude"))) if rebuilt_class else F.col("classType")
    rows = df.select(
        parse_utc("beginTime").alias("start_time"),
        parse_utc("peakTime").alias("peak_time"),
        parse_utc("endTime").alias("end_time"),
        "classType",
        letter.alias("class_category"),
        magnitude.alias("class_magnitude"),
        whole_number("activeRegionNum").alias("active_region"),
        F.col("sourceLocation").alias("location") if rebuilt_class else F.lit(None).cast("string").alias("location"),
        F.lit(source).alias("source"),
        F.lit(verified).alias("verified"),
    )
    usable = F.col("class_category").isNotNull() & F.col("start_time").isNotNull() & F.col("peak_time").isNotNull()
    return rows.where(usable).withColumn("flare_class", text).drop("classType")


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of every key in ``order``; combines before the shuffle, so hot keys are safe."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    newest = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(newest.alias("_v")).select(*keys, "_v.*")


def normalize_catalog(df: DataFrame, *, arrival: list[str], source: str = "nasa_donki", payload: str = "payload") -> DataFrame:
    """Catalog table rows; the last arrival of an (external_id, source) wins."""
    rows = df.select(
        F.coalesce(F.nullif("flrID", F.lit("")), F.nullif("id", F.lit("")), F.nullif("activityID", F.lit(""))).alias("external_id"),
        F.lit(source).alias("source"),
        parse_utc("beginTime").alias("begin_time"),
        parse_utc("peakTime").alias("peak_time"),
        parse_utc("endTime").alias("end_time"),
        F.col("classType").alias("class_type"),
        F.col("sourceLocation").alias("source_location"),
        F.col("activeRegionNum").try_cast("int").alias("active_region_num"),
        F.coalesce(F.to_json("instruments"), F.lit("[]")).alias("instruments"),
        F.coalesce(F.to_json("linkedEvents"), F.lit("[]")).alias("linked_events"),
        F.col(payload).alias("raw_payload"),
        *[F.col(c).alias(f"_arrival_{i}") for i, c in enumerate(arrival)],
    )
    order = [f"_arrival_{i}" for i in range(len(arrival))]
    return last_wins(rows.where(F.col("external_id").isNotNull()), ["external_id", "source"], order)


def valid_flux(df: DataFrame) -> DataFrame:
    """Rows where both bands are positive."""
    return df.where((F.col("flux_short") > 0) & (F.col("flux_long") > 0))


def read_archive_csv(spark: SparkSession, path: str) -> DataFrame:
    """One-minute archive files: comment lines skipped, both bands positive, satellite tagged."""
    raw = (
        spark.read.option("comment", "#")
        .option("header", "true")
        .option("ignoreLeadingWhiteSpace", "true")
        .schema("time_tag STRING, xrsa_flux STRING, xrsb_flux STRING, xrsa_flag STRING, xrsb_flag STRING")
        .csv(path)
    )
    rows = raw.select(
        parse_utc("time_tag").alias("timestamp"),
        F.col("xrsa_flux").try_cast("double").alias("flux_short"),
        F.col("xrsb_flux").try_cast("double").alias("flux_long"),
    )
    return assign_satellite(valid_flux(rows))


def assign_satellite(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Primary satellite of the row's date."""
    # Date ranges (both ends in) and their primary satellite; otherwise the default.
    periods = [("2020-01-01", "2022-06-30", "goes16"), ("2022-07-01", "2024-12-31", "goes16")]
    name = F.lit("goes16")
    day = F.to_date(F.col(ts))
    for first, last, satellite in periods:
        name = F.when(day.between(F.lit(first).cast("date"), F.lit(last).cast("date")), satellite).otherwise(name)
    return df.withColumn("satellite", name)
