"""Keyed tables on Parquet: upserts, snapshots, range scans and append-only logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fluxloom.functions.missing import nan_as_null
from fluxloom.session import drop_table, staging_path
from fluxloom.sources.feeds import whole_number


def upsert(
    target: DataFrame, updates: DataFrame, *, keys: Sequence[str], order: Sequence[str], keep_first: Sequence[str] = ()
) -> DataFrame:
    """Target rows overlaid by updates; the last update of a key (in ``order``) wins.

    One aggregation over the union: combine before the shuffle, so a key that is updated
    millions of times costs one row per map task. ``keep_first`` columns keep their oldest
    non-null value (e.g. a creation time).
    """
    keys, keep = list(keys), list(keep_first)
    values = [c for c in target.columns if c not in keys and c not in keep]
    age = F.struct(F.col("_gen"), *[F.col(f"_o{i}") for i in range(len(order))])

    def staged(df: DataFrame, gen: int, has_order: bool) -> DataFrame:
        stamps = [
            (F.col(o) if has_order else F.lit(None).cast(dict(updates.dtypes)[o])).alias(f"_o{i}") for i, o in enumerate(order)
        ]
        have = set(df.columns)
        cols = [F.col(c) if c in have else F.lit(None).cast(dict(target.dtypes)[c]).alias(c) for c in target.columns]
        return df.select(*cols, F.lit(gen).alias("_gen"), *stamps)

    both = staged(target, 0, False).unionByName(staged(updates, 1, True))
    firsts = [F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), age)).alias(c) for c in keep]
    merged = both.groupBy(*keys).agg(F.max_by(F.struct(*values), age).alias("_v"), *firsts)
    return merged.select(*keys, "_v.*", *keep).select(*target.columns)


def upsert_stats(target: DataFrame, updates: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """One row: records fetched, keys inserted and keys updated."""
    keys = list(keys)
    touched = updates.groupBy(*keys).agg(F.count("*").alias("_n"))
    known = target.select(*keys).distinct().withColumn("_known", F.lit(True))
    return touched.join(known, keys, "left").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("records_fetched"),
        F.count_if(F.col("_known").isNull()).alias("records_inserted"),
        F.count_if(F.col("_known").isNotNull()).alias("records_updated"),
    )


def coerce_flux(df: DataFrame) -> DataFrame:
    """Flux rows as stored: NaN becomes null, quality flag from the long band, satellite defaulted."""
    return nan_as_null(df).withColumn("data_quality", F.when(F.col("flux_long").isNotNull(), "good").otherwise("missing")).withColumn(
        "satellite", F.coalesce("satellite", F.lit("unknown"))
    )


def coerce_regions(df: DataFrame) -> DataFrame:
    """Region rows as stored: no null region, counts cut to whole numbers."""
    out = df.where(F.col("region_number").isNotNull())
    for c in ("area", "num_sunspots"):
        if c in out.columns:
            out = out.withColumn(c, whole_number(c))
    return out


def write_upsert(
    spark: SparkSession, path: str, updates: DataFrame, *, keys: Sequence[str], order: Sequence[str], ts: str = "timestamp", drop: Sequence[str] = ()
) -> None:
    """Upsert into a Parquet dataset partitioned by day (``dt``).

    Only the days present in the updates are read and rewritten: the pruning filter comes
    from the updates themselves. Where ``keys`` lack ``ts``, a key's time may move to another day; then the
    days that hold the updated keys are found by a scan of the key columns and are rewritten too. The result is staged first, so no path is overwritten
    while it is being read. ``drop`` names columns that only order the updates.
    """
    fresh = updates.withColumn("dt", F.to_date(F.col(ts)))
    columns = [c for c in fresh.columns if c not in drop]
    try:
        current = spark.read.parquet(path)
    except Exception as e:  # first load: the dataset is not there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        current = spark.createDataFrame([], fresh.select(*columns).schema)
    days = fresh.select("dt").distinct()
    fixed = ts in keys
    if not fixed:
        days = days.union(current.join(fresh.select(*keys), list(keys), "left_semi").select("dt")).distinct()
    merged = upsert(current.join(days, "dt", "left_semi").select(*columns), fresh, keys=[*keys, "dt"] if fixed else keys, order=order)
    staged = staging_path(spark, "upsert")
    merged.write.parquet(staged)
    # days that all rows have left, one row a day; null days never lose rows that way unless their key gains a time
    left_empty = [] if fixed else [r["day"] for r in days.join(spark.read.parquet(staged), "dt", "left_anti").where("dt is not null").select(F.col("dt").cast("string").alias("day")).collect()]
    (
        spark.read.parquet(staged)
        .hint("rebalance", "dt")  # adaptive: small days share a task, a hot day is split
        .sortWithinPartitions("dt", ts)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("dt")
        .parquet(path)
    )
    for day in left_empty:
        drop_table(spark, f"{path}/dt={day}")


def snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def fresh_snapshot(spark: SparkSession, path: str, max_age_hours: float) -> DataFrame | None:
    """The cached table, or None when it is missing or its newest file is too old."""
    try:
        cached = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    newest = cached.select(F.max("_metadata.file_modification_time").alias("m"))
    young = newest.where(F.col("m") >= F.current_timestamp() - F.expr(f"INTERVAL {int(max_age_hours * 3600)} SECONDS"))
    return None if young.isEmpty() else cached


def scan_range(df: DataFrame, start, end, ts: str = "timestamp", ordered: bool = True) -> DataFrame:
    """Rows with start <= ts <= end; with a ``dt`` column whole days are pruned as well."""
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    out = df.where(F.col(ts).between(lo, hi))
    if "dt" in df.columns:
        out = out.where(F.col("dt").between(F.to_date(lo), F.to_date(hi)))
    return out.orderBy(ts) if ordered else out


def run_log(
    df: DataFrame, *, source: str, ts: str, run_at: Column, status: str = "success", error: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Log rows of a load: record count and the time span it covered."""
    return df.groupBy(*by).agg(F.count("*").alias("records_fetched"), F.min(ts).alias("data_start_time"), F.max(ts).alias("data_end_time")).select(
        run_at.alias("run_timestamp"),
        *by,
        F.lit(source).alias("source_name"),
        F.lit(status).alias("status"),
        "records_fetched",
        "data_start_time",
        "data_end_time",
        F.substring(F.lit(error).cast("string"), 1, 500).alias("error_message"),
    )


def prediction_log_rows(df: DataFrame, *, logged_at: Column) -> DataFrame:
    """Prediction rows in log form: probability maps become JSON text."""
    have = set(df.columns)

    def optional(name: str, kind: str) -> Column:
        return (F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)).alias(name)

    def as_json(name: str) -> Column:
        return (F.to_json(name) if name in have else F.lit(None).cast("string")).alias(name)

    return df.select(
        logged_at.alias("prediction_timestamp"),
        "observation_timestamp",
        "prediction_type",
        optional("region_number", "int"),
        optional("model_type", "string"),
        optional("window_hours", "int"),
        optional("predicted_class", "string"),
        as_json("class_probabilities"),
        as_json("probability_distribution"),
        optional("hazard_score", "double"),
    )


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def list_predictions(
    log: DataFrame, *, start=None, end=None, kind: str | None = None, limit: int = 100, ts: str = "prediction_timestamp"
) -> DataFrame:
    """Newest log rows first, at most ``limit`` (clamped to 1..100), maps decoded."""
    out = log
    if start is not None:
        out = out.where(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out.where(F.col(ts) <= F.lit(end).cast("timestamp_ntz"))
    if kind is not None:
        out = out.where(F.col("prediction_type") == kind)
    newest = out.orderBy(F.desc(ts), *[F.col(c) for c in log.columns if c == "id"]).limit(max(1, min(100, limit)))
    for c in ("class_probabilities", "probability_distribution"):
        if c in log.columns:
            newest = newest.withColumn(c, F.from_json(c, "map<string,double>"))
    return newest
