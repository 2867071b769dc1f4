"""Hand-computed scalar cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fluxloom.functions import classes, curves, magnetic, status, timing


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_flux_to_class(spark):
    got = column(spark, [2.1e-4, 5.5e-5, 1.2e-6, 5e-8, 9.96e-6, None], "double", classes.class_label("x"))
    assert got == ["X2.1", "M5.5", "C1.2", "B0.5", "C10.0", None]


def test_class_text(spark):
    letter, size = classes.parsed_class("x")
    got = column(spark, ["M2.5", "X1.0", "B5.6", "", None, "invalid", "m1"], "string", F.struct(letter.alias("a"), size.alias("b")))
    assert [tuple(r) for r in got] == [("M", 2.5), ("X", 1.0), ("B", 5.6), (None, None), (None, None), (None, None), ("M", 1.0)]


def test_sunspot_score(spark):
    got = column(spark, ["Dkc", None, "", "B"], "string", magnetic.sunspot_score("x"))
    assert got == pytest.approx([0.5, 0.0, 0.0, 2 / 8 * 0.4])
    size, shape, third = magnetic.sunspot_codes("x")
    assert tuple(column(spark, ["Dkc"], "string", F.struct(size, shape, third))[0]) == (4, 5, 0)


def test_magnetic(spark):
    got = column(spark, ["beta-gamma", "beta-gamma-delta", None, "alpha", "beta", "gamma", "delta"], "string", magnetic.magnetic_score("x"))
    assert got == [1.0, 1.0, 0.0, 0.25, 0.5, 0.75, 1.0]
    assert column(spark, ["Beta-Gamma", "alpha", "", None], "string", magnetic.magnetic_complexity("x")) == ["beta-gamma", "alpha", "unknown", "unknown"]
    assert column(spark, ["beta-gamma", "alpha", "", None], "string", magnetic.polarity("x")) == ["mixed", "unknown", "unknown", "unknown"]


def test_time_texts_do_not_depend_on_the_session_zone(spark):
    texts = [
        "2024-01-01T12:00Z", "2024-01-01T12:00:00Z", "", "invalid", None, "2024-01-01", "2024-01-01 05:06:07.123456",
        "2024-01-01T12:00+02:00", "2024-01-01T12:00:00+0200", "2024-01-01T12:00:00.5-03", "2024", "2024-13-01T00:00Z",
    ]
    noon = dt.datetime(2024, 1, 1, 12)
    want = [
        noon, noon, None, None, None, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 5, 6, 7, 123456),
        dt.datetime(2024, 1, 1, 10), dt.datetime(2024, 1, 1, 10), dt.datetime(2024, 1, 1, 15, 0, 0, 500000), None, None,
    ]
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert column(spark, texts, "string", timing.parse_utc("x")) == want
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_bucket_probabilities(spark):
    curve = F.transform(F.sequence(F.lit(0), F.lit(168)), lambda t: F.struct(t.cast("double").alias("t"), F.exp(-t / F.col("x")).alias("s")))
    got = column(spark, [100.0], "double", curves.bucket_probabilities(curve, (0, 24, 48, 72, 96)))[0]
    assert got["0h-24h"] == pytest.approx(0.2133721, abs=1e-6)
    assert sorted(got) == ["0h-24h", "24h-48h", "48h-72h", "72h-96h"]
    assert column(spark, ["0h-6h", "24h-48h", "odd"], "string", curves.bucket_start("x")) == [0, 24, 0]


def test_load_status(spark):
    names = ["xray_flux", "solar_regions", "magnetogram", "flare_events", "donki_flares"]
    cases = {
        "all": (["success"] * 4 + ["skipped"], "success"),
        "some": (["success", "failed", "failed", "failed", "failed"], "partial"),
        "none": (["failed"] * 5, "failed"),
        "lifted": (["failed"] * 4 + ["success"], "partial"),
        "nothing": ([None] * 4 + ["skipped"], "failed"),
    }
    rows = [(run, n, s) for run, (states, _) in cases.items() for n, s in zip(names, states) if s]
    got = status.load_status(spark.createDataFrame(rows, "run_id string, source_name string, status string"))
    assert {r["run_id"]: r["overall_status"] for r in got.collect()} == {k: v[1] for k, v in cases.items()}


def test_microseconds_ignore_the_session_zone(spark):
    times = [dt.datetime(2024, 3, 10, 2, 30), dt.datetime(2024, 7, 1, 12, 0, 0, 5), dt.datetime(1969, 12, 31, 23, 59, 59, 999999), None]
    want = [None if t is None else (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1) for t in times]
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert column(spark, times, "timestamp_ntz", timing.micros("x")) == want
            assert column(spark, times, "timestamp_ntz", timing.from_micros(timing.micros("x"))) == times
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
