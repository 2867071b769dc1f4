"""Range aggregation, medians and orderings against brute force, with hot keys and bursts."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxloom.operators import features, grids, labels
from fluxloom.plans.ordering import carried_values, running_index, running_sums, with_previous
from fluxloom.plans.quantiles import column_quantiles, range_medians
from fluxloom.plans.ranges import Part, range_aggregate, window_join

BASE = dt.datetime(2024, 1, 1)


def samples(seed, n=400, span=3_000):
    """A series where one key has most rows and a third of all rows fall in one short burst."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.7 else rng.choice("abc")
        us = rng.randrange(1000, 1040) if rng.random() < 0.33 else rng.randrange(-span, span)
        rows.append((key, us, None if rng.random() < 0.2 else round(rng.gauss(0, 5), 1)))
    return rows


@pytest.mark.parametrize("seed,base,fan", [(1, 7, 3), (2, 50, 6), (3, 1, 2), (4, 10_000, 6)])
def test_range_aggregate(spark, seed, base, fan):
    rows = samples(seed)
    rng = random.Random(seed + 100)
    ranges = []
    for i in range(150):
        lo = rng.randrange(-3200, 3000)
        ranges.append((rng.choice(["hot", "a", "b", "none"]), i, lo, lo + rng.choice([-1, 0, 5, 100, 977, 4000])))
    parts = [
        Part("n", "cast(v is not null as bigint)", "sum"), Part("s", "v", "sum"), Part("m", "v", "max"),
        Part("u", "case when v is not null then us end", "max"), Part("l", "v", "last_by", "u"),
        Part("x", "case when v is not null then cast(us - origin as double) end", "sum", lift=lambda d: F.col("x") + F.col("n") * d),
    ]
    out = range_aggregate(
        spark.createDataFrame(ranges, "k string, id int, lo bigint, hi bigint"), spark.createDataFrame(rows, "k string, us bigint, v double"),
        keys=["k"], group=["id"], parts=parts, base=base, longest=4000, fan=fan,
        finals=[F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("s").alias("s"), F.max("m").alias("m"), F.max_by("l", "u").alias("l"),
                F.expr("sum(x + n * origin)").alias("x")],
    )
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == len(ranges)
    for key, i, lo, hi in ranges:
        inside = [(u, v) for k, u, v in rows if k == key and lo <= u <= hi and v is not None]
        r = got[i]
        assert r["n"] == len(inside)
        if inside:
            assert r["s"] == pytest.approx(sum(v for _, v in inside))
            assert r["m"] == max(v for _, v in inside)
            assert r["l"] in [v for u, v in inside if u == max(inside)[0]]
            assert r["x"] == pytest.approx(sum(u for u, _ in inside))
        else:
            assert r["s"] is None and r["m"] is None


def test_range_medians(spark):
    rows = samples(9) + [("hot", 1001, 2.5)] * 40
    ranges = [("hot", i, lo, lo + w) for i, (lo, w) in enumerate((lo, w) for lo in range(-3000, 3000, 400) for w in (0, 60, 900, 3000))]
    out = range_medians(
        spark.createDataFrame(ranges, "k string, id int, lo bigint, hi bigint"), spark.createDataFrame(rows, "k string, us bigint, v double"),
        keys=["k"], group=["id"], value="v", base=25, longest=3000,
    )
    got = {r["id"]: r["median"] for r in out.collect()}
    for key, i, lo, hi in ranges:
        inside = [v for k, u, v in rows if k == key and lo <= u <= hi and v is not None]
        assert (i in got) == bool(inside)
        if inside:
            assert got[i] == pytest.approx(np.median(inside))


@pytest.mark.parametrize("kind", ["constant", "narrow", "mixed", "twins"])
def test_range_medians_of_crowded_bins(spark, kind):
    rng = np.random.default_rng(2)
    values = {
        "constant": np.full(600, 3e-7),
        "narrow": 5e-6 * (1 + 0.004 * rng.random(600)),
        "mixed": np.r_[-2e-6 * (1 + 1e-9 * rng.random(200)), np.zeros(200), 4e-6 * (1 + 1e-13 * rng.integers(0, 5, 200))],
        "twins": np.repeat(1.0 + np.arange(6) * 2.0**-52, 100),  # their logarithms are equal
    }[kind]
    rng.shuffle(values)
    rows = [("k", i, float(v)) for i, v in enumerate(values)]
    ranges = [("k", i, lo, lo + w) for i, (lo, w) in enumerate((lo, w) for lo in range(-100, 600, 70) for w in (10, 101, 450))]
    out = range_medians(
        spark.createDataFrame(ranges, "k string, id int, lo bigint, hi bigint"), spark.createDataFrame(rows, "k string, us bigint, v double"),
        keys=["k"], group=["id"], value="v", base=16, longest=450, direct=8,
    )
    got = {r["id"]: r["median"] for r in out.collect()}
    want = {i: float(np.median(inside)) for _, i, lo, hi in ranges if (inside := [v for _, u, v in rows if lo <= u <= hi])}
    assert got == want


def test_orderings(spark):
    rows = [(k, u, v, i) for i, (k, u, v) in enumerate(samples(5))]
    df = spark.createDataFrame(rows, "k string, us bigint, v double, id int")
    by_key = {}
    for k, u, v, i in sorted(rows, key=lambda r: (r[0], r[1], r[3])):
        by_key.setdefault(k, []).append((u, v, i))
    index = {r["id"]: r["idx"] for r in running_index(df, ["us", "id"], ["k"], chunks=7).collect()}
    sums = {r["id"]: r["total"] for r in running_sums(df, ["us", "id"], {"total": F.col("us")}, ["k"], chunks=7).collect()}
    before = {r["id"]: r["prev"] for r in with_previous(df, "us", ["k"], tie=["id"], chunks=7).collect()}
    fill = {r["id"]: r["_fill_v"] for r in carried_values(df, ["us", "id"], ["v"], ["k"]).collect()}
    back = {r["id"]: r["_fill_v"] for r in carried_values(df, ["us", "id"], ["v"], ["k"], backward=True).collect()}
    for series in by_key.values():
        total, last = 0, None
        for n, (u, v, i) in enumerate(series):
            total += u
            last = v if v is not None else last
            assert (index[i], sums[i], fill[i]) == (n, total, last)
            assert before[i] == (series[n - 1][0] if n else None)
            assert back[i] == next((w for _, w, _ in series[n:] if w is not None), None)


def test_column_quantiles(spark):
    values = [random.Random(3).gauss(0, 1) for _ in range(301)]
    df = spark.createDataFrame([(v, float(i % 3)) for i, v in enumerate(values)], "a double, b double")
    got = {(r["column_name"], r["probability"]): r["value"] for r in column_quantiles(df, ["a", "b"], [0.0, 0.25, 0.5, 1.0]).collect()}
    for p in (0.0, 0.25, 0.5, 1.0):
        assert got[("a", p)] == pytest.approx(np.quantile(values, p))
        assert got[("b", p)] == pytest.approx(np.quantile([float(i % 3) for i in range(301)], p))


def flux_line(spark):
    rows = [("s", BASE + dt.timedelta(hours=i), 1e-9 + (1e-7 - 1e-9) * i / 11, 1e-8 + (1e-6 - 1e-8) * i / 11) for i in range(12)]
    return spark.createDataFrame(rows, "k string, timestamp timestamp_ntz, flux_short double, flux_long double")


def at(spark, hours):
    return spark.createDataFrame([("s", BASE + dt.timedelta(hours=h)) for h in hours], "k string, timestamp timestamp_ntz")


def test_straight_line(spark):
    flux, grid = flux_line(spark), at(spark, [11])
    rate = features.rate_of_change(grid, flux, keys=["k"]).first()
    assert rate["flux_short_rate_of_change"] == pytest.approx((1e-7 - 1e-9) / 11)
    assert features.acceleration(grid, flux, keys=["k"]).first()["flux_long_acceleration"] == pytest.approx(0, abs=1e-18)
    slope = features.flux_covariates(grid, flux, keys=["k"]).first()
    assert slope["flux_long_trend_6h"] == pytest.approx((1e-6 - 1e-8) / 11, rel=1e-9)
    assert features.index_trend(grid, flux, keys=["k"]).first()["flux_trend_short"] == pytest.approx((1e-7 - 1e-9) / 11, rel=1e-9)


def test_empty_and_single_windows(spark):
    flux = flux_line(spark)
    got = {r["timestamp"].hour + 24 * (r["timestamp"].day - 1): r for r in features.rolling_stats(at(spark, [0, 200]), flux, ["flux_long"], windows=[6], functions=["mean", "std", "count", "median"], keys=["k"]).collect()}
    assert got[0]["flux_long_6h_count"] == 1 and got[0]["flux_long_6h_std"] is None and got[0]["flux_long_6h_median"] == pytest.approx(1e-8)
    assert got[200]["flux_long_6h_count"] == 0 and got[200]["flux_long_6h_mean"] is None


def test_constant_series_has_no_spread(spark):
    rows = [("s", BASE + dt.timedelta(minutes=i), 0.1 + 1e-3, 3.3e-7) for i in range(300)]
    flux = spark.createDataFrame(rows, "k string, timestamp timestamp_ntz, flux_short double, flux_long double")
    got = features.rolling_stats(at(spark, [5]), flux, ["flux_short", "flux_long"], windows=[6], functions=["std"], keys=["k"]).first()
    assert got["flux_short_6h_std"] == 0 and got["flux_long_6h_std"] == 0


def test_no_keys_equals_keyed(spark):
    flux = flux_line(spark)
    grid = at(spark, [3, 7, 11])
    keyed = features.rolling_stats(grid, flux, ["flux_long"], windows=[6], functions=["mean", "max"], keys=["k"]).drop("k")
    plain = features.rolling_stats(grid.drop("k"), flux.drop("k"), ["flux_long"], windows=[6], functions=["mean", "max"])
    assert sorted(map(tuple, keyed.collect())) == sorted(map(tuple, plain.collect()))


def events(spark, rows):
    full = [(BASE + dt.timedelta(hours=12 + h), BASE + dt.timedelta(hours=12 + h, minutes=15), c, m) for h, c, m in rows]
    return spark.createDataFrame(full, "start_time timestamp_ntz, peak_time timestamp_ntz, class_category string, class_magnitude double")


def test_forward_labels(spark):
    ev = events(spark, [(h, "C", 1.2) for h in range(5)] + [(10, "M", 5.5)])
    got = labels.class_labels(at(spark, [12]).drop("k"), ev).first()
    assert (got["label_24h"], got["num_flares_24h"], got["max_magnitude_24h"], got["flare_classes_24h"]) == ("M", 6, 5.5, "C,M")


def test_survival_labels(spark):
    ev = events(spark, [(48, "X", 2.1), (120, "X", 1.5)])
    got = {r["timestamp"]: (r["duration"], r["event"]) for r in labels.survival_labels(at(spark, [12, 60, 212]).drop("k"), ev).collect()}
    base = BASE + dt.timedelta(hours=12)
    assert got[base] == (48.0, 1)
    assert got[base + dt.timedelta(hours=48)] == (72.0, 1)  # strictly after
    assert got[base + dt.timedelta(hours=200)] == (168.0, 0)


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_make_no_pairs(spark, data):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        from fluxloom.queries.registry import QUERIES
        import fluxloom.queries.catalog  # noqa: F401

        for name in ("w1_rolling_stats", "w9_flux_covariates", "w12_forward_labels", "j1_window_join", "j3_next_event", "j9_match_predictions"):
            text = plan_text(QUERIES[name](spark, data))
            assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text, name
            assert "SinglePartition" not in text, name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_window_join_counts_each_pair_once(spark):
    rows = samples(11)
    g = spark.createDataFrame([("hot", t) for t in range(-3000, 3000, 97)], "k string, grid_us bigint")
    got = window_join(g, spark.createDataFrame(rows, "k string, us bigint, v double"), keys=["k"], before_us=250, after_us=30).count()
    assert got == sum(1 for t in range(-3000, 3000, 97) for k, u, _ in rows if k == "hot" and t - 250 <= u <= t + 30)


def test_grids(spark):
    flux = flux_line(spark)
    assert grids.sampled_grid(flux, keys=["k"], every=5).count() == 3
    bounds = grids.coverage_bounds(flux, keys=["k"])
    assert grids.regular_grid(bounds, keys=["k"], hours=6).count() == 2
