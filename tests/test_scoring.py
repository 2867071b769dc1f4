"""Scoring runs: one failing model leaves the others whole; backtests see no row twice."""

import datetime as dt

from pyspark.sql import functions as F

from fluxloom.operators import scoring, survival

BASE = dt.datetime(2024, 1, 1)
BASELINE = [(float(h), float(h), 0.004 * h, float(h + 1), 0.004 * (h + 1)) for h in range(survival.HORIZON + 1)]


class Failing(survival.CoxModel):
    """Its plan can be built; its job fails."""

    def hazard(self, df, output="hazard_score"):
        broken = F.udf(lambda x: 1 / 0, "double")
        return df.withColumn(output, broken("a"))


def rows(spark):
    return spark.createDataFrame([(BASE + dt.timedelta(hours=12 * i), float(i % 5)) for i in range(60)], "timestamp timestamp_ntz, a double")


def test_models_that_fail_leave_the_others_whole(spark):
    good = survival.CoxModel(["a"], [2.0], [0.3], BASELINE)
    models = {"good": good, "missing": survival.CoxModel(["b"], [0.0], [1.0], BASELINE), "failing": Failing(["a"], [2.0], [0.3], BASELINE)}
    df = rows(spark)
    out = scoring.score_all(df, {}, {k: (m, df) for k, m in models.items()}).collect()
    want = {r.timestamp: r.hazard_score for r in good.hazard(df).collect()}
    assert len(out) == 60 and all(r.hazard_score_good == want[r.timestamp] and r.error_good is None for r in out)
    assert all(r.hazard_score_missing is None and "missing columns" in r.error_missing for r in out)
    assert all(r.hazard_score_failing is None and "division by zero" in r.error_failing for r in out)


def test_split_backtest_fits_and_tests_apart(spark):
    seen = []

    def fit(part):
        seen.append(part.agg(F.max("timestamp"), F.count("*")).first())
        return survival.CoxModel(["a"], [2.0], [0.3], BASELINE)

    actuals = spark.createDataFrame([(BASE + dt.timedelta(hours=h),) for h in (10, 500, 560)], "peak_time timestamp_ntz")
    _, metrics = scoring.split_backtest(fit, rows(spark), actuals, since="2024-01-15 00:00:00", window_hours=24)
    assert tuple(seen[0]) == (BASE + dt.timedelta(days=7), 15)
    got = metrics.first().asDict()
    starts = [12 * i for i in range(60) if 12 * i >= 14 * 24]
    assert got["n_predictions"] == len(starts) and got["n_hits"] == sum(any(t <= h <= t + 24 for h in (500, 560)) for t in starts)
