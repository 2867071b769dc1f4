"""Detection, de-duplication, upserts and metrics against hand cases and brute force."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fluxloom.operators import classify, events, metrics, monitor, prep, reports, survival
from fluxloom.plans.chains import spaced_anchors
from fluxloom.session import scratch, staging_path
from fluxloom.sources import tables

BASE = dt.datetime(2024, 1, 1)


def minute(m):
    return BASE + dt.timedelta(minutes=m)


def event_frame(spark, rows):
    return spark.createDataFrame([(i, minute(m), "M", float(g)) for i, (m, g) in enumerate(rows)], "event_id int, peak_time timestamp_ntz, class_category string, class_magnitude double")


def test_merge_close_events(spark):
    out = events.merge_close_events(event_frame(spark, [(0, 1.0), (50, 2.0), (100, 3.0), (170, 1.0)]))
    assert [r["class_magnitude"] for r in out.orderBy("peak_time").collect()] == [2.0, 3.0, 1.0]


def test_dedupe_append(spark):
    batch = event_frame(spark, [(m, 1.0) for m in (0, 20, 40, 55, 80)])
    none = batch.where("false")
    got = lambda out: sorted(int((r["peak_time"] - BASE).total_seconds() // 60) for r in out.collect())
    assert got(events.dedupe_append(none, batch)) == [0, 40, 80]
    stored = events.dedupe_append(none, batch)
    assert events.dedupe_append(stored, batch).count() == 0  # appending twice changes nothing


@pytest.mark.parametrize("limit", [1, 5, 10_000])
def test_anchors_by_fold_and_by_doubling(spark, limit):
    rng = random.Random(limit)
    rows = [(k, t) for k in "ab" for t in sorted(rng.sample(range(3000), 200 if k == "a" else 40))]
    got = {}
    for r in spaced_anchors(spark.createDataFrame(rows, "k string, us bigint"), keys=["k"], gap_us=60, fold_limit=limit).collect():
        got.setdefault(r["k"], []).append(r["us"])
    for k in "ab":
        want, last = [], None
        for t in (t for kk, t in rows if kk == k):
            if last is None or t > last + 60:
                want.append(t)
                last = t
        assert sorted(got[k]) == want


def brute_peaks(v, floor, drop, spacing):
    """Straight reading of the rule over one whole series."""
    n, at = len(v), []
    i = 1
    while i < n - 1:
        if v[i - 1] < v[i]:
            j = i
            while j + 1 < n and v[j + 1] == v[i]:
                j += 1
            if j + 1 < n and v[j + 1] < v[i]:
                at.append((i + j) // 2)
            i = j
        i += 1
    at = [i for i in at if v[i] >= floor]
    alive = dict.fromkeys(at, True)
    for i in sorted(at, key=lambda i: (v[i], i), reverse=True):
        if alive[i]:
            for j in at:
                if j != i and abs(i - j) < spacing:
                    alive[j] = False
    out = []
    for i in (i for i in at if alive[i]):
        lo = i
        while lo > 0 and v[lo - 1] <= v[i]:
            lo -= 1
        hi = i
        while hi < n - 1 and v[hi + 1] <= v[i]:
            hi += 1
        prominence = v[i] - max(min(v[lo : i + 1]), min(v[i : hi + 1]))
        if prominence < drop:
            continue
        level = v[i] - prominence / 2
        a = i
        while a > lo and v[a] > level:
            a -= 1
        b = i
        while b < hi and v[b] > level:
            b += 1
        left = a + (level - v[a]) / (v[a + 1] - v[a]) if v[a] < level else a
        right = b - (level - v[b]) / (v[b - 1] - v[b]) if v[b] < level else b
        if right - left >= 1:
            out.append(i)
    return out


@pytest.mark.parametrize("core", [40])
def test_local_peaks(spark, core):
    rng = np.random.default_rng(core)
    series = {
        "noise": rng.exponential(4e-6, 500),
        "steps": np.round(rng.exponential(4e-6, 300), 6),  # many equal neighbours
        "slow": 5e-6 + 4e-6 * np.sin(np.arange(700) / 90) + rng.normal(0, 2e-8, 700),  # far look-around
        "flat": np.r_[np.full(150, 2e-6), np.full(30, 5e-6), np.full(200, 2e-6), np.full(9, 6e-6), np.full(80, 1e-6)],
        "ramp": 2e-6 + np.arange(900) * 1e-8 + np.tile([0, 3e-7], 450),  # every candidate hangs on the next one
        "stairs": np.r_[np.linspace(1e-6, 9e-6, 90) + np.tile([0, 3e-7], 45), np.linspace(9e-6, 1e-6, 60)],
    }
    rows = [(k, BASE + dt.timedelta(minutes=i), float(x)) for k, v in series.items() for i, x in enumerate(v)]
    flux = spark.createDataFrame(rows, "k string, timestamp timestamp_ntz, flux_long double")
    got = {}
    for r in events.local_peaks(flux, keys=["k"], core=core).collect():
        got.setdefault(r["k"], []).append(r["idx"])
    for k, v in series.items():
        assert sorted(got.get(k, [])) == brute_peaks(list(map(float, v)), 1e-6, 1e-7, 10), k


def test_event_edges_at_the_series_end(spark):
    values = [1e-8, 1e-8, 5e-6, 4e-6, 6e-6]
    flux = spark.createDataFrame([(minute(i), v) for i, v in enumerate(values)], "timestamp timestamp_ntz, flux_long double")
    peaks = spark.createDataFrame([(2, 5e-6), (4, 6e-6)], "idx bigint, v double")
    got = {r["idx"]: (r["start_time"], r["end_time"]) for r in events.event_edges(flux, peaks).collect()}
    assert got[2] == (minute(1), minute(3))  # the last sample is out of reach
    assert got[4] == (minute(1), minute(4))  # a peak on the last sample ends there


def test_upsert_is_idempotent(spark):
    schema = "timestamp timestamp_ntz, v double, seq int"
    path = staging_path(spark, "t")
    first = spark.createDataFrame([(minute(0), 1.0, 0), (minute(2000), 2.0, 0)], schema)
    second = spark.createDataFrame([(minute(0), 5.0, 1), (minute(0), 4.0, 0), (minute(9), 9.0, 0)], schema)
    for load in (first, second, second):
        tables.write_upsert(spark, path, load, keys=["timestamp"], order=["seq"], drop=["seq"])
    got = {r["timestamp"]: r["v"] for r in spark.read.parquet(path).collect()}
    assert got == {minute(0): 5.0, minute(9): 9.0, minute(2000): 2.0}
    stats = tables.upsert_stats(first, second, keys=["timestamp"]).first()
    assert tuple(stats) == (3, 1, 1)


def test_upsert_moves_a_key_to_another_day(spark):
    schema = "external_id string, timestamp timestamp_ntz, v double, seq int"
    path = staging_path(spark, "t")
    late, early = dt.datetime(2024, 1, 1, 23, 58), dt.datetime(2024, 1, 2, 0, 3)
    first = spark.createDataFrame([("a", late, 1.0, 0), ("b", early, 2.0, 0)], schema)
    second = spark.createDataFrame([("a", early, 3.0, 1)], schema)
    for load in (first, second, second):
        tables.write_upsert(spark, path, load, keys=["external_id"], order=["seq"], drop=["seq"])
    got = sorted(tuple(r) for r in spark.read.parquet(path).select("external_id", "timestamp", "v").collect())
    assert got == [("a", early, 3.0), ("b", early, 2.0)]


def test_nan_flux_is_missing(spark):
    rows = spark.createDataFrame([(1e-7, float("nan"), None), (float("nan"), 2e-6, "G16")], "flux_short double, flux_long double, satellite string")
    got = [tuple(r) for r in tables.coerce_flux(rows).select("flux_short", "flux_long", "data_quality", "satellite").collect()]
    assert got == [(1e-7, None, "missing", "unknown"), (None, 2e-6, "good", "G16")]


def test_saved_calibration_comes_back(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=240)
    df = spark.createDataFrame([(i, float(v), "abc"[int(v + rng.normal() > 0) + int(v > 1)]) for i, v in enumerate(x)], "id int, x double, label string")
    fit = classify.fitter("logistic")
    model = fit(df, "label", ["x"])
    for method in ("isotonic", "sigmoid"):
        better = classify.calibrate(model, df, "label", "id", fit, method=method)
        path = staging_path(spark, "model")
        better.save(path, spark)
        back = classify.ClassModel.load(path, spark)
        want, got = ([r["_p"] for r in m.probabilities(df).orderBy("id").collect()] for m in (better, back))
        assert got == want and got != [r["_p"] for r in model.probabilities(df).orderBy("id").collect()]


def test_concordance(spark):
    rng = random.Random(4)
    rows = [(float(rng.randrange(12)), rng.randrange(2), float(rng.randrange(20))) for _ in range(120)]
    pairs = wins = ties = 0
    for i, (d, e, s) in enumerate(rows):
        for j, (d2, e2, s2) in enumerate(rows):
            if i != j and e == 1 and (d2 > d or (d2 == d and e2 == 0)):
                pairs += 1
                wins += s > s2
                ties += s == s2
    got = metrics.concordance(spark.createDataFrame(rows, "duration double, event int, score double")).first()
    assert (got["pairs"], got["concordant"], got["ties"]) == (pairs, wins, ties)


def test_auc_and_brier_hand_case(spark):
    rows = [(0, 0.8, 0.1, 0.1), (1, 0.2, 0.7, 0.1), (2, 0.1, 0.2, 0.7), (0, 0.9, 0.05, 0.05), (1, 0.1, 0.8, 0.1)]
    df = spark.createDataFrame(rows, "y int, a double, b double, c double")
    auc = {r["class_name"]: r["auc"] for r in metrics.roc_auc(df, "y", {"0": "a", "1": "b", "2": "c"}).collect()}
    assert auc == {"0": 1.0, "1": 1.0, "2": 1.0, "macro_avg": 1.0}
    one = {r["class_name"]: r["auc"] for r in metrics.roc_auc(df.where("y < 2"), "y", {"0": "a", "2": "c"}).collect()}
    assert one["2"] is None and one["macro_avg"] == 1.0  # absent class


def numpy_cox(d, e, x, ridge, n_steps=60):
    mean, std = x.mean(0), x.std(0, ddof=1)
    z, beta = (x - mean) / std, np.zeros(x.shape[1])
    for _ in range(n_steps):
        w = np.exp(z @ beta)
        g, h = -ridge * len(d) * beta, -ridge * len(d) * np.eye(x.shape[1])
        for t in np.unique(d[e == 1]):
            at, died = d >= t, (d == t) & (e == 1)
            m = died.sum()
            g = g + z[died].sum(0)
            for k in range(m):
                wk = w * at - k / m * w * died
                s0, s1 = wk.sum(), wk @ z
                g = g - s1 / s0
                h = h - ((z * wk[:, None]).T @ z / s0 - np.outer(s1, s1) / s0**2)
        beta = beta - np.linalg.solve(h, g)
    return beta / std


def test_cox_matches_direct_newton(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 2)) * [1.0, 3.0] + [0.0, 5.0]
    life = rng.exponential(30 / np.exp(0.8 * x[:, 0] - 0.2 * (x[:, 1] - 5)))
    d = np.minimum(np.ceil(life), 40.0)
    e = (life <= 40).astype(int)
    df = spark.createDataFrame([(float(a), int(b), float(c), float(f), 1.0) for a, b, (c, f) in zip(d, e, x)], "duration double, event int, x0 double, x1 double, flat double")
    model = survival.fit_cox(df, ["x0", "x1", "flat"])
    assert model.converged and model.columns == ["x0", "x1"]  # the constant column is left out
    assert model.beta == pytest.approx(numpy_cox(d, e, x, 0.1).tolist(), abs=1e-5)
    curve = model.curve(df.limit(5)).select("curve").collect()
    for row in curve:
        s = [p["s"] for p in row["curve"]]
        assert len(s) == 169 and s[0] == 1.0 and all(a >= b - 1e-12 for a, b in zip(s, s[1:]))
    path = staging_path(spark, "cox")
    model.save(path, spark)
    assert survival.CoxModel.load(path, spark).beta == model.beta
    with pytest.raises(ValueError):
        model.hazard(df.drop("x0"))


def test_cox_at_full_width(spark):
    rng = np.random.default_rng(3)
    names = [f"x{i}" for i in range(60)]
    x = rng.normal(size=(300, 60))
    life = rng.exponential(20 / np.exp(0.5 * x[:, 0] - 0.4 * x[:, 7]))
    d, e = np.minimum(np.ceil(life / 2), 20.0), (life <= 40).astype(int)
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(duration=d, event=e))
    model = survival.fit_cox(df, names)
    assert model.converged
    assert model.beta == pytest.approx(numpy_cox(d, e, x, 0.1, n_steps=8).tolist(), abs=1e-6)


@pytest.mark.parametrize("ties", ["efron", "breslow"])
def test_cox_with_100000_ties(spark, ties):
    rng = np.random.default_rng(4)
    n = 260_000
    x = rng.normal(size=(n, 2))
    d = np.where(rng.random(n) < 1 / (1 + np.exp(-x[:, 0])), 1.0, 2.0)
    e = (rng.random(n) < 0.9).astype(int)
    model = survival.fit_cox(spark.createDataFrame(pd.DataFrame({"duration": d, "event": e, "a": x[:, 0], "b": x[:, 1]})), ["a", "b"], ties=ties)
    assert model.converged and ((d == 1) & (e == 1)).sum() > 100_000
    # the score equation holds at the reported coefficients
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    beta = np.array(model.beta) * x.std(0, ddof=1)
    w = np.exp(z @ beta)
    score = -0.1 * n * beta
    for t in (1.0, 2.0):
        at, died = d >= t, (d == t) & (e == 1)
        s = np.arange(died.sum()) / died.sum() if ties == "efron" else np.zeros(died.sum())
        v = w[at].sum() - s * w[died].sum()
        score = score + z[died].sum(0) - (1 / v).sum() * (w[at] @ z[at]) + (s / v).sum() * (w[died] @ z[died])
    assert np.abs(score).max() / n < 1e-9


def test_nan_is_missing_in_preparation(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, 1.0, nan), (2, nan, nan), (3, None, nan), (4, 3.0, 5.0)], "id int, a double, b double")
    values = lambda out, c: [r[c] for r in out.orderBy("id").collect()]
    assert values(prep.impute(df, "mean", ["a", "b"]), "a") == [1.0, 2.0, 2.0, 3.0]
    assert values(prep.impute(df, "median", ["a", "b"]), "b") == [5.0] * 4
    assert values(prep.impute(df, "forward_fill", ["a"], order_by=["id"]), "a") == [1.0, 1.0, 1.0, 3.0]
    assert values(prep.impute(df, "constant", ["a"], fill_value=7.0), "a") == [1.0, 7.0, 7.0, 3.0]
    assert [r["id"] for r in prep.impute(df, "drop", ["a"]).orderBy("id").collect()] == [1, 4]
    assert values(prep.scale(df, ["a"], "minmax"), "a") == pytest.approx([1 / 3, 0.0, 0.0, 1.0])
    assert prep.sparse_columns(df, ["a", "b"]) == ["b"]
    assert prep.varying_columns(df, ["a", "b"]) == ["a"]


def test_rows_without_label_are_kept(spark):
    df = spark.createDataFrame([(i, None if i < 10 else "a" if i < 30 else "b") for i in range(40)], "id int, label string")
    weights = {(r["label"], round(r["weight"], 12)) for r in prep.class_weights(df, "label").collect()}
    assert weights == {(None, round(40 / 30, 12)), ("a", round(40 / 60, 12)), ("b", round(40 / 30, 12))}
    split = prep.stratified_split(df, "label", "id")
    assert {(r["label"], r["n"]) for r in split.where("is_test").groupBy("label").agg(F.count("*").alias("n")).collect()} == {(None, 2), ("a", 4), ("b", 2)}
    assert split.count() == 40


def test_nan_is_missing_in_monitoring(spark):
    nan = float("nan")
    df = spark.createDataFrame([(i, float(i % 20)) for i in range(60)], "id int, a double")
    holed = df.unionByName(spark.createDataFrame([(i, nan) for i in range(100, 140)], "id int, a double"))
    tests = [monitor.ks_drift(monitor.drift_reference(x, ["a"], ["id"]), monitor.long_form(x, ["a"])).collect() for x in (df, holed)]
    assert tests[0] == tests[1]
    assert {r["column_name"]: r["missing"] for r in reports.missing_profile(holed, ["a"]).collect()} == {"*": 40, "a": 40}


def test_two_classes_share_one_boosted_model(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-5, 5, size=200) + 0.5  # fewer values than bins, so that a split can fall exactly between the classes
    df = spark.createDataFrame(pd.DataFrame({"id": range(200), "label": np.where(x > 0, "up", "down"), "x": x}))
    model = classify.fit_gbt(df, "label", ["x"], trees=3)
    assert model.classes == ["down", "up"] and len(model.parts) == 1
    path = staging_path(spark, "boosted")
    model.save(path, spark)
    for m in (model, classify.ClassModel.load(path, spark)):
        rows = m.probabilities(df).select("x", "_p").collect()
        assert all(abs(sum(r["_p"]) - 1) < 1e-12 and (r["_p"][1] > 0.5) == (r["x"] > 0) for r in rows)


def test_smote_balances_classes(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "big" if i < 60 else "small", float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(80, 2)))]
    df = spark.createDataFrame(rows, "id bigint, label string, a double, b double")
    made = prep.smote(df, "label", "id", ["a", "b"], block_rows=7).collect()
    assert len(made) == 40 and {r["label"] for r in made} == {"small"}
    pts = np.array([r[2:] for r in rows if r[1] == "small"])
    for r in made:  # on a segment between a row and one of its five nearest
        p = np.array([r["a"], r["b"]])
        ok = False
        for i in range(len(pts)):
            for j in np.argsort(((pts - pts[i]) ** 2).sum(1))[1:6]:
                v = pts[j] - pts[i]
                t = (p - pts[i]) @ v / (v @ v)
                ok |= -1e-9 <= t <= 1 + 1e-9 and np.allclose(pts[i] + t * v, p, atol=1e-9)
        assert ok


def test_neighbours_are_exact_and_most_cells_are_left_out(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 3)) * 100
    pts = np.r_[(centres[rng.integers(0, 30, 900)] + rng.normal(size=(900, 3))).round(3), np.tile([[1.0, 2.0, 3.0]], (40, 1))]  # clusters and copies
    rows = [("a" if i % 9 else "b", i, [float(v) for v in p], i % 2 == 0) for i, p in enumerate(pts)]
    sizes = {c: sum(r[0] == c for r in rows) for c in "ab"}
    seen = {c: 0 for c in "ab"}
    given = []
    for c, i, v, s in rows:
        given.append((c, i, v, s, sizes[c], seen[c]))
        seen[c] += 1
    df = spark.createDataFrame(given, "label string, id bigint, vec array<double>, seeds boolean, _n bigint, _i bigint").repartition(3)
    with scratch() as cuts:
        got = {(r["label"], r["id"]): [(x["other"], x["dist"]) for x in r["near"]] for r in prep.class_neighbours(df, k=4, block_rows=50, cuts=cuts).collect()}
    assert set(got) == {(c, i) for c, i, _, s in rows if s}
    for (c, i), near in got.items():
        d = sorted((float(((pts[i] - pts[j]) ** 2).sum()), j) for cc, j, _, _ in rows if cc == c and j != i)[:4]
        assert [j for j, _ in near] == [j for _, j in d] and np.allclose([x for _, x in near], [x for x, _ in d])
    # visited: a seed's own cell, and the few cells that reach into its four best
    far = prep._to_pivots({"x": pts[:31]}, "x", pts[:900])
    cell = far.argmin(axis=1)
    radius = np.array([far[cell == j, j].max(initial=-np.inf) for j in range(31)])
    best = np.array([np.sort(((pts[i] - pts[:900][cell == cell[i]]) ** 2).sum(1))[min(4, (cell == cell[i]).sum() - 1)] ** 0.5 for i in range(900)])
    visited = (far - radius[None, :] <= best[:, None]).sum(axis=1)
    assert visited.mean() < 31 / 3


def test_missing_data_frame(spark):
    rows = [(1, 1.0, 10.0, None), (2, 2.0, None, None), (3, None, 30.0, None), (4, 4.0, 40.0, None), (5, 5.0, 50.0, None)]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double")
    kept = prep.drop_sparse(df, ["a", "b", "c"])
    assert kept.columns == ["i", "a", "b"]
    got = [tuple(r)[1:] for r in prep.impute(kept, "mean", ["a", "b"]).orderBy("i").collect()]
    assert got == [(1.0, 10.0), (2.0, 32.5), (3.0, 30.0), (4.0, 40.0), (5.0, 50.0)]


def test_drift_tests(spark):
    rng = np.random.default_rng(3)
    frame = lambda v: spark.createDataFrame([("f", float(x)) for x in v], "feature string, value double")
    a, b = np.round(rng.normal(0, 1, 300), 2), np.round(rng.normal(0.5, 1, 200), 2)
    got = monitor.ks_drift(frame(a), frame(b)).first()
    grid = np.union1d(a, b)
    d = max(abs((a <= g).mean() - (b <= g).mean()) for g in grid)
    assert got["statistic"] == pytest.approx(d) and got["drift_detected"]
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert monitor.rank_drift(frame(a), frame(b)).first()["statistic"] == pytest.approx(u)
    same = monitor.ks_drift(frame(a), frame(a)).first()
    assert same["p_value"] == 1.0 and not same["drift_detected"]
    assert monitor.ks_drift(frame(a[:9]), frame(b)).count() == 0  # too little reference


def test_guardrail_reasons(spark):
    df = spark.createDataFrame([(0.0, 0.0, [1.0, 1.0]), (0.5, 1.0, [1.0, 0.005, 0.0]), (0.5, 1.0, [1.0, 0.05, 0.04]), (2.0, 1.0, [1.0, 0.9, 0.5])], "p double, h double, c array<double>")
    got = [r[0] for r in df.select(monitor.survival_reasons(F.create_map(F.lit("0h-6h"), F.col("p")), F.col("h"), F.col("c"))).collect()]
    assert got == [[monitor.ZERO], [monitor.COLLAPSE], [monitor.DROP], [monitor.HIGH]]
