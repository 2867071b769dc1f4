"""Steps whose work must not grow faster than their input when rows lie close together."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from fluxloom.operators import backtest, events
from fluxloom.streaming import live

T0 = dt.datetime(2024, 1, 1)
SECOND = dt.timedelta(seconds=1)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_streams_meet_by_bucket_of_time(spark, tmp_path):
    preds = [(i, i % 2, T0 + i * 1800 * SECOND) for i in range(20)] + [(99, 0, None), (98, None, T0)]
    peaks = [(i, i % 2, T0 + i * 1800 * SECOND) for i in range(30)]
    wanted = {(p, e) for p, s, t in preds for e, z, at in peaks if t is not None and s == z and t <= at <= t + 7200 * SECOND}
    spark.createDataFrame(preds, "id long, series_id int, timestamp timestamp").write.parquet(f"{tmp_path}/p")
    spark.createDataFrame(peaks, "event_id long, series_id int, peak_time timestamp").write.parquet(f"{tmp_path}/e")
    p = live.read_landed(spark, f"{tmp_path}/p", "id long, series_id int, timestamp timestamp")
    e = live.read_landed(spark, f"{tmp_path}/e", "event_id long, series_id int, peak_time timestamp")
    joined = live.matched_outcomes(p, e, hours=2)
    assert "_bucket" in joined._jdf.queryExecution().logical().toString()
    found = [tuple(r) for r in live.collected(spark, joined, "matched").select("id", "event_id").collect()]
    assert len(found) == len(set(found)) and set(found) == wanted


def test_streams_store_runs_and_not_pairs(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(8)
    start = T0 - 3600 * SECOND
    steps = [0, 1, 3599, 3600, 7199, 7200, 7201] + [int(v) for v in rng.integers(0, 14_400, 290)]  # some at the ends of buckets and ranges
    preds = [(None if i == 5 else i, None if i == 6 else "ab"[i % 2], start + v * SECOND) for i, v in enumerate(steps)] + [(99, "a", None)]
    peaks = [(i, None if i == 4 else "ab"[i % 2], start + (v + 7200 * (i % 3)) * SECOND) for i, v in enumerate(steps)] + [(7, "a", None), (8, "c", start), (8, "a", start)]
    wanted = sorted((-1 if p is None else p, e, at) for p, s, t in preds for e, z, at in peaks if None not in (s, t, at) and s == z and t <= at <= t + 7200 * SECOND)

    def streams(name):
        kinds = {"p": "id long, series_id string, timestamp timestamp", "e": "event_id long, series_id string, peak_time timestamp"}
        for side, rows in (("p", preds), ("e", peaks)):
            for part in (rows[:100], rows[100:]):  # two files, out of order
                spark.createDataFrame(part, kinds[side]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/{side}")
        return [live.read_landed(spark, f"{tmp_path}/{name}/{side}", kinds[side], files_per_batch=1) for side in "pe"]

    def same(df):
        return sorted((-1 if r.id is None else r.id, r.event_id, r.peak_time) for r in df.select("id", "event_id", "peak_time").collect()) == wanted

    runs = live.collected(spark, live.matched_outcomes(*streams("whole"), hours=2, runs=True), "runs")
    assert runs.count() < 100 and len(wanted) > 10_000 and same(live.pairs(runs))
    monkeypatch.setattr(live, "BLOCK", 7)
    monkeypatch.setattr(live, "HELD", 60)
    monkeypatch.setattr(live, "PAIRS", 10)
    assert same(live.pairs(runs))
    assert same(live.collected(spark, live.matched_outcomes(*streams("cut"), hours=2), "matched"))


def test_outcomes_of_crowded_predictions(spark):
    log = spark.createDataFrame([(i, T0 + i * SECOND, 1 + i % 3) for i in range(300)] + [(900, None, 1), (901, T0, None)], "id long, timestamp timestamp_ntz, window_hours int")
    rows = [(T0 + s * SECOND, c) for s, c in ((0, "B"), (10, "C"), (10, "M"), (200, "M"), (3600, "X"), (3700, "C"), (7300, None))]
    happened = spark.createDataFrame(rows, "peak_time timestamp_ntz, class_category string")
    out = backtest.record_outcomes(log, happened, recorded_at=F.lit(T0), default_hours=2)
    assert "origin" not in _plan(out)  # no cells of time, in which all predictions would meet all events
    found = {r.id: (r.actual_flare_class, r.actual_flare_time) for r in out.collect()}
    rank = {"C": 1, "M": 2, "X": 3}
    for r in log.collect():
        end = None if r.timestamp is None else r.timestamp + (r.window_hours or 2) * 3600 * SECOND
        seen = [(-rank.get(c, 0), at, c) for at, c in rows if end is not None and r.timestamp <= at <= end and c in rank]
        assert found.pop(r.id) == ((min(seen)[2], min(seen)[1]) if seen else ("None", None))
    assert not found


def test_region_of_crowded_events(spark):
    hour = 3600 * SECOND
    rows = [(i % 2, T0 + i * SECOND, i % 7) for i in range(200)] + [(0, T0 + 50 * SECOND, 9), (None, T0, 5), (1, T0 + 30 * hour, None)]
    regions = spark.createDataFrame(rows, "series_id int, timestamp timestamp_ntz, region_number int")
    peaks = [(i, i % 3, T0 + (i * 37 - 3000) * SECOND) for i in range(100)] + [(300, 0, T0 + 6 * hour + 50 * SECOND), (301, 0, T0 + 7 * hour), (302, None, T0), (303, 0, None), (304, 1, T0 + 24 * hour)]
    flares = spark.createDataFrame(peaks, "event_id long, series_id int, peak_time timestamp_ntz")
    out = events.attach_region(flares, regions, keys=["series_id"])
    assert "origin" not in _plan(out)
    found = {r.event_id: r.active_region for r in out.collect()}
    for i, s, at in peaks:
        near = [(t, -1 if n is None else n) for z, t, n in rows if s is not None and z == s and at is not None and abs(t - at) <= 6 * hour]
        assert found.pop(i) == (None if not near or max(near)[1] < 0 else max(near)[1])
    assert not found


def test_buckets_make_only_the_points_they_read(spark):
    from fluxloom.functions.curves import beside_hours, bucket_probabilities
    from fluxloom.operators import survival

    assert beside_hours("abcde", [0, 1, 2, 5, 9], [1, 3, 9, 20]) == list("bcde")
    baseline = [(float(t), None, 0.0, 2.0, 0.1) if t < 2 else (float(t), 2.0, 0.1 * t, 170.0, 30.0) for t in range(169)]
    model = survival.CoxModel(["x"], [0.5], [0.3], baseline)
    df = spark.createDataFrame([(i, float(i)) for i in range(-5, 9)], "id long, x double")
    curve = model.curve(df, "few", around=(0, 6, 12))
    assert [p.t for p in curve.first().few] == [0.0, 1.0, 6.0, 7.0, 12.0, 13.0]
    for buckets in ((0, 6, 12, 24, 48, 168), (0, 2.5, 200)):
        scored = survival.score_survival(model, df, ["id"], buckets=buckets)
        assert len(scored.first()["curve"]) == 169
        assert scored.where(F.map_entries("probability_distribution") != F.map_entries(bucket_probabilities(F.col("curve"), buckets))).count() == 0


def test_neighbours_travel_by_block_and_ties_stay_bounded(spark, monkeypatch):
    import tracemalloc

    from fluxloom.operators import prep
    from fluxloom.session import Cuts, scratch

    same = np.ones((1500, 64))
    tracemalloc.start()
    row, other, dist = prep.exact_neighbours(same, np.arange(1500), same, np.arange(1500), 3)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200e6 and len(row) == 4500 and (dist == 0).all() and other[-3:].tolist() == [0, 1, 2]

    rng = np.random.default_rng(8)
    pts = rng.normal(size=(400, 10))
    data = [("a", i, [float(v) for v in p], 400, i, True) for i, p in enumerate(pts)]
    rows = spark.createDataFrame(data, "label string, id long, vec array<double>, _n long, _i long, seeds boolean")
    made = []
    cut = Cuts.cut
    monkeypatch.setattr(Cuts, "cut", lambda self, df: made.append(cut(self, df)) or made[-1])
    with scratch() as cuts:
        near = {r.id: [x.other for x in r.near] for r in prep.class_neighbours(rows, k=5, block_rows=100, cuts=cuts).collect()}
        assert made[-1].count() <= 400 * 6  # a visit is one of few blocks, not one of 20 cells
    for i, p in enumerate(pts):
        assert near[i] == [j for j in np.lexsort((np.arange(400), ((pts - p) ** 2).sum(1))) if j != i][:5]


def test_sets_that_leave_out_a_fold_share_one_search(spark, monkeypatch):
    from fluxloom.operators import prep

    rng = np.random.default_rng(3)
    searched = []
    search = prep.class_neighbours
    monkeypatch.setattr(prep, "class_neighbours", lambda rows, **o: searched.append(rows.count()) or search(rows, **o))
    plain = lambda made: sorted((r.cls, round(r.a, 9), round(r.b, 9)) for r in made.collect())
    # some rows of b seed; all of a and b do, and ids repeat, in one fold and in others
    for letters, again in (("abbbccccc", 0), ("abccccc", 1)):
        rows = [(i, letters[i % len(letters)], i % 3, *map(float, rng.integers(0, 6, 2))) for i in range(210)]  # many ties
        rows += again * [(7, "a", 0, *rows[7][3:]), (7, "a", 2, *rows[7][3:]), *rows[28:37]]
        sets = [(f"{w}|{c}", w, i, c, f, w, a, b) for i, c, f, a, b in rows for w in range(4) if w != f]
        df = spark.createDataFrame(sets, "cls string, set int, key long, base string, fold int, k int, a double, b double").repartition(3)
        for block_rows in (30_000, 13):
            searched.clear()
            alone = plain(prep.smote(df, "cls", "key", ["a", "b"], within="set", block_rows=block_rows))
            assert alone and plain(prep.smote(df, "cls", "key", ["a", "b"], within="set", block_rows=block_rows, folded=("base", "fold", "k"), folds=3)) == alone
            assert searched[1] == sum(r[1] != "c" for r in rows) and searched[0] > 2.5 * searched[1]


def test_nearest_outside_of_every_fold():
    from fluxloom.operators import prep

    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(2600, 5)), 1)  # more than the first slice, with ties
    ids, fold = np.arange(2600) // 2, rng.integers(0, 4, 2600)  # ids come twice
    row, place, dist = prep.nearest(x[:40], ids[:40], x, ids, 3, fold=fold, folds=4)
    for i in range(40):
        d = ((x - x[i]) ** 2).sum(1)
        order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[i]]
        mine = place[row == i]
        assert np.allclose(dist[row == i], d[mine]) and len(mine) <= 3 * 4
        for f in (None, 0, 1, 2, 3):
            assert np.allclose(d[[j for j in mine if fold[j] != f][:3]], d[[j for j in order if fold[j] != f][:3]])
            assert [ids[j] for j in mine if fold[j] != f][:3] == [ids[j] for j in order if fold[j] != f][:3]


def test_boosting_writes_bins_and_margins_only(spark, monkeypatch):
    from fluxloom.operators import classify, many
    from fluxloom.session import Cuts

    df = spark.createDataFrame([(i, f"k{i % 3 % 2}", float(i % 7), float(i * 37 % 101)) for i in range(90)], "id long, label string, a double, b double")
    names, folded, rows = classify.training_sets(df, ["label"], "id", ["a", "b"], folds=2, oversample=True)
    read = [f for f in rows.inputFiles() if f not in folded.inputFiles()]
    assert set(folded.inputFiles()) <= set(rows.inputFiles())  # the sets repeat the folded rows, they are not written again
    assert read and sum(spark.read.parquet(f).count() for f in read) == rows.where(F.col("key") >= 1 << 62).count()
    edges = many.bin_edges(df, ["a", "b"])
    whole = many.fit_sets(rows, {0: 2, 1: 2, 2: 2}, 2, edges, kinds=["gbt"], boosting=many.Boosting(trees=12))
    made = []
    cut = Cuts.cut
    monkeypatch.setattr(Cuts, "cut", lambda self, d: made.append(d.columns) or cut(self, d))
    level = many.fit_sets(rows, {0: 2, 1: 2, 2: 2}, 2, edges, kinds=["gbt"], boosting=many.Boosting(trees=12), cells_in_task=10)
    assert made and all(c == ["set", "key", "y", "bins", "margins"] for c in made)
    for k in whole:
        assert np.array_equal(whole[k][0].feature, level[k][0].feature) and np.allclose(whole[k][0].value, level[k][0].value)
