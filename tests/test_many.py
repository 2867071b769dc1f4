"""Many models at once: trees against a plain fit, both plans alike, logistic weights against Spark ML, sets of the grid."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from fluxloom.operators import classify, many


def sample(n=240, features=4, classes=3, seed=5):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, features)), 2)
    x[:, 1] = np.round(x[:, 1])  # ties
    y = (x[:, 0] + 0.5 * x[:, 1] > 0.2).astype(int) + ((x[:, 2] > 0.7) & (classes > 2))
    return x, y.astype(int)


def as_rows(spark, sets):
    rows = [(s, i, int(b), 1.0, a.tolist()) for s, (x, y) in sets.items() for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "set int, key long, y int, w double, x array<double>").repartition(4)


def plain_fit(x, hit, edges, options):
    """Boosting written out: every edge of every feature tried with masks."""
    margin = np.full(len(x), np.log(hit.mean() / (1 - hit.mean())))
    trees = []
    for t in range(options.trees):
        seen = many._drawn(np.arange(len(x)), t, options.share, options.seed)
        p = 1 / (1 + np.exp(-margin))
        g, h = p - hit, p * (1 - p)
        part, tree = {0: np.arange(len(x))}, {}
        for node in range((1 << options.depth) - 1):
            rows = part[node]
            live = rows[seen[rows]]
            score = lambda r: g[r].sum() ** 2 / (h[r].sum() + many.RIDGE)  # noqa: B023,E731
            best = (1e-9, None, None)
            for f, own in enumerate(edges):
                for cut in own:
                    a, b = live[x[live, f] <= cut], live[x[live, f] > cut]
                    gain = score(a) + score(b) - score(live)
                    if len(a) and len(b) and gain > best[0] + 1e-9:
                        best = (gain, f, cut)
            tree[node] = best[1:]
            go = np.zeros(len(rows), bool) if best[1] is None else x[rows, best[1]] > best[2]
            part[2 * node + 1], part[2 * node + 2] = rows[~go], rows[go]
        for node in range((1 << options.depth) - 1, (1 << options.depth + 1) - 1):
            live = part[node][seen[part[node]]]
            margin[part[node]] += -options.rate * g[live].sum() / (h[live].sum() + many.RIDGE)
        trees.append(tree)
    return trees, margin


def test_trees_equal_a_plain_fit():
    x, y = sample()
    hit = (y == 1).astype(float)
    edges = [np.unique(np.quantile(x[:, f], [0.2, 0.4, 0.6, 0.8])) for f in range(x.shape[1])]
    options = many.Boosting(trees=6, depth=2, rate=0.3)
    model = many.boost(many._binned(x, edges), np.arange(len(x)), hit, edges, options)
    trees, margin = plain_fit(x, hit, edges, options)
    for t, tree in enumerate(trees):
        for node, (f, cut) in tree.items():
            assert model.feature[t, node] == (-1 if f is None else f) and (f is None or model.cut[t, node] == cut)
    assert np.allclose(model.margin(x), margin)
    assert abs(model.importances(4).sum() - 1) < 1e-12


@pytest.fixture(scope="module")
def both(spark):
    sets = {0: sample(200, seed=1), 3: sample(260, seed=2), 7: sample(150, classes=2, seed=3)}
    rows = as_rows(spark, sets)
    edges = many.bin_edges(rows.select(*[F.col("x")[i].alias(f"x{i}") for i in range(4)]), [f"x{i}" for i in range(4)], bins=8)
    classes = {0: 3, 3: 3, 7: 2}
    fit = lambda cells: many.fit_sets(rows, classes, 4, edges, boosting=many.Boosting(trees=12, depth=2), cells_in_task=cells)
    return sets, rows, fit(10_000), fit(0)


def test_both_plans_make_the_same_models(both):
    _, _, one, two = both
    assert one.keys() == two.keys() == {(k, s) for k in ("logistic", "gbt") for s in (0, 3, 7)}
    for (kind, s), model in one.items():
        if kind == "logistic":
            assert np.allclose(model.weights, two[kind, s].weights, atol=1e-6)
            continue
        assert len(model) == (1 if s == 7 else 3)
        for a, b in zip(model, two[kind, s]):
            assert np.array_equal(a.feature, b.feature) and np.array_equal(a.cut, b.cut) and np.allclose(a.value, b.value) and a.base == b.base


def test_boosting_in_tasks_holds_bins(spark, both, monkeypatch):
    sets, rows, one, _ = both

    def no(*_):
        raise AssertionError("a job per level")

    monkeypatch.setattr(many, "_boost_by_level", no)
    edges = many.bin_edges(rows.select(*[F.col("x")[i].alias(f"x{i}") for i in range(4)]), [f"x{i}" for i in range(4)], bins=8)
    made = many.fit_sets(rows, {0: 3, 3: 3, 7: 2}, 4, edges, kinds=["gbt"], boosting=many.Boosting(trees=12, depth=2), cells_in_task=260 * 4 // 2)
    assert made.keys() == {("gbt", s) for s in sets}
    for key, model in made.items():
        for a, b in zip(model, one[key], strict=True):
            assert np.array_equal(a.feature, b.feature) and np.array_equal(a.cut, b.cut) and np.array_equal(a.value, b.value)
    wide = [np.arange(300) / 100.0 - 1.5] * 4  # bins that take two bytes
    made = many.fit_sets(rows, {0: 3, 3: 3, 7: 2}, 4, wide, kinds=["gbt"], boosting=many.Boosting(trees=2, depth=2))
    x, y = sets[7]
    alone = many.boost(many._binned(x, wide), np.arange(len(x)), (y == 1).astype(float), wide, many.Boosting(trees=2, depth=2))
    assert np.array_equal(made["gbt", 7][0].feature, alone.feature) and np.array_equal(made["gbt", 7][0].value, alone.value)


def test_logistic_weights_equal_the_library(spark, both):
    sets, rows, one, _ = both
    for s in (0, 7):
        x, y = sets[s]
        from pyspark.ml.functions import array_to_vector

        data = rows.where(F.col("set") == s).select(array_to_vector("x").alias("v"), F.col("y").cast("double").alias("t"))
        library = LogisticRegression(featuresCol="v", labelCol="t", family="multinomial", regParam=1 / len(y), standardization=False, maxIter=500, tol=1e-12).fit(data)
        p = np.array([r.probability.toArray() for r in library.transform(data.orderBy("t")).select("probability").collect()])
        mine = np.array([one["logistic", s].probabilities(np.array([r.v.toArray()]))[0] for r in data.orderBy("t").collect()])
        assert np.allclose(np.sort(p, axis=0), np.sort(mine, axis=0), atol=2e-4)


def table(spark, n=160):
    x, y = sample(n)
    return spark.createDataFrame([(i, f"k{b}" if i % 40 else None, "up" if a[0] > 0 else "down", *map(float, a)) for i, (a, b) in enumerate(zip(x, y))], "id long, first string, second string, a double, b double, c double, d double")


@pytest.mark.parametrize("oversample", [True, False])
def test_train_grid(spark, oversample):
    df = table(spark)
    names, folded, rows = classify.training_sets(df, ["first", "second"], "id", list("abcd"), folds=3, oversample=oversample)
    assert names == [["k0", "k1", "k2"], ["down", "up"]]
    folds = {(r.label_no, r.key): r.fold for r in folded.collect()}
    own = rows.where(F.col("key") < 1 << 62).select("set", "key").collect()
    assert len(own) == 3 * len(folds) and all(r.set % 4 == 3 or folds[r.set // 4, r.key] != r.set % 4 for r in own)
    sizes = {(r["set"], r.y): (r.n, r.w) for r in rows.groupBy("set", "y").agg(F.count("*").alias("n"), F.sum("w").alias("w")).collect()}
    for s in range(8):
        each = [v for (k, _), v in sizes.items() if k == s]
        if oversample:
            assert len({n for n, _ in each}) == 1
        else:
            assert np.allclose([w for _, w in each], sum(n for n, _ in each) / len(each))
    models, result = classify.train_classifiers(df, ["first", "second"], "id", list("abcd"), oversample=oversample, folds=3, options={"gbt": {"trees": 20}})
    found = {(r.label, r.model): r for r in result.collect()}
    assert set(found) == set(models) == {(a, b) for a in ("first", "second") for b in ("logistic", "gbt")}
    assert all(r.folds == 3 and r.oversampled == oversample and r.cv_mean > 0.7 for r in found.values())
    model = models["second", "gbt"]
    scored = classify.score_classes(model, df, ["id", "second"])
    assert scored.where("predicted_class = second").count() > 150
    assert model.importances(spark).first().feature == "a" and abs(scored.selectExpr("sum(class_probabilities['up'] + class_probabilities['down'])").first()[0] - 160) < 1e-6
