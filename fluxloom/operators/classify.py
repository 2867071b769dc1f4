"""Multi-class training, calibration, evaluation and batch scoring on Spark ML."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fluxloom.functions.curves import curve_at
from fluxloom.operators import many, metrics
from fluxloom.operators.prep import class_weights, clean_matrix, draw, fold_column, smote
from fluxloom.plans.ordering import running_index
from fluxloom.session import durable

VECTOR = "_features"


def assemble(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=VECTOR).transform(clean_matrix(df, columns))


@dataclass
class ClassModel:
    """A fitted classifier: ``probabilities`` adds an array column in the order of ``classes``."""

    kind: str
    classes: list[str]
    columns: list[str]
    parts: list = field(default_factory=list)
    calibration: list | None = None

    @property
    def plain(self) -> bool:
        """Whether the model is one of ``operators.many``: arrays, scored in batches."""
        return bool(self.parts) and isinstance(self.parts[0], (many.Softmax, list))

    def raw_probabilities(self, df: DataFrame) -> DataFrame:
        if self.plain:
            return clean_matrix(df, self.columns).withColumn("_p", many.probability_column(self.parts[0], F.array(*[F.col(c) for c in self.columns])))
        out = assemble(df, self.columns)
        if self.kind == "logistic":
            out = self.parts[0].setPredictionCol("_pred").setRawPredictionCol("_raw").setProbabilityCol("_prob").transform(out)
            return out.withColumn("_p", vector_to_array("_prob")).drop("_pred", "_raw", "_prob", VECTOR)
        for i, m in enumerate(self.parts):
            m.setPredictionCol(f"_pred{i}").setRawPredictionCol(f"_raw{i}").setProbabilityCol(f"_prob{i}")
            out = m.transform(out)
        each = [1 / (1 + F.exp(-2 * vector_to_array(f"_raw{i}")[1])) for i in range(len(self.parts))]
        out = out.withColumn("_p", F.array(1 - each[0], each[0]) if len(self.classes) == 2 else _normalised(F.array(*each)))
        return out.drop(VECTOR, *[f"_{n}{i}" for i in range(len(self.parts)) for n in ("pred", "raw", "prob")])

    def probabilities(self, df: DataFrame) -> DataFrame:
        out = self.raw_probabilities(df)
        if self.calibration is None:
            return out
        return calibrated(out, self.calibration)

    def importances(self, spark: SparkSession) -> DataFrame:
        """Feature importance: tree gain, or mean absolute coefficient; descending."""
        if self.plain and self.kind == "gbt":
            sums = [float(v) for v in sum(m.importances(len(self.columns)) for m in self.parts[0]) / len(self.parts[0])]
        elif self.plain:
            sums = [float(v) for v in abs(self.parts[0].weights[:, :-1]).mean(axis=0)]
        elif self.kind == "gbt":
            sums = [sum(float(m.featureImportances[i]) for m in self.parts) / len(self.parts) for i in range(len(self.columns))]
        else:
            matrix = self.parts[0].coefficientMatrix.toArray()
            sums = [float(abs(matrix[:, i]).mean()) for i in range(len(self.columns))]
        return spark.createDataFrame(list(zip(self.columns, sums)), "feature string, importance double").orderBy(F.desc("importance"), "feature")

    def save(self, path: str, spark: SparkSession) -> None:
        meta = [(self.kind, self.classes, self.columns, len(self.parts))]
        spark.createDataFrame(meta, "kind string, classes array<string>, columns array<string>, parts int").write.mode("overwrite").parquet(f"{path}/meta")
        maps = [(i, isinstance(a, float), [a] if isinstance(a, float) else a, [b] if isinstance(b, float) else b) for i, (a, b) in enumerate(self.calibration or [])]
        spark.createDataFrame(maps, "class_no int, sigmoid boolean, a array<double>, b array<double>").write.mode("overwrite").parquet(f"{path}/calibration")
        for i, m in enumerate(self.parts):
            m.write().overwrite().save(f"{path}/part{i}")

    @staticmethod
    def load(path: str, spark: SparkSession) -> ClassModel:
        row = spark.read.parquet(f"{path}/meta").first()
        reader = LogisticRegressionModel if row["kind"] == "logistic" else GBTClassificationModel
        maps = [(r["a"][0], r["b"][0]) if r["sigmoid"] else (list(r["a"]), list(r["b"])) for r in spark.read.parquet(f"{path}/calibration").orderBy("class_no").collect()]
        return ClassModel(row["kind"], list(row["classes"]), list(row["columns"]), [reader.load(f"{path}/part{i}") for i in range(row["parts"])], maps or None)


def _normalised(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    size = F.size(values)
    return F.when(total > 0, F.transform(values, lambda v: v / total)).otherwise(F.transform(values, lambda v: 1.0 / size))


def class_names(df: DataFrame, label: str) -> list[str]:
    """Class names in alphabetical order (a handful)."""
    return sorted(str(r[0]) for r in df.select(label).distinct().collect())


def _indexed(df: DataFrame, label: str, classes: Sequence[str]) -> DataFrame:
    table = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i)))])
    return df.withColumn("_y", table[F.col(label).cast("string")])


def fit_logistic(train: DataFrame, label: str, columns: Sequence[str], *, weight: str | None = None, max_iter: int = 2000, tolerance: float = 1e-5) -> ClassModel:
    """Multinomial logistic regression with an L2 penalty of 1/rows on raw columns."""
    classes = class_names(train, label)
    data = assemble(_indexed(train, label, classes), columns)
    lr = LogisticRegression(
        featuresCol=VECTOR, labelCol="_y", family="multinomial", maxIter=max_iter, tol=tolerance, regParam=1.0 / max(train.count(), 1), standardization=False
    )
    if weight:
        lr = lr.setWeightCol(weight)
    return ClassModel("logistic", classes, list(columns), [lr.fit(data)])


def fit_gbt(
    train: DataFrame, label: str, columns: Sequence[str], *, trees: int = 100, depth: int = 3, rate: float = 0.1, share: float = 0.8, seed: int = 42, threads: int = 4
) -> ClassModel:
    """One boosted model per class against the rest, normalised; classes train side by side. Two classes need one model, of the second."""
    classes = class_names(train, label)
    data = assemble(train, columns).persist()

    def one(c: str) -> GBTClassificationModel:
        marked = data.withColumn("_y", (F.col(label).cast("string") == c).cast("double"))
        gbt = GBTClassifier(featuresCol=VECTOR, labelCol="_y", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=share, seed=seed)
        return gbt.fit(marked)

    with ThreadPoolExecutor(max_workers=threads) as pool:
        parts = list(pool.map(one, classes[1:] if len(classes) == 2 else classes))
    data.unpersist()
    return ClassModel("gbt", classes, list(columns), parts)


def predicted_class(model: ClassModel) -> Column:
    """Class of the largest probability; ties go to the earlier class."""
    names = F.array(*[F.lit(c) for c in model.classes])
    return F.element_at(names, F.array_position("_p", F.array_max("_p")).cast("int"))


def score_classes(model: ClassModel, df: DataFrame, keep: Sequence[str], *, window_hours: int | None = None) -> DataFrame:
    """Predicted class and class -> probability map for every row."""
    scored = model.probabilities(df)
    return scored.select(
        *keep,
        predicted_class(model).alias("predicted_class"),
        F.map_from_arrays(F.array(*[F.lit(c) for c in model.classes]), F.col("_p")).alias("class_probabilities"),
        F.lit(window_hours).cast("int").alias("window_hours"),
        F.lit(model.kind).alias("model_type"),
    )


Fit = Callable[[DataFrame, str, Sequence[str]], ClassModel]


def cross_validate(df: DataFrame, label: str, ident: str, columns: Sequence[str], fit: Fit, *, folds: int = 5, seed: int = 42, oversample: bool = False):
    """Accuracy of every fold; oversampling sees the training folds only."""
    data = durable(fold_column(df, label, ident, folds=folds, seed=seed))
    scores = []
    for k in range(folds):
        train = data.where(F.col("fold") != k)
        if oversample:
            extra = smote(train, label, ident, columns, seed=seed)
            train = durable(train.select(label, *columns).unionByName(extra))
        model = fit(train, label, columns)
        held = model.probabilities(data.where(F.col("fold") == k))
        scores.append(held.agg(F.avg((predicted_class(model) == F.col(label).cast("string")).cast("double"))).first()[0])
    return [s for s in scores if s is not None]


def out_of_fold(df: DataFrame, label: str, ident: str, columns: Sequence[str], fit: Fit, *, folds: int = 3, seed: int = 42) -> tuple[list[str], DataFrame]:
    """Probabilities of every training row by a model that has not seen it."""
    data = durable(fold_column(df, label, ident, folds=folds, seed=seed))
    classes, parts = class_names(df, label), []
    for k in range(folds):
        model = fit(data.where(F.col("fold") != k), label, columns)
        place = F.array(*[F.get(F.col("_p"), model.classes.index(c)) if c in model.classes else F.lit(0.0) for c in classes])
        parts.append(model.probabilities(data.where(F.col("fold") == k)).select(ident, label, place.alias("_p")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return classes, durable(out)


def calibrate(model: ClassModel, train: DataFrame, label: str, ident: str, fit: Fit, *, method: str = "isotonic", folds: int = 3) -> ClassModel:
    """The model with its probabilities calibrated per class on out-of-fold scores of the training rows."""
    classes, scores = out_of_fold(train, label, ident, model.columns, fit, folds=folds)
    maps = []
    for i, c in enumerate(classes):
        points = scores.select(F.get("_p", i).alias("p"), (F.col(label).cast("string") == c).cast("double").alias("hit"))
        counted = points.groupBy("p").agg(F.avg("hit").alias("hit"), F.count("*").cast("double").alias("n"))
        if method == "isotonic":
            fitted = IsotonicRegression(featuresCol="p", labelCol="hit", weightCol="n").fit(counted)
            maps.append((list(map(float, fitted.boundaries)), list(map(float, fitted.predictions))))
        elif method == "sigmoid":
            rows = VectorAssembler(inputCols=["p"], outputCol=VECTOR).transform(points)
            fitted = LogisticRegression(featuresCol=VECTOR, labelCol="hit").fit(rows)
            maps.append((float(fitted.coefficients[0]), float(fitted.intercept)))
        else:
            raise ValueError(f"unknown method {method}")
    return ClassModel(model.kind, model.classes, model.columns, model.parts, maps)


def _mapped(p: Column, spec) -> Column:
    a, b = spec
    if isinstance(a, float):
        return 1 / (1 + F.exp(-(p * a + b)))
    points = F.array(*[F.struct(F.lit(x).alias("t"), F.lit(y).alias("s")) for x, y in zip(a, b)])
    return curve_at(points, p)


def calibrated(df: DataFrame, maps: list) -> DataFrame:
    each = F.array(*[_mapped(F.get("_p", i), m) for i, m in enumerate(maps)])
    return df.withColumn("_p", _normalised(each))


def evaluate(model: ClassModel, test: DataFrame, label: str, stage: str) -> DataFrame:
    """Brier score, area under the curve and report figures as (stage, metric, class_name, value)."""
    scored = model.probabilities(test)
    spread = durable(scored.select(F.col(label).cast("string").alias("_y"), predicted_class(model).alias("_z"), *[F.get("_p", i).alias(f"_p{i}") for i in range(len(model.classes))]))
    probs = {c: f"_p{i}" for i, c in enumerate(model.classes)}
    rows = [
        metrics.brier(spread, "_y", probs).select(F.lit("brier").alias("metric"), "class_name", F.col("brier").alias("value")),
        metrics.roc_auc(spread, "_y", probs).select(F.lit("roc_auc").alias("metric"), "class_name", F.col("auc").alias("value")),
    ]
    report = metrics.classification_report(spread, "_y", "_z")
    rows += [report.select(F.lit(m).alias("metric"), "class_name", F.col(m).alias("value")) for m in ("precision", "recall", "f1")]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select(F.lit(stage).alias("stage"), "metric", "class_name", "value")


def fitter(kind: str, *, weighted: bool = False, **options) -> Fit:
    """A fit function for ``logistic`` or ``gbt``; balanced weights apply to the former."""
    if kind == "gbt":
        return lambda train, label, columns: fit_gbt(train, label, columns, **options)
    if weighted:
        return lambda train, label, columns: fit_logistic(class_weights(train, label, "_w"), label, columns, weight="_w", **options)
    return lambda train, label, columns: fit_logistic(train, label, columns, **options)


def training_sets(df: DataFrame, labels: Sequence[str], ident: str, columns: Sequence[str], *, folds: int, oversample: bool, seed: int = 42) -> tuple[list[list[str]], DataFrame, DataFrame]:
    """(class names of every label, rows with their fold, training rows of every set).

    Set ``folds + 1`` times the label's number plus k holds the rows outside of fold k, and for k = ``folds`` all rows. Rows without a label are
    in none of its sets. Synthetic rows are made from the set's own rows only.
    """
    clean = clean_matrix(df.select(ident, *labels, *columns), columns)
    x = F.array(*[F.col(c) for c in columns])
    stacked = None
    for i, label in enumerate(labels):
        part = clean.where(F.col(label).isNotNull()).select(F.lit(i).alias("label_no"), F.col(label).cast("string").alias("name"), F.col(ident).cast("bigint").alias("key"), x.alias("x"))
        stacked = part if stacked is None else stacked.unionByName(part)
    names: list[list[str]] = [[] for _ in labels]
    for r in stacked.select("label_no", "name").distinct().orderBy("name").collect():  # a handful of classes
        names[r["label_no"]].append(r["name"])
    place = F.create_map(*[v for i, own in enumerate(names) for c, name in enumerate(own) for v in (F.concat(F.lit(f"{i}|"), F.lit(name)), F.lit(c))])
    cls = F.concat(F.col("label_no").cast("string"), F.lit("|"), F.col("name"))
    folded = durable(fold_column(stacked.withColumn("cls", cls).withColumn("y", place[F.col("cls")]), "cls", "key", folds=folds, seed=seed).select("label_no", "key", "y", "fold", "x"))
    member = F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds)), lambda k: k != F.col("fold")))
    number = (F.col("label_no") * (folds + 1) + F.col("k")).alias("set")
    rows = folded.select("label_no", "key", "y", "x", "fold", member.alias("k")).select(number, "key", "y", "x", "label_no", "fold", "k")
    if oversample:
        # only the rows of ``folded`` and the synthetic ones are written down: the sets repeat the former
        wide = rows.select(F.concat_ws("|", "set", "y").alias("cls"), "set", "key", F.concat_ws("|", "label_no", "y").alias("base"), "fold", "k", *[F.col("x")[i].alias(f"x{i}") for i in range(len(columns))])
        made = smote(wide, "cls", "key", [f"x{i}" for i in range(len(columns))], seed=seed, within="set", folded=("base", "fold", "k"), folds=folds)
        split = F.split("cls", r"\|")
        vector = F.array(*[F.col(f"x{i}") for i in range(len(columns))])
        made = made.select(split[0].cast("int").alias("set"), split[1].cast("int").alias("y"), vector.alias("x"))
        # synthetic rows are named by what they hold, so that a lost task draws the same trees again
        made = made.select("set", (F.xxhash64("y", "x").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)).alias("key"), "y", "x")
        rows = rows.select("set", "key", "y", "x").unionByName(made).withColumn("w", F.lit(1.0))
    else:
        rows = rows.select("set", "key", "y", "x")
        weights = class_weights(rows.withColumn("cls", F.concat_ws("|", "set", "y")), "cls", "w")
        # balanced within the set: as many sets and rows of each as there are cancel out below
        sizes = rows.groupBy("set").agg(F.count("*").alias("_rows"), F.count_distinct("y").alias("_kinds"))
        totals = rows.select("set", "y").agg(F.count("*").alias("_all"), F.count_distinct("set", "y").alias("_k"))
        rows = durable(weights.join(F.broadcast(sizes), "set").join(F.broadcast(totals), F.lit(True)).select("set", "key", "y", "x", (F.col("w") * F.col("_k") / F.col("_all") * F.col("_rows") / F.col("_kinds")).alias("w")))
    return names, folded, rows


def train_classifiers(
    df: DataFrame, labels: Sequence[str], ident: str, columns: Sequence[str], *, kinds: Sequence[str] = ("logistic", "gbt"), oversample: bool = True, folds: int = 5, options: dict | None = None
) -> tuple[dict[tuple[str, str], ClassModel], DataFrame]:
    """Every model kind for every label column, and its accuracy on held-out folds: (fitted models, result table).

    All folds of all labels are trained side by side (``operators.many``): neither the number of jobs nor the rounds grow with the
    number of models. ``options`` holds ``many.Boosting`` fields under "gbt", and max_iter and tolerance under "logistic".
    """
    options, columns = options or {}, list(columns)
    names, folded, rows = training_sets(df, labels, ident, columns, folds=folds, oversample=oversample)
    edges = many.bin_edges(clean_matrix(df.select(*columns), columns), columns)
    classes = {i * (folds + 1) + k: len(own) for i, own in enumerate(names) if own for k in range(folds + 1)}
    fitted = many.fit_sets(rows, classes, len(columns), edges, kinds=kinds, boosting=many.Boosting(**options.get("gbt", {})), **options.get("logistic", {}))

    @F.pandas_udf("array<boolean>")
    def right(label_no: pd.Series, fold: pd.Series, y: pd.Series, x: pd.Series) -> pd.Series:
        """Which kinds of model that have not seen the row give its class."""
        out = np.zeros((len(y), len(kinds)), dtype=bool)
        sets = (label_no * (folds + 1) + fold).to_numpy()
        for s in np.unique(sets):
            here = np.flatnonzero(sets == s)
            values = np.stack(x.to_numpy()[here])
            for j, kind in enumerate(kinds):
                if (kind, int(s)) in fitted:
                    out[here, j] = many.class_probabilities(fitted[kind, int(s)], values).argmax(axis=1) == y.to_numpy()[here]
        return pd.Series(list(out))

    hits = folded.withColumn("hit", right("label_no", "fold", "y", "x"))
    found = {(r["label_no"], r["fold"]): r for r in hits.groupBy("label_no", "fold").agg(*[F.avg(F.col("hit")[j].cast("double")).alias(k) for j, k in enumerate(kinds)]).collect()}
    models, result = {}, []
    for i, label in enumerate(labels):
        for kind in kinds:
            scores = [found[i, k][kind] for k in range(folds) if (i, k) in found]
            if not scores or (kind, i * (folds + 1) + folds) not in fitted:
                continue
            models[label, kind] = ClassModel(kind, names[i], columns, [fitted[kind, i * (folds + 1) + folds]])
            mean = sum(scores) / len(scores)
            result.append((label, kind, oversample, mean, math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores)), len(scores)))
    return models, df.sparkSession.createDataFrame(result, "label string, model string, oversampled boolean, cv_mean double, cv_std double, folds int")


def permutation_importance(model: ClassModel, df: DataFrame, label: str, ident: str, *, seed: int = 42) -> DataFrame:
    """Accuracy lost when one column is shuffled, per column, descending.

    Every row gets a donor row (the one of its number in a digest order, an equi-join). Each
    column then makes one variant of every row with the donor's value, and all variants are
    scored in one pass.
    """
    names = model.columns
    data = df.select(ident, label, *[F.col(c).cast("double").alias(c) for c in names])
    right = (predicted_class(model) == F.col(label).cast("string")).cast("double")
    plain = durable(running_index(data, [ident], name="_i"))
    drawn = running_index(data.withColumn("_d", draw(ident, seed)), ["_d", ident], name="_i").select("_i", F.array(*names).alias("_donor"))
    variants = plain.join(drawn, "_i").select(ident, label, *names, F.posexplode("_donor").alias("_c", "_v"))
    shuffled = variants.select(ident, label, "_c", *[F.when(F.col("_c") == i, F.col("_v")).otherwise(F.col(c)).alias(c) for i, c in enumerate(names)])
    lost = model.probabilities(shuffled).groupBy("_c").agg(F.avg(right).alias("_a"))
    base = model.probabilities(plain).agg(F.avg(right).alias("_base"))  # one row
    table = F.array(*[F.lit(c) for c in names])
    out = lost.join(F.broadcast(base), F.lit(True)).select(F.get(table, F.col("_c")).alias("feature"), (F.col("_base") - F.col("_a")).alias("importance"))
    return out.orderBy(F.desc("importance"), "feature")
