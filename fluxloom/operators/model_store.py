"""Fitted models as rows: classifiers with their calibration, hazard models and boosted survival models, in versioned tables.

A model is one small table of numbers and names: weights, tree nodes, calibration knots, baselines. Nothing is pickled, so any reader of Parquet can
check or use it, and it loads in another session or release. Models are tables of ``sources.store``: a version is named by one manifest,
written last, so a reader sees a whole model or the one before.

Boosted models of Spark ML become ``operators.many.Trees`` and logistic ones ``many.Softmax``; they load as those and give the same scores.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Row, SparkSession
from pyspark.sql.types import StructType

from fluxloom.operators.classify import ClassModel
from fluxloom.operators.many import Softmax, Trees
from fluxloom.operators.survival import BoostedModel, CoxModel
from fluxloom.session import staging_path
from fluxloom.sources.store import NO_DAY, CommittedTables

SCHEMA = StructType().add("section", "string").add("part", "integer").add("tree", "integer").add("node", "integer").add("name", "string").add("a", "double").add("b", "double").add("c", "double").add("d", "double")
Rows = list[tuple]


def _row(section: str, part: int = 0, tree: int = 0, node: int = 0, name: str | None = None, *numbers: float | None) -> tuple:
    values = [None if v is None else float(v) for v in numbers]
    return (section, int(part), int(tree), int(node), name, *values, *[None] * (4 - len(values)))


# --- trees --------------------------------------------------------------------------------


def ensemble_trees(model: GBTClassificationModel | GBTRegressionModel, scale: float = 1.0) -> Trees:
    """A boosted Spark ML model in heap order; ``scale`` times its sum of weighted trees is the margin."""
    roots = [tree._call_java("rootNode") for tree in model.trees]
    depth = max([1] + [tree.depth for tree in model.trees])
    nodes = (1 << depth) - 1
    feature, cut, gain = np.full((len(roots), nodes), -1), np.zeros((len(roots), nodes)), np.zeros((len(roots), nodes))
    value = np.zeros((len(roots), nodes + 1))
    for t, (root, weight) in enumerate(zip(roots, model.treeWeights)):
        open_nodes = [(root, 0)]
        while open_nodes:
            node, at = open_nodes.pop()
            if node.getClass().getSimpleName() == "LeafNode":
                while at < nodes:  # a node without a split sends all rows left
                    at = 2 * at + 1
                value[t, at - nodes] = scale * weight * node.prediction()
                continue
            feature[t, at], cut[t, at], gain[t, at] = node.split().featureIndex(), node.split().threshold(), node.gain()
            open_nodes += [(node.leftChild(), 2 * at + 1), (node.rightChild(), 2 * at + 2)]
    return Trees(0.0, feature, cut, gain, value)


def _tree_rows(trees: Trees, part: int, columns: list[str]) -> Rows:
    out = [_row("base", part, 0, 0, None, trees.base)]
    for t in range(len(trees.feature)):
        out += [_row("split", part, t, n, columns[f] if f >= 0 else None, c, g) for n, (f, c, g) in enumerate(zip(trees.feature[t].tolist(), trees.cut[t], trees.gain[t]))]
        out += [_row("leaf", part, t, n, None, v) for n, v in enumerate(trees.value[t])]
    return out


def _trees_of(rows: list[Row], part: int, columns: list[str]) -> Trees:
    place = {c: i for i, c in enumerate(columns)}
    own = [r for r in rows if r.part == part]
    splits, leaves = [r for r in own if r.section == "split"], [r for r in own if r.section == "leaf"]
    shape = lambda found: (1 + max([r.tree for r in found], default=-1), 1 + max([r.node for r in found], default=0))
    feature, value = np.full(shape(splits), -1), np.zeros(shape(leaves))
    cut, gain = np.zeros(feature.shape), np.zeros(feature.shape)
    for r in splits:
        feature[r.tree, r.node], cut[r.tree, r.node], gain[r.tree, r.node] = -1 if r.name is None else place[r.name], r.a, r.b
    for r in leaves:
        value[r.tree, r.node] = r.a
    return Trees(next(r.a for r in own if r.section == "base"), feature, cut, gain, value)


# --- models -------------------------------------------------------------------------------


def model_rows(model: ClassModel | CoxModel | BoostedModel) -> Rows:
    """Everything a model needs, as rows of ``SCHEMA``."""
    columns = [_row("column", node=i, name=c) for i, c in enumerate(model.columns)]
    if isinstance(model, CoxModel):
        rows = [_row("kind", name="cox")] + columns + [_row("fit", 0, 0, 0, None, model.steps, model.log_likelihood, model.converged)]
        rows += [_row("beta", 0, 0, i, None, b, m) for i, (b, m) in enumerate(zip(model.beta, model.means))]
        return rows + [_row("baseline", int(r[0]), 0, i, None, *r[1:]) for i, r in enumerate(model.baseline)]
    if isinstance(model, BoostedModel):
        trees = model.model if isinstance(model.model, Trees) else ensemble_trees(model.model)
        return [_row("kind", name="boosted survival"), _row("scale", 0, 0, 0, None, model.scale), *columns, *_tree_rows(trees, 0, model.columns)]
    rows = [_row("kind", name=model.kind), *columns, *[_row("class", node=i, name=c) for i, c in enumerate(model.classes)]]
    if model.kind == "logistic":
        own = model.parts[0]
        if isinstance(own, LogisticRegressionModel):
            own = Softmax(np.hstack([own.coefficientMatrix.toArray(), own.interceptVector.toArray()[:, None]]))
        rows += [_row("weight", k, 0, i, None, w) for k, line in enumerate(own.weights) for i, w in enumerate(line)]
    else:
        parts = model.parts[0] if model.plain else [ensemble_trees(m, scale=2.0) for m in model.parts]
        for k, trees in enumerate(parts):
            rows += _tree_rows(trees, k, model.columns)
    for k, (a, b) in enumerate(model.calibration or []):
        knots = [(a, b)] if isinstance(a, float) else list(zip(a, b))
        rows += [_row("calibration", k, 0, i, "sigmoid" if isinstance(a, float) else "isotonic", x, y) for i, (x, y) in enumerate(knots)]
    return rows


def model_from(rows: list[Row]) -> ClassModel | CoxModel | BoostedModel:
    """The model of ``model_rows``."""
    rows = sorted(rows, key=lambda r: (r.section, r.part, r.tree, r.node))
    of = lambda section: [r for r in rows if r.section == section]
    kind, columns = of("kind")[0].name, [r.name for r in of("column")]
    if kind == "cox":
        fit = of("fit")[0]
        baseline = sorted(((r.node, (float(r.part), r.a, r.b, r.c, r.d)) for r in of("baseline")), key=lambda x: x[0])
        return CoxModel(columns, [r.b for r in of("beta")], [r.a for r in of("beta")], [b for _, b in baseline], int(fit.a), fit.b, bool(fit.c))
    if kind == "boosted survival":
        return BoostedModel(columns, _trees_of(rows, 0, columns), of("scale")[0].a)
    if kind == "logistic":
        parts = [Softmax(np.array([[r.a for r in of("weight") if r.part == k] for k in range(1 + max(r.part for r in of("weight")))]))]
    else:
        parts = [[_trees_of(rows, k, columns) for k in range(len(of("base")))]]
    maps: dict[int, list[Row]] = {}
    for r in of("calibration"):
        maps.setdefault(r.part, []).append(r)
    calibration = [(own[0].a, own[0].b) if own[0].name == "sigmoid" else ([r.a for r in own], [r.b for r in own]) for _, own in sorted(maps.items())]
    return ClassModel(kind, [r.name for r in of("class")], columns, parts, calibration or None)


def save_model(spark: SparkSession, folder: str, name: str, model: ClassModel | CoxModel | BoostedModel) -> int:
    """Stores the newest version of a named model; its commit number. Earlier versions stay readable by theirs."""
    path = staging_path(spark, "model")
    spark.createDataFrame(model_rows(model), SCHEMA).coalesce(1).write.parquet(path)
    return CommittedTables(spark, folder).commit({name: [(NO_DAY, path)]})


def load_model(spark: SparkSession, folder: str, name: str, version: int | None = None) -> ClassModel | CoxModel | BoostedModel:
    """The model as of a commit, the newest one without."""
    rows = CommittedTables(spark, folder).read(name, SCHEMA, version=version).collect()  # as many as the model has numbers
    if not rows:
        raise KeyError(f"no model {name}")
    return model_from(rows)
