"""Many classifiers at once: histogram boosting and multinomial logistic regression over all training sets of a grid.

A training set is a number in the column ``set`` (a label and a fold, say); a row stands once for every set it belongs to. All sets and all their
classes take every step together, so the number of jobs does not depend on how many models there are.

Boosting. Features are binned once by quantiles. Each level of a tree is one aggregation of (set, class, node, feature, bin) to gradient, hessian and
count: tasks add up the histograms of their rows, partial sums meet by set in two levels, and only the chosen splits reach the driver.
Bins and margins are all that is written of a row. Margins are written down every ``REFRESH`` trees; in between a task applies the few newest trees to its rows.

Logistic regression. Each Newton step is one aggregation of loss, gradient and second moments by set.

Sets of up to ``CELLS_IN_TASK`` cells (rows times features, counted first) run all of their steps inside one task instead, by the same functions: one
job for everything. Boosting needs their bins only, a byte a cell, and does so up to ``BINS_A_CELL`` times as many. Larger ones go level by level.

``rows`` always has the columns set (int), key (long, names a row within its set), y (int, the class number), w (double, its weight in the logistic
regression) and x (array of double, without nulls).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from fluxloom.session import Cuts

BINS = 32
RIDGE = 1.0  # added to a node's hessian
REFRESH = 10
CELLS_IN_TASK = 8_000_000
BINS_A_CELL = 20
ROWS_AT_ONCE = 16_384  # whose histogram or moments are added up in the processor's cache
SLOTS = 16  # partial sums of a set meet in so many groups first
_MIX = np.uint64(0xFF51AFD7ED558CCD)  # fixed value: multiplier of a well-known 64-bit mixer


@dataclass
class Trees:
    """A boosted model: per tree the nodes in heap order. Rows with x <= cut go left; a node without a split (feature -1) sends all left."""

    base: float
    feature: np.ndarray  # trees x nodes
    cut: np.ndarray
    gain: np.ndarray
    value: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(int(np.log2(len(value)))):
                f = feature[node]
                node = 2 * node + 1 + ((f >= 0) & (x[rows, f] > cut[node]))
            out += value[node - len(feature)]
        return out

    def importances(self, n: int) -> np.ndarray:
        """Share of the gain of every feature."""
        out = np.bincount(self.feature[self.feature >= 0], self.gain[self.feature >= 0], minlength=n)
        return out / out.sum() if out.sum() > 0 else out


@dataclass
class Softmax:
    """Multinomial logistic regression; the last column of ``weights`` (classes x features + 1) is the intercept."""

    weights: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _softmax(x @ self.weights[:, :-1].T + self.weights[:, -1])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of an array column of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def bin_edges(df: DataFrame, columns: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Inner edges of every column's bins, from quantiles of the whole table (one job, ``bins`` numbers a column)."""
    found = df.approxQuantile(list(columns), [i / bins for i in range(1, bins)], 0.1 / bins)
    return [np.unique(np.array(q, dtype=np.float64)) for q in found]


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin numbers: x <= edges[b] exactly for the bins up to b."""
    return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1) if len(edges) else np.zeros((len(x), 0), np.int64)


def _bin_kind(edges: list[np.ndarray]) -> np.dtype:
    """Type that holds a bin's number."""
    return np.dtype(np.uint8 if max([len(e) for e in edges], default=0) < 256 else np.uint16)


def _drawn(key: np.ndarray, tree: int, share: float, seed: int) -> np.ndarray:
    """Which rows a tree sees: by a digest of the row's key, the same on every retry and in every plan."""
    with np.errstate(over="ignore"):
        h = key.astype(np.uint64) * _MIX + np.uint64((tree + 1) * 2654435761 + seed)
        for _ in range(2):
            h = (h ^ (h >> np.uint64(33))) * _MIX
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53) < share


def _slopes(margin: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
    return p - hit, np.maximum(p * (1 - p), 1e-16)


def histogram(bins: np.ndarray, node: np.ndarray, nodes: int, g: np.ndarray, h: np.ndarray, width: int) -> np.ndarray:
    """(3, nodes, features, width): gradient, hessian, and 1 where there are rows. ``bins`` has a line per feature."""
    features, n = bins.shape
    sums = np.zeros((features, nodes * width), dtype=np.complex128)  # both sums in one pass
    both, start, at = g + 1j * h, node * width, np.empty(min(n, ROWS_AT_ONCE), dtype=np.int64)
    for i in range(0, n, ROWS_AT_ONCE):
        own = slice(i, i + ROWS_AT_ONCE)
        place = at[: len(start[own])]
        for f in range(features):
            np.add(start[own], bins[f, own], out=place)
            np.add.at(sums[f], place, both[own])
    sums = sums.reshape(features, nodes, width).transpose(1, 0, 2)
    return np.stack([sums.real, sums.imag, sums.imag > 0])


def best_splits(hist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per node: feature (-1: none), bin, gain, and the (gradient, hessian) of the left and the right side. Ties go to the smaller feature and bin."""
    left = hist.cumsum(axis=3)
    whole = left[:, :, :1, -1:]
    right = whole - left
    score = lambda s: s[0] ** 2 / (s[1] + RIDGE)
    after = left[2][:, :, -1:] - left[2]  # every feature has its own number of bins with rows
    gain = np.where((left[2] > 0.5) & (after > 0.5), score(left) + score(right) - score(whole), -np.inf)
    flat = gain.reshape(gain.shape[0], -1)
    # sums taken in another order differ in their last digits: gains that close are ties
    top = flat.max(axis=1)
    best = np.argmax(flat >= np.where(np.isfinite(top), top - 1e-9 * np.maximum(1, np.abs(top)), np.inf)[:, None], axis=1)
    feature, place = best // gain.shape[2], best % gain.shape[2]
    node = np.arange(len(best))
    none = ~(top > 1e-9)
    feature, place = np.where(none, -1, feature), np.where(none, 0, place)
    sides = np.stack([left[:2, node, feature, place], right[:2, node, feature, place]])  # side, figure, node
    total = whole[:2, :, 0, 0]
    sides = np.where(none, np.stack([total, np.zeros_like(total)]), sides)
    return feature, place, np.where(none, 0.0, top), sides


class _Growing:
    """The trees of one model so far, by bin."""

    def __init__(self, base: float, depth: int, edges: list[np.ndarray]):
        self.base, self.depth, self.edges = base, depth, edges
        self.feature: list[np.ndarray] = []
        self.place: list[np.ndarray] = []
        self.gain: list[np.ndarray] = []
        self.value: list[np.ndarray] = []

    def begin(self) -> None:
        nodes = (1 << self.depth) - 1
        self.feature.append(np.full(nodes, -1))
        self.place.append(np.zeros(nodes, dtype=np.int64))
        self.gain.append(np.zeros(nodes))

    def below(self, bins: np.ndarray, node: np.ndarray, level: int, tree: int = -1) -> np.ndarray:
        """Node of every row one level below its node of a level, both counted within their levels."""
        at = node + (1 << level) - 1
        f = self.feature[tree][at]
        return 2 * node + ((f >= 0) & (bins[np.arange(len(bins)), f] > self.place[tree][at]))

    def nodes(self, bins: np.ndarray, levels: int, tree: int = -1) -> np.ndarray:
        """Node of every row after so many levels, counted within its level."""
        node = np.zeros(len(bins), dtype=np.int64)
        for level in range(levels):
            node = self.below(bins, node, level, tree)
        return node

    def split(self, level: int, feature: np.ndarray, place: np.ndarray, gain: np.ndarray, sides: np.ndarray, rate: float) -> None:
        at = slice((1 << level) - 1, (1 << level + 1) - 1)
        self.feature[-1][at], self.place[-1][at], self.gain[-1][at] = feature, place, gain
        if level == self.depth - 1:
            leaf = -rate * sides[:, 0] / (sides[:, 1] + RIDGE)  # side, node
            self.value.append(leaf.T.ravel())

    def margin(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        """What the trees from ``first`` on add."""
        out = np.zeros(len(bins))
        for t in range(first, len(self.value)):
            out += self.value[t][self.nodes(bins, self.depth, t)]
        return out

    def finished(self) -> Trees:
        feature, place = np.array(self.feature), np.array(self.place)
        cut = np.zeros(feature.shape)
        for f, e in enumerate(self.edges):
            cut[feature == f] = e[place[feature == f]]
        return Trees(self.base, feature, cut, np.array(self.gain), np.array(self.value))


@dataclass
class Boosting:
    """Options of a boosted fit."""

    trees: int = 100
    depth: int = 3
    rate: float = 0.1
    share: float = 0.8
    seed: int = 42


def _base(share: float) -> float:
    share = min(max(share, 1e-9), 1 - 1e-9)
    return float(np.log(share / (1 - share)))


def targets(classes: int) -> list[int]:
    """Classes that need a model of their own: two share that of the second."""
    return [1] if classes == 2 else list(range(classes))


def boost(bins: np.ndarray, key: np.ndarray, hit: np.ndarray, edges: list[np.ndarray], options: Boosting) -> Trees:
    """One model on the rows of one task."""
    width = 1 + max([len(e) for e in edges], default=0)
    model = _Growing(_base(hit.mean() if len(hit) else 0.5), options.depth, edges)
    margin = np.full(len(hit), model.base)
    for tree in range(options.trees):
        model.begin()
        seen = _drawn(key, tree, options.share, options.seed)
        g, h = _slopes(margin[seen], hit[seen])
        lines, node = np.ascontiguousarray(bins[seen].T), np.zeros(len(hit), dtype=np.int64)
        for level in range(options.depth):
            hist = histogram(lines, node[seen], 1 << level, g, h, width)
            model.split(level, *best_splits(hist), options.rate)
            node = model.below(bins, node, level)
        margin += model.value[tree][node]
    return model.finished()


# --- sums by set ------------------------------------------------------------------------------


def _summed(rows: DataFrame, partial: Callable[[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray], columns: Sequence[str]) -> dict[int, np.ndarray]:
    """Sum over the rows of every set of what ``partial`` (set, and the columns as arrays) makes of a batch: equal shapes per set.

    Tasks add up their own rows, partial sums of a set meet in ``SLOTS`` groups and then in one; one row per set comes back.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            sets = batch.column(0).to_numpy()
            for s in np.unique(sets):
                here = batch.filter(pa.array(sets == s))
                got = partial(int(s), *[_matrix(c) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False) for c in here.columns[1:]])
                sums[int(s)] = sums[int(s)] + got if int(s) in sums else got
        slot = TaskContext.get().partitionId() % SLOTS
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([slot] * len(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["set", "slot", "sums"]
            )

    def together(table: pa.Table) -> pa.Table:
        total: np.ndarray | None = None
        for v in table["sums"]:
            one = np.frombuffer(v.as_py(), dtype=np.float64)
            total = one.copy() if total is None else total + one
        return pa.table({"set": table["set"][:1], "slot": table["slot"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

    kinds = "set int, slot int, sums binary"
    parts = rows.select("set", *columns).mapInArrow(local, kinds)
    slots = parts.groupBy("set", "slot").applyInArrow(together, kinds)
    return {r["set"]: np.frombuffer(bytes(r["sums"]), dtype=np.float64) for r in slots.groupBy("set").applyInArrow(together, kinds).collect()}


def _boost_by_level(rows: DataFrame, classes: dict[int, int], edges: list[np.ndarray], options: Boosting) -> dict[int, list[Trees]]:
    """All models of all sets, one aggregation a level. Rows with margins are kept once: the table before goes when the next is written."""
    kept = [Cuts()]
    try:
        return _levels(rows, classes, edges, options, kept)
    finally:
        for cuts in kept:
            cuts.drop()


def _levels(rows: DataFrame, classes: dict[int, int], edges: list[np.ndarray], options: Boosting, kept: list[Cuts]) -> dict[int, list[Trees]]:
    width, features = 1 + max([len(e) for e in edges], default=0), len(edges)
    counts: dict[int, dict[int, int]] = {}
    for r in rows.groupBy("set", "y").count().collect():  # one row per set and class
        counts.setdefault(r["set"], {})[r["y"]] = r["count"]
    models = {s: [_Growing(_base(own.get(c, 0) / sum(own.values())), options.depth, edges) for c in targets(classes[s])] for s, own in counts.items()}
    kind = _bin_kind(edges)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = _binned(_matrix(batch.column(3)), edges).astype(kind) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([b.tobytes() for b in bins], pa.binary()), batch.column(4)], ["set", "key", "y", "bins", "margins"])

    def unpacked(column: np.ndarray) -> np.ndarray:
        return np.frombuffer(b"".join(column), dtype=kind).reshape(len(column), features)

    small = rows.select("set", "key", "y", "x", F.array().cast("array<double>").alias("margins"))
    data, written = kept[-1].cut(small.mapInArrow(reduced, "set int, key long, y int, bins binary, margins array<double>")), 0

    def margins(s: int, bins: np.ndarray, had: np.ndarray) -> np.ndarray:
        own = had if had.shape[1] else np.tile([m.base for m in models[s]], (len(bins), 1))
        return own + np.stack([m.margin(bins, written) for m in models[s]], axis=1)

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = batch.column(0).to_numpy()
            for s in np.unique(sets):
                here = batch.filter(pa.array(sets == s))
                now = margins(int(s), unpacked(here.column(3).to_numpy(zero_copy_only=False)), _matrix(here.column(4)))
                yield pa.RecordBatch.from_arrays([*here.columns[:4], pa.array(list(now), pa.list_(pa.float64()))], batch.schema.names)

    for tree in range(options.trees):
        if tree and tree % REFRESH == 0:
            kept.append(Cuts())
            data = kept[-1].cut(data.mapInArrow(rewritten, data.schema))
            kept.pop(0).drop()
            written = tree
        for own in models.values():
            for m in own:
                m.begin()
        for level in range(options.depth):

            def partial(s: int, key: np.ndarray, y: np.ndarray, packed: np.ndarray, had: np.ndarray, tree: int = tree, level: int = level) -> np.ndarray:
                seen = _drawn(key, tree, options.share, options.seed)
                bins = unpacked(packed[seen])
                margin = margins(s, bins, had[seen])
                out, lines = [], np.ascontiguousarray(bins.T)
                for i, (m, c) in enumerate(zip(models[s], targets(classes[s]))):
                    g, h = _slopes(margin[:, i], (y[seen] == c).astype(np.float64))
                    out.append(histogram(lines, m.nodes(bins, level), 1 << level, g, h, width))
                return np.concatenate([o.ravel() for o in out])

            for s, sums in _summed(data, partial, ["key", "y", "bins", "margins"]).items():
                for m, hist in zip(models[s], sums.reshape(len(models[s]), 3, 1 << level, features, width)):
                    m.split(level, *best_splits(hist), options.rate)
    return {s: [m.finished() for m in own] for s, own in models.items()}


def _boost_in_tasks(rows: DataFrame, classes: dict[int, int], edges: list[np.ndarray], options: Boosting) -> dict[int, list[Trees]]:
    """All models of all sets, one task a model: of its rows it gets keys, classes and bins, packed by batch."""
    kind, features = _bin_kind(edges), len(edges)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, key, y = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64), batch.column(2).to_numpy().astype(np.int32)
            bins = _binned(_matrix(batch.column(3)), edges).astype(kind) if batch.num_rows else np.zeros((0, features), kind)
            found = np.unique(sets)
            parts = [[v[sets == s].tobytes() for s in found] for v in (key, y, bins)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *[pa.array(p, pa.binary()) for p in parts]], ["set", "key", "y", "bins"])

    def whole(table: pa.Table) -> pa.Table:
        s, part = int(table["set"][0].as_py()), int(table["part"][0].as_py())
        key, y, bins = (np.concatenate([np.frombuffer(v.as_buffer(), dtype) for v in table[c]]) for c, dtype in (("key", np.int64), ("y", np.int32), ("bins", kind)))
        order = np.argsort(key, kind="stable")
        model = boost(bins.reshape(len(key), features)[order], key[order], (y[order] == targets(classes[s])[part]).astype(np.float64), edges, options)
        made = [np.ascontiguousarray(a, dtype=np.float64).tobytes() for a in (np.float64(model.base), model.feature, model.cut, model.gain, model.value)]
        return pa.table({"set": pa.array([s], pa.int32()), "part": pa.array([part], pa.int32()), "model": pa.array([made], pa.list_(pa.binary()))})

    models = [(s, p) for s, k in classes.items() for p in range(len(targets(k)))]
    wanted = rows.sparkSession.createDataFrame(models, "set int, part int")
    small = rows.select("set", "key", "y", "x").mapInArrow(packed, "set int, key binary, y binary, bins binary")
    # models are few and long: more tasks than models, so that few of them share one
    dealt = small.join(F.broadcast(wanted), "set").repartition(8 * max(len(models), 1), "set", "part")
    found = dealt.groupBy("set", "part").applyInArrow(whole, "set int, part int, model array<binary>").collect()
    out: dict[int, list[Trees]] = {}
    for r in sorted(found, key=lambda r: (r["set"], r["part"])):
        base, feature, cut, gain, value = (np.frombuffer(bytes(p), dtype=np.float64) for p in r["model"])
        shape = (options.trees, -1)
        out.setdefault(r["set"], []).append(Trees(float(base[0]), feature.reshape(shape).astype(np.int64), cut.reshape(shape), gain.reshape(shape), value.reshape(shape)))
    return out


# --- logistic regression ----------------------------------------------------------------------


def _moments(weights: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Summed weight, loss, gradient and second moments of the rows, in one array."""
    step = ROWS_AT_ONCE // 16
    return sum(_moments_of(weights, x[i : i + step], y[i : i + step], w[i : i + step]) for i in range(0, max(len(x), 1), step))


def _moments_of(weights: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    k, d = weights.shape
    one = np.hstack([x, np.ones((len(x), 1))])
    z = one @ weights.T
    top = z.max(axis=1)
    loss = float((w * (top + np.log(np.exp(z - top[:, None]).sum(axis=1)) - z[np.arange(len(y)), y])).sum())
    p = _softmax(z)
    off = p.copy()
    off[np.arange(len(y)), y] -= 1
    second = np.empty((k, d, k, d))
    for a in range(k):
        for b in range(a, k):
            curve = w * p[:, a] * ((a == b) - p[:, b])
            second[a, :, b, :] = second[b, :, a, :] = (one * curve[:, None]).T @ one
    return np.concatenate([[w.sum(), loss], ((w[:, None] * off).T @ one).ravel(), second.ravel()])


class _Newton:
    """Damped Newton steps on the mean loss plus an L2 penalty of 1 / rows on all weights but the intercepts."""

    def __init__(self, classes: int, features: int):
        self.weights = np.zeros((classes, features + 1))
        self.best, self.value, self.step, self.done = self.weights, np.inf, None, False

    def take(self, sums: np.ndarray, tolerance: float) -> None:
        """Goes on from the sums at ``weights``."""
        k, d = self.weights.shape
        n, loss = sums[0], sums[1]
        free = np.ones((k, d))
        free[:, -1] = 0
        value = loss / n + 0.5 * float((free * self.weights**2).sum()) / n
        if value > self.value + 1e-14:  # too far: half the step
            self.step = self.step / 2
            self.weights = self.best + self.step
            self.done = float(np.abs(self.step).max()) < 1e-12
            return
        gained = self.value - value
        self.best, self.value = self.weights, value
        slope = (sums[2 : 2 + k * d].reshape(k, d) / n + free * self.weights / n).ravel()
        # intercepts may all move by one amount without effect: a little ridge picks one solution
        second = sums[2 + k * d :].reshape(k * d, k * d) / n + np.diag((free / n + (1 - free) * 1e-9).ravel())
        if gained < tolerance * max(abs(value), 1e-12) and np.abs(slope).max() < 1e-6:
            self.done = True
            return
        self.step = -np.linalg.lstsq(second, slope, rcond=None)[0].reshape(k, d)
        self.weights = self.best + self.step

    def finished(self) -> Softmax:
        return Softmax(self.best)


def softmax_fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, max_iter: int = 100, tolerance: float = 1e-9) -> Softmax:
    """One model on the rows of one task."""
    model = _Newton(classes, x.shape[1])
    for _ in range(max_iter):
        if model.done or not len(x):
            break
        model.take(_moments(model.weights, x, y, w), tolerance)
    return model.finished()


def _softmax_in_tasks(rows: DataFrame, classes: dict[int, int], features: int, max_iter: int, tolerance: float) -> dict[int, Softmax]:
    """All models of all sets, one task a set."""

    def whole(table: pa.Table) -> pa.Table:
        s = int(table["set"][0].as_py())
        x, y, w, key = _matrix(table["x"]), table["y"].to_numpy().astype(np.int64), table["w"].to_numpy(), table["key"].to_numpy()
        order = np.argsort(key, kind="stable")
        made = softmax_fit(x[order], y[order], w[order], classes[s], max_iter, tolerance).weights.tobytes()
        return pa.table({"set": pa.array([s], pa.int32()), "model": pa.array([made], pa.binary())})

    known = rows.where(F.col("set").isin(list(classes))).select("set", "key", "y", "w", "x")
    found = known.groupBy("set").applyInArrow(whole, "set int, model binary").collect()
    return {r["set"]: Softmax(np.frombuffer(bytes(r["model"]), dtype=np.float64).reshape(classes[r["set"]], features + 1)) for r in found}


def _softmax_by_step(rows: DataFrame, classes: dict[int, int], features: int, max_iter: int, tolerance: float) -> dict[int, Softmax]:
    models = {s: _Newton(k, features) for s, k in classes.items()}
    for _ in range(max_iter):
        going = [s for s, m in models.items() if not m.done]
        if not going:
            break
        weights = {s: models[s].weights for s in going}
        found = _summed(rows.where(F.col("set").isin(going)), lambda s, y, w, x, at=weights: _moments(at[s], x, y.astype(np.int64), w), ["y", "w", "x"])
        for s in going:
            if s in found:
                models[s].take(found[s], tolerance)
            else:
                models[s].done = True
    return {s: m.finished() for s, m in models.items()}


# --- all sets ---------------------------------------------------------------------------------


def fit_sets(
    rows: DataFrame,
    classes: dict[int, int],
    features: int,
    edges: list[np.ndarray],
    *,
    kinds: Sequence[str] = ("logistic", "gbt"),
    boosting: Boosting | None = None,
    max_iter: int = 100,
    tolerance: float = 1e-9,
    cells_in_task: int = CELLS_IN_TASK,
) -> dict[tuple[str, int], Softmax | list[Trees]]:
    """Every kind of model for every set: ``classes`` gives its number of classes. A boosted fit has one model per class (see ``targets``)."""
    boosting = boosting or Boosting()
    cells = (rows.groupBy("set").count().agg(F.max("count")).first()[0] or 0) * max(features, 1)
    out: dict[tuple[str, int], Softmax | list[Trees]] = {}
    if "logistic" in kinds and cells <= cells_in_task:
        out |= {("logistic", s): m for s, m in _softmax_in_tasks(rows, classes, features, max_iter, tolerance).items()}
    elif "logistic" in kinds:
        out |= {("logistic", s): m for s, m in _softmax_by_step(rows, classes, features, max_iter, tolerance).items()}
    if "gbt" in kinds and cells <= cells_in_task * BINS_A_CELL:
        out |= {("gbt", s): m for s, m in _boost_in_tasks(rows, classes, edges, boosting).items()}
    elif "gbt" in kinds:
        out |= {("gbt", s): m for s, m in _boost_by_level(rows, classes, edges, boosting).items()}
    return out


def class_probabilities(model: Softmax | list[Trees], x: np.ndarray) -> np.ndarray:
    """Rows x classes. One model per class against the rest is normalised; where all are zero, every class is as likely."""
    if isinstance(model, Softmax):
        return model.probabilities(x)
    each = np.stack([1 / (1 + np.exp(-np.clip(m.margin(x), -500, 500))) for m in model], axis=1)
    if each.shape[1] == 1:
        return np.hstack([1 - each, each])
    total = each.sum(axis=1, keepdims=True)
    return np.where(total > 0, each / np.where(total > 0, total, 1), 1 / each.shape[1])


def probability_column(model: Softmax | list[Trees], x: Column) -> Column:
    """Array of class probabilities of the array column ``x``."""

    @pandas_udf("array<double>")
    def score(values: pd.Series) -> pd.Series:
        return pd.Series(list(class_probabilities(model, np.stack(values.to_numpy())))) if len(values) else pd.Series([], dtype=object)

    return score(x)


def margin_column(model: Trees, x: Column) -> Column:
    """Sum of the trees for the array column ``x``."""

    @pandas_udf("double")
    def score(values: pd.Series) -> pd.Series:
        return pd.Series(model.margin(np.stack(values.to_numpy())) if len(values) else [], dtype="float64")

    return score(x)
