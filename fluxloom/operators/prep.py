"""Feature selection, cleaning, imputation, scaling, weights, splits and oversampling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StringIndexer
from pyspark.sql import DataFrame, functions as F, types as T

from fluxloom.functions.missing import nan_as_null
from fluxloom.plans.ordering import carried_values, running_index
from fluxloom.plans.quantiles import column_quantiles
from fluxloom.session import Cuts, durable, scratch

# Columns that would leak the label, and identifiers.
LEAK_PREFIXES = ("label_", "num_flares_", "max_magnitude_", "flare_classes_")
ID_COLUMNS = ("timestamp", "region_number")


MOST_PIVOTS = 2048  # of a class in the search for neighbours
AT_ONCE = 1 << 15  # rows or pairs of vectors a task has in hand
CELLS_AT_ONCE = 1 << 21  # distances a task has in hand
LINES = 256  # queries that are compared together
FIRST_SLICE = 2048  # rows that bound how far a query's nearest are


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def feature_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns that are neither identifiers nor derived from the label."""
    return [c for c in _numeric(df) if c not in (*ID_COLUMNS, *exclude) and not c.startswith(LEAK_PREFIXES)]


def clean_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null, NaN and infinities become 0."""
    wanted = set(columns)

    def fixed(c: str) -> str:
        v = f"double(`{c}`)"
        return f"CASE WHEN {v} IS NULL OR isnan({v}) OR abs({v}) = double('inf') THEN 0e0 ELSE {v} END AS `{c}`"

    return df.selectExpr(*[fixed(c) if c in wanted else f"`{c}`" for c in df.columns])


def varying_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns whose sample deviation is neither zero nor undefined (one pass, one row back)."""
    row = nan_as_null(df, columns).agg(*[F.stddev_samp(c).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] is not None and row[c] > 0]


def drop_constant(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    keep = set(varying_columns(df, columns))
    return df.drop(*[c for c in columns if c not in keep])


def align_features(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` plus the trained features in their order; missing ones are 0."""
    have = set(df.columns)
    return df.select(*keep, *[(F.col(n).cast("double") if n in have else F.lit(0.0)).alias(n) for n in names])


def sparse_columns(df: DataFrame, columns: Sequence[str], threshold: float = 0.5) -> list[str]:
    """Columns with more than ``threshold`` missing, for tables of more than one row."""
    row = nan_as_null(df, columns).agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    return [c for c in columns if row["_n"] > 1 and row[c] / row["_n"] > threshold]


def drop_sparse(df: DataFrame, columns: Sequence[str], threshold: float = 0.5) -> DataFrame:
    return df.drop(*sparse_columns(df, columns, threshold))


# --- imputation ---------------------------------------------------------------------------


def _one_row(df: DataFrame, row: DataFrame) -> DataFrame:
    return df.join(F.broadcast(row), F.lit(True))  # ``row`` is one row by construction


def _quantile_row(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """One row with ``<column>@<i>`` for the i-th probability."""
    q = column_quantiles(df, columns, probabilities)
    return q.agg(
        *[
            F.max(F.when((F.col("column_name") == c) & (F.col("probability") == p), F.col("value"))).alias(f"{c}@{i}")
            for c in columns
            for i, p in enumerate(probabilities)
        ]
    )


def impute(
    df: DataFrame,
    strategy: str,
    columns: Sequence[str],
    *,
    order_by: Sequence[str] = (),
    keys: Sequence[str] = (),
    fill_value: float = 0.0,
) -> DataFrame:
    """Fill missing numbers (NaN is missing); what a strategy leaves open gets the column mean, or 0.

    forward_fill / backward_fill run in ``order_by`` inside each key and are completed from the
    other side; mean and median of an empty column count as 0; drop removes incomplete rows.
    """
    keys, df = list(keys), nan_as_null(df, columns)
    if strategy == "drop":
        return df.dropna(subset=list(columns))
    if strategy in ("zero", "constant"):
        value = 0.0 if strategy == "zero" else float(fill_value)
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(value)) for c in columns})
    if strategy == "median":
        filled = _one_row(df, _quantile_row(df, columns, [0.5]))
        return filled.select(
            *[F.coalesce(F.col(c).cast("double"), F.col(f"`{c}@0`"), F.lit(0.0)).alias(c) if c in columns else F.col(c) for c in df.columns]
        )
    means = df.agg(*[F.avg(c).alias(f"_mean_{c}") for c in columns])
    if strategy == "mean":
        filled, steps = df, lambda c: [F.col(c).cast("double")]
    elif strategy in ("forward_fill", "backward_fill"):
        back = strategy == "backward_fill"
        carried = carried_values(df, list(order_by), columns, keys, backward=back)
        rank = F.struct(*order_by)
        end = (F.max_by if back else F.min_by)
        ends = df.groupBy(*keys).agg(*[end(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(f"_end_{c}") for c in columns])
        filled = carried.join(ends, keys) if keys else _one_row(carried, ends)
        steps = lambda c: [F.col(f"_fill_{c}").cast("double"), F.col(f"_end_{c}").cast("double")]
    else:
        raise ValueError(f"unknown strategy {strategy}")
    filled = _one_row(filled, means)
    return filled.select(*[F.coalesce(*steps(c), F.col(f"_mean_{c}"), F.lit(0.0)).alias(c) if c in columns else F.col(c) for c in df.columns])


# --- scaling ------------------------------------------------------------------------------


def scale(df: DataFrame, columns: Sequence[str], method: str) -> DataFrame:
    """minmax, standard (population deviation) or robust (median, quartiles); nulls and NaN count as 0.

    A column without spread becomes 0.
    """
    zeroed = nan_as_null(df, columns).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    if method == "robust":
        figures = _quantile_row(zeroed, columns, [0.25, 0.5, 0.75])
        centre, spread = (lambda c: F.col(f"`{c}@1`")), (lambda c: F.col(f"`{c}@2`") - F.col(f"`{c}@0`"))
    elif method == "minmax":
        figures = zeroed.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("_lo", F.min), ("_hi", F.max))])
        centre, spread = (lambda c: F.col(f"_lo_{c}")), (lambda c: F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))
    elif method == "standard":
        figures = zeroed.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("_m", F.avg), ("_s", F.stddev_pop))])
        centre, spread = (lambda c: F.col(f"_m_{c}")), (lambda c: F.col(f"_s_{c}"))
    else:
        raise ValueError(f"unknown method {method}")
    joined = _one_row(zeroed, figures)

    def scaled(c: str):
        s = spread(c)
        return (F.col(c) - centre(c)) / F.when(s == 0, 1.0).otherwise(s)

    return joined.select(*[scaled(c).alias(c) if c in columns else F.col(c) for c in df.columns])


# --- labels, weights, splits --------------------------------------------------------------


def index_labels(df: DataFrame, label: str, output: str = "label_index") -> DataFrame:
    """Alphabetical index of the label."""
    return StringIndexer(inputCol=label, outputCol=output, stringOrderType="alphabetAsc").fit(df).transform(df)


def _by_label(df: DataFrame, figures: DataFrame, label: str) -> DataFrame:
    """``df`` with the figures of each row's label; null is a label of its own. The figures are written first: their known size lets
    the planner broadcast them, instead of hashing the whole table on a handful of labels."""
    own = durable(figures.withColumnRenamed(label, "_label"))
    return df.join(own, df[label].eqNullSafe(own["_label"])).drop("_label")


def class_weights(df: DataFrame, label: str, output: str = "weight") -> DataFrame:
    """Balanced weights n / (classes * rows of the class); null is a class of its own."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    totals = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    weights = _one_row(counts, totals).select(label, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias(output))
    return _by_label(df, weights, label)


def draw(ident: str, seed: int):
    """Repeatable order: a digest of the row id and the seed, the same on every retry."""
    return F.md5(F.concat_ws("-", F.col(ident).cast("string"), F.lit(str(seed))))


def _ranked_in_label(df: DataFrame, label: str, ident: str, seed: int) -> DataFrame:
    return running_index(df.withColumn("_draw", draw(ident, seed)), ["_draw", ident], [label], name="_i").drop("_draw")


def stratified_split(df: DataFrame, label: str, ident: str, *, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: the given share of every label, rows without label included, drawn repeatably."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    ranked = _by_label(_ranked_in_label(df, label, ident, seed), sizes, label)
    return ranked.withColumn("is_test", F.col("_i") < F.floor(F.col("_n") * test_share + 0.5)).drop("_i", "_n")


def fold_column(df: DataFrame, label: str, ident: str, *, folds: int = 5, seed: int = 42, output: str = "fold") -> DataFrame:
    """Fold number 0..folds-1, even in every label."""
    return _ranked_in_label(df, label, ident, seed).withColumn(output, F.pmod("_i", F.lit(folds)).cast("int")).drop("_i")


def tail_split(df: DataFrame, order: Sequence[str], *, test_share: float = 0.2) -> DataFrame:
    """Adds ``is_test``: the last share of the rows in order."""
    ranked = running_index(df, list(order), name="_i")
    total = df.agg(F.count("*").alias("_n"))
    return _one_row(ranked, total).withColumn("is_test", F.col("_i") >= F.floor(F.col("_n") * (1 - test_share) + 1e-9)).drop("_i", "_n")


# --- oversampling -------------------------------------------------------------------------


def _needed(row: np.ndarray, fold: np.ndarray, k: int, folds: int) -> np.ndarray:
    """Which of the entries, sorted by row and nearness, are among the k first of their row, or among those outside of some fold."""
    kept = np.zeros(len(row), dtype=bool)
    first = np.searchsorted(row, row)
    for f in range(max(folds, 1)):
        out = np.ones(len(row), dtype=bool) if not folds else fold != f
        before = np.cumsum(out) - out
        kept |= out & (before - before[first] < k)
    return kept


def _kth(rough: np.ndarray, fold: np.ndarray, k: int, folds: int) -> np.ndarray:
    """Of every line a bound that at least k values keep to, whichever fold is left out."""
    each = [rough[:, fold == f] for f in range(folds)] if folds else [rough]
    least = [np.partition(r, k - 1, axis=1)[:, k - 1] if r.shape[1] >= k else np.full(len(r), np.inf) for r in each]
    return np.partition(np.stack(least), 1, axis=0)[1] if len(least) > 1 else least[0]


def exact_neighbours(points: np.ndarray, ids: np.ndarray, others: np.ndarray, other_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other's id, squared distance) of the k nearest others of every point, itself left out; ties go to the smaller id."""
    row, place, dist = nearest(points, ids, others, other_ids, k)
    return row, other_ids[place], dist


def nearest(
    points: np.ndarray, ids: np.ndarray, others: np.ndarray, other_ids: np.ndarray, k: int, *, reach: np.ndarray | None = None, fold: np.ndarray | None = None, folds: int = 0
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``exact_neighbours`` with the others' places instead of their ids. With ``folds``, the k nearest outside of each ``fold`` of the others. ``reach`` is
    how far it is worth looking from a point.

    Products of the vectors find who may be near: a first slice of the others bounds how far that is, and what is found tightens it for the next.
    The distances that count are taken from the differences, ``AT_ONCE`` pairs at a time, as any number of rows may be as near.
    """
    fold = np.zeros(len(others), dtype=np.int64) if fold is None else fold
    norm = (others * others).sum(1)
    most = norm.max() if len(norm) else 0.0
    right = np.hstack([others, norm[:, None]])
    slices = [0, *range(FIRST_SLICE, len(others), CELLS_AT_ONCE // LINES)]
    out = []
    for s in range(0, len(points) if len(others) else 0, LINES):
        block, own = points[s : s + LINES], ids[s : s + LINES]
        square = (block * block).sum(1)
        left = np.hstack([-2 * block, np.ones((len(block), 1))])
        limit = np.full(len(block), np.inf) if reach is None else reach[s : s + LINES] ** 2
        slack = 1e-9 * (square + most)
        row, place, dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for a, b in zip(slices, [*slices[1:], len(others)]):
            rough = left @ right[a:b].T  # but for the point's own square
            if a == 0 and not np.isfinite(limit).all():
                rough[own[:, None] == other_ids[None, a:b]] = np.inf
                limit = np.fmin(limit, np.maximum(_kth(rough, fold[a:b], k, folds) + square, 0))
            at, near = np.nonzero(rough <= (limit + slack - square)[:, None])
            near += a
            apart = own[at] != other_ids[near]
            at, near = at[apart], near[apart]
            for i in range(0, len(at), AT_ONCE):
                some, these = at[i : i + AT_ONCE], near[i : i + AT_ONCE]
                exact = ((block[some] - others[these]) ** 2).sum(1)
                real = np.isfinite(exact)
                row, place, dist = np.concatenate([row, some[real]]), np.concatenate([place, these[real]]), np.concatenate([dist, exact[real]])
                order = np.lexsort((other_ids[place], dist, row))
                order = order[_needed(row[order], fold[place[order]], k, folds)]
                row, place, dist = row[order], place[order], dist[order]
            if len(row):
                # the last of a row's entries is as far as it is worth looking once there are k outside of every fold
                counts = np.stack([np.bincount(row[fold[place] != f] if folds else row, minlength=len(block)) for f in range(max(folds, 1))])
                full = np.flatnonzero(counts.min(axis=0) >= k)
                ends = np.searchsorted(row, full, side="right") - 1
                limit[full] = np.fmin(limit[full], dist[ends])
        out.append((s + row, place, dist))
    kinds = (np.int64, np.int64, np.float64)
    return tuple(np.concatenate(c) for c in zip(*out)) if out else tuple(np.zeros(0, c) for c in kinds)


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)


def _to_pivots(pivots: dict, label: object, x: np.ndarray) -> np.ndarray:
    """Distance of every row to every pivot of its class."""
    own = pivots[label]
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (own * own).sum(1)[None, :] - 2 * x @ own.T, 0))


def near_order(points: np.ndarray) -> np.ndarray:
    """Numbers of the points in an order that keeps near ones together: halved again and again by the widest coordinate."""
    done, left = [], [np.arange(len(points))]
    while left:
        own = left.pop()
        if len(own) <= 2:
            done.append(own)
            continue
        axis = np.ptp(points[own], axis=0).argmax()
        own = own[np.argsort(points[own, axis], kind="stable")]
        left += [own[len(own) // 2 :], own[: len(own) // 2]]
    return np.concatenate(done) if done else np.zeros(0, np.int64)


def class_neighbours(rows: DataFrame, *, k: int, block_rows: int, cuts: Cuts, folds: int = 0) -> DataFrame:
    """(label, id, fold, near): the k nearest rows of the same class for every row that seeds, as (dist, other, its fold), nearest first. With ``folds``, ``rows`` has
    a fold, and near are the k nearest outside of each other fold: one search for as many tables that leave out a fold each.

    ``rows`` has label, id, vec, _n (rows of the class), _i (its place in a drawn order) and seeds. The first ``sqrt(_n)`` rows of a class, ``MOST_PIVOTS`` at
    most, are its pivots; a row belongs to the cell of the nearest one. Cells are packed into blocks of about ``block_rows`` rows, near cells
    together, and a larger cell is cut into several. A row's own block gives its k best so far; by the triangle inequality only cells whose radius
    reaches into that distance can hold nearer ones, and only blocks with such cells are visited: a row travels once per block, not per cell.
    A task has the rows of one block and a block's worth of queries; ids and distances alone leave it. Results are exact whatever the
    pivots; they decide how much is left out.
    """
    count = F.least(F.ceil(F.sqrt("_n")), F.lit(MOST_PIVOTS))
    pivots: dict[object, list] = {}
    for r in rows.where(F.col("_i") < count).select("label", "vec").orderBy("label", "_i").collect():  # MOST_PIVOTS a class at most
        pivots.setdefault(r["label"], []).append(r["vec"])
    pivots = {label: np.array(vecs, dtype=np.float64) for label, vecs in pivots.items()}
    label_type = rows.schema["label"].dataType
    rows = rows if folds else rows.withColumn("fold", F.lit(0))

    def by_label(batch: pa.RecordBatch) -> Iterator[tuple[object, np.ndarray]]:
        codes = batch.column(0).dictionary_encode()
        at = codes.indices.to_numpy()
        for c, label in enumerate(codes.dictionary.to_pylist()):
            yield label, np.flatnonzero(at == c)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of which the distances to all pivots fit."""
        step = max(1, CELLS_AT_ONCE // MOST_PIVOTS)
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                yield batch.slice(i, step)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cell, dist = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows)
            x = _vectors(batch.column(2))
            for label, own in by_label(batch):
                far = _to_pivots(pivots, label, x[own])
                cell[own] = far.argmin(axis=1)
                dist[own] = far[np.arange(len(own)), cell[own]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(dist)], [*batch.schema.names, "cell", "away"])

    kinds = T.StructType([rows.schema[c] for c in ("label", "id", "vec", "seeds", "fold")])
    placed = cuts.cut(rows.select("label", "id", "vec", "seeds", "fold").mapInArrow(assign, T.StructType(kinds.fields + [T.StructField("cell", T.LongType()), T.StructField("away", T.DoubleType())])))
    sizes: dict[object, dict[int, tuple[int, float]]] = {}
    for r in placed.groupBy("label", "cell").agg(F.count("*").alias("members"), F.max("away").alias("radius")).collect():  # one row per pivot
        sizes.setdefault(r["label"], {})[r["cell"]] = (r["members"], r["radius"])
    # of every pivot: its radius, its cell's first block and number of blocks
    radius, first, parts = {}, {}, {}
    for label, own in pivots.items():
        found = sizes.get(label, {})
        radius[label] = np.array([found.get(c, (0, -np.inf))[1] for c in range(len(own))])
        first[label], parts[label] = np.zeros(len(own), np.int64), np.ones(len(own), np.int64)
        block = held = 0
        for c in near_order(own):
            members = found.get(int(c), (0, 0))[0]
            alone = members > block_rows or (members and not np.isfinite(radius[label][c]))  # rows without a distance keep to their cell
            if held and (alone or held + members > block_rows):
                block, held = block + 1, 0
            first[label][c], parts[label][c] = block, max(1, -(-members // block_rows))
            if alone:
                block, held = block + int(parts[label][c]), 0
            else:
                held += members
    blocks = rows.sparkSession.createDataFrame(
        [(label, c, int(first[label][c]), int(parts[label][c])) for label in pivots for c in range(len(pivots[label]))],
        T.StructType([T.StructField("label", label_type), T.StructField("cell", T.LongType()), T.StructField("first", T.LongType()), T.StructField("parts", T.LongType())]),
    )
    members = placed.join(F.broadcast(blocks), ["label", "cell"]).select("label", "cell", "id", "vec", "seeds", "fold", "first", "parts", (F.col("first") + F.pmod(F.xxhash64("id"), "parts")).alias("block"))
    found_type = T.StructType([T.StructField("label", label_type), *[T.StructField(c, kind) for c, kind in (("id", T.LongType()), ("fold", T.IntegerType()), ("other", T.LongType()), ("dist", T.DoubleType()), ("of", T.IntegerType()))]])

    def open_cells(label: object, x: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Which cells may hold rows within ``limit`` of each of ``x``."""
        far = _to_pivots(pivots, label, x)
        # products round: a little more than the triangle inequality asks for
        return far - radius[label][None, :] <= (limit * (1 + 1e-9) + 1e-7 * (1 + far.max(axis=1)))[:, None]

    def compare(table: pa.Table) -> pa.Table:
        """Nearest members of a block for the queries that visit it; cells out of reach of 256 neighbouring queries are skipped."""
        label, asks = table["label"][0].as_py(), table["side"].to_numpy() == 0
        x, ids, cell, limit, fold = _vectors(table["vec"]), table["id"].to_numpy(), table["cell"].to_numpy(), table["reach"].to_numpy(), table["fold"].to_numpy()
        place = {int(c): i for i, c in enumerate(near_order(pivots[label]))}
        mine, have = np.flatnonzero(asks), np.flatnonzero(~asks)
        mine = mine[np.argsort([place[int(c)] for c in cell[mine]], kind="stable")]
        out = []
        for i in range(0, len(mine), LINES):
            own = mine[i : i + LINES]
            near = have if not np.isfinite(limit[own]).all() else have[open_cells(label, x[own], limit[own]).any(axis=0)[cell[have]]]
            row, place, dist = nearest(x[own], ids[own], x[near], ids[near], k, reach=limit[own], fold=fold[near], folds=folds)
            out.append((ids[own][row], fold[own][row], ids[near][place], dist, fold[near][place]))
        empty = [np.zeros(0, kind) for kind in (np.int64, np.int32, np.int64, np.float64, np.int32)]
        got = [np.concatenate(p) for p in zip(*out)] if out else empty
        names = table["label"].combine_chunks()
        return pa.table({"label": names.take(pa.array(np.zeros(len(got[0]), np.int64))), **{c: pa.array(v) for c, v in zip(("id", "fold", "other", "dist", "of"), got)}})

    def visited(queries: DataFrame) -> DataFrame:
        """k best of each query (label, block, id, vec, cell, reach) in the block; queries of a block are dealt out, too."""
        dealt = queries.groupBy("label", "block").agg(F.expr(f"(count(*) + {block_rows - 1}) div {block_rows}").alias("shares"))
        ask = queries.join(F.broadcast(dealt), ["label", "block"])
        ask = ask.select("label", "block", "id", "fold", "vec", "cell", "reach", F.pmod(F.xxhash64("id", F.lit(1)), "shares").alias("part"), F.lit(0).alias("side"))
        have = members.join(F.broadcast(dealt), ["label", "block"])
        have = have.select("label", "block", "id", "fold", "vec", "cell", F.lit(0.0).alias("reach"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("part"), F.lit(1).alias("side"))
        return ask.unionByName(have).groupBy("label", "block", "part").applyInArrow(compare, found_type)

    def best(pairs: DataFrame) -> DataFrame:
        near = F.array_sort(F.collect_list(F.struct("dist", "other", "of")))
        return pairs.groupBy("label", "id", "fold").agg((near if folds else F.slice(near, 1, k)).alias("near"))

    seeds = members.where("seeds")
    everywhere = F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1))
    own = cuts.cut(best(visited(seeds.select("label", everywhere.alias("block"), "id", "fold", "vec", "cell", F.lit(float("inf")).alias("reach")))))
    last = lambda near: F.when(F.size(near) >= k, F.sqrt(F.get(near, F.lit(k - 1))["dist"])).otherwise(F.lit(float("inf")))
    reach = last(F.col("near"))
    if folds:  # the farthest of those that the tables without another fold ask for
        outside = lambda f: F.filter("near", lambda x: x["of"] != f)
        reach = F.greatest(reach, *[F.when(F.col("fold") == f, 0.0).otherwise(last(outside(f))) for f in range(folds)])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Further blocks that may hold nearer rows."""
        for batch in slices(batches):
            x, cell, limit = _vectors(batch.column(3)), batch.column(1).to_numpy(), batch.column(4).to_numpy(zero_copy_only=False)  # fold comes last
            for label, rows_of in by_label(batch):
                open_ = open_cells(label, x[rows_of], limit[rows_of])
                # a cell may lie in several blocks, a block may hold several cells
                reached = np.zeros((len(rows_of), int((first[label] + parts[label]).max())), dtype=bool)
                for c in np.flatnonzero(open_.any(axis=0)):
                    reached[:, first[label][c] : first[label][c] + parts[label][c]] |= open_[:, c : c + 1]
                had = cell[rows_of]
                number = np.arange(reached.shape[1])[None, :]
                reached &= (number < first[label][had][:, None]) | (number >= (first[label][had] + parts[label][had])[:, None])
                pairs = np.stack(np.nonzero(reached), axis=1)
                for i in range(0, len(pairs), AT_ONCE):
                    picked = pa.array(rows_of[pairs[i : i + AT_ONCE, 0]])
                    columns = [batch.column(0), batch.column(2), batch.column(5), batch.column(3), batch.column(1), batch.column(4)]
                    took = [c.take(picked) for c in columns]
                    yield pa.RecordBatch.from_arrays([took[0], pa.array(pairs[i : i + AT_ONCE, 1]), *took[1:]], ["label", "block", "id", "fold", "vec", "cell", "reach"])

    asked = seeds.join(own.select("label", "id", "fold", reach.alias("reach")), ["label", "id", "fold"], "left").select("label", "cell", "id", "vec", F.coalesce("reach", F.lit(float("inf"))).alias("reach"), "fold")
    visits = T.StructType([rows.schema["label"], T.StructField("block", T.LongType()), rows.schema["id"], rows.schema["fold"], rows.schema["vec"], T.StructField("cell", T.LongType()), T.StructField("reach", T.DoubleType())])
    further = cuts.cut(asked.mapInArrow(others, visits))
    pairs = own.select("label", "id", "fold", F.explode("near").alias("x")).select("label", "id", "fold", "x.other", "x.dist", "x.of").unionByName(visited(further))
    return best(pairs)


def smote(
    df: DataFrame,
    label: str,
    ident: str,
    columns: Sequence[str],
    *,
    k: int = 5,
    seed: int = 42,
    block_rows: int = 30_000,
    within: str | None = None,
    folded: tuple[str, str, str] | None = None,
    folds: int = 0,
) -> DataFrame:
    """Synthetic rows (label + columns) that bring every class to the size of the largest; with ``within``, a column that the label
    determines, to the largest with the same value of it, so that many tables are balanced at once.

    Each is a point between a row and one of its k nearest rows of the same class. Neighbours are exact (``class_neighbours``). Draws come from
    digests of the row id. Ids are unique in a class.

    Tables that repeat the same rows, each without one fold, share one search: ``folded`` names the columns of the class that the labels of those tables
    have in common, of the row's fold (0 to ``folds`` - 1), and of the fold that the table leaves out (``folds`` in the table of all rows, which must be there).
    """
    by, shared = [within] if within else [], ["base", "fold", "without"] if folded else []
    with scratch() as cuts:
        sizes = cuts.cut(df.groupBy(label, *by).agg(F.count("*").alias("_n")))
        top = sizes.groupBy(*by).agg(F.max("_n").alias("_top"))
        need = (sizes.join(top, by) if by else _one_row(sizes, top)).where("_n < _top and _n > 1").select(label, "_n", (F.col("_top") - F.col("_n")).alias("_need"))
        vec = F.array(*[F.col(c).cast("double") for c in columns]).alias("vec")
        names = [F.col(c).alias(name) for c, name in zip(folded or (), shared)]
        rows = df.join(need, label).select(F.col(label).alias("label"), F.col(ident).cast("bigint").alias("id"), vec, "_n", "_need", *names)
        drawn = lambda rows: running_index(rows.withColumn("_draw", draw("id", seed)), ["_draw", "id"], ["label"], name="_i")
        copies = F.expr("_need div _n + if(_i < _need % _n, 1, 0)")
        ranked = cuts.cut(drawn(rows).withColumn("copies", copies).withColumn("seeds", F.col("copies") > 0))
        seeds = ranked.where("seeds")
        if not folded:
            near = class_neighbours(ranked, k=k, block_rows=block_rows, cuts=cuts)
            spread, pool, here = seeds.join(near.select("label", "id", "near"), ["label", "id"]), ranked.select("label", F.col("id").alias("other"), F.col("vec").alias("end")), ["label", "other"]
        else:
            asked = cuts.cut(seeds.select(F.col("base").alias("label"), "id").distinct().withColumn("seeds", F.lit(True)))
            whole = df.where(F.col(folded[2]) == folds).join(F.broadcast(sizes.select(label, "_n")), label)
            whole = whole.select(F.col(folded[0]).alias("label"), "_n", F.col(ident).cast("bigint").alias("id"), vec, F.col(folded[1]).cast("int").alias("fold"))
            whole = whole.join(F.broadcast(asked.select("label").distinct()), "label").join(asked, ["label", "id"], "left").withColumn("seeds", F.coalesce("seeds", F.lit(False)))
            every = cuts.cut(drawn(whole))
            found = class_neighbours(every, k=k, block_rows=block_rows, cuts=cuts, folds=folds).groupBy(F.col("label").alias("base"), "id").agg(F.collect_list(F.struct("fold", "near")).alias("found"))
            own = F.flatten(F.transform(F.filter("found", lambda f: f["fold"] != F.col("without")), lambda f: f["near"]))
            near = F.slice(F.array_sort(F.filter(own, lambda x: x["of"] != F.col("without"))), 1, k)
            spread = seeds.join(found, ["base", "id"]).withColumn("near", near).where(F.size("near") > 0)
            pool, here = every.select(F.col("label").alias("base"), F.col("id").alias("other"), F.col("vec").alias("end"), F.col("fold").alias("of")), ["base", "other"]
        spread = spread.select("label", "id", "vec", "near", *[c for c in shared if c != "fold"], F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"))
        digest = F.xxhash64("id", "copy", F.lit(seed))
        share = F.pmod(F.xxhash64("id", "copy", F.lit(seed + 1)), F.lit(1_000_003)) / F.lit(1_000_003.0)
        chosen = spread.select("label", "vec", share.alias("share"), F.get(F.col("near"), F.pmod(digest, F.size("near")).cast("int"))["other"].alias("other"), *[c for c in shared if c != "fold"])
        ends = chosen.join(pool, here)
        ends = ends.where("of <> without") if folded else ends
        point = F.zip_with("vec", "end", lambda x, y: x + F.col("share") * (y - x))
        return durable(ends.select(F.col("label").alias(label), point.alias("_v")).select(label, *[F.col("_v")[i].alias(c) for i, c in enumerate(columns)]))
