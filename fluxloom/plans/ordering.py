"""Global order without a single task: range chunks, row positions and prefix sums.

``repartitionByRange`` balances rows by sampled quantiles of (keys, order), so one hot
key is spread over many tasks. Positions inside a chunk come from
``monotonically_increasing_id`` and are written down once (``durable``); what a chunk must know of
earlier ones is a table with one row per (chunk, key).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fluxloom.session import durable

_CHUNK_BITS = 33  # monotonically_increasing_id keeps the row position in its low 33 bits


def _columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def range_chunks(df: DataFrame, order: Sequence[str | Column], chunks: int | None = None) -> DataFrame:
    """Rows in global order, with ``_pos`` (increasing) and ``_chunk``; lineage is cut."""
    wanted = chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = _columns(order)
    placed = df.repartitionByRange(wanted, *by).sortWithinPartitions(*by)
    placed = placed.withColumn("_pos", F.monotonically_increasing_id())
    return durable(placed).withColumn("_chunk", F.shiftright("_pos", _CHUNK_BITS))


def _earlier(keys: Sequence[str]):
    return W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)


def _same(keys: Sequence[str], left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in (*keys, "_chunk") else F.col(c) for c in right.columns])
    on = left["_chunk"] == renamed["_r__chunk"]
    for k in keys:
        on = on & left[k].eqNullSafe(renamed[f"_r_{k}"])
    return left.join(renamed, on, how).drop("_r__chunk", *[f"_r_{k}" for k in keys])


def running_index(
    df: DataFrame, order: Sequence[str | Column], keys: Sequence[str] = (), name: str = "idx", chunks: int | None = None
) -> DataFrame:
    """Zero-based position of every row inside its key, in ``order``."""
    return numbered(range_chunks(df, [*keys, *order], chunks), keys, name).drop("_pos", "_chunk")


def running_sums(
    df: DataFrame,
    order: Sequence[str | Column],
    sums: Mapping[str, Column],
    keys: Sequence[str] = (),
    chunks: int | None = None,
) -> DataFrame:
    """Inclusive prefix sums inside each key, in ``order`` (rows must be unique in it)."""
    keys = list(keys)
    staged = df.select("*", *[c.alias(f"_x_{n}") for n, c in sums.items()])
    rows = range_chunks(staged, [*keys, *order], chunks)
    totals = rows.groupBy("_chunk", *keys).agg(*[F.sum(f"_x_{n}").alias(f"_t_{n}") for n in sums])
    offsets = totals.select(
        "_chunk", *keys, *[F.coalesce(F.sum(f"_t_{n}").over(_earlier(keys)), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    here = W.partitionBy("_chunk", *keys).orderBy("_pos").rowsBetween(W.unboundedPreceding, 0)
    local = rows.select("*", *[F.coalesce(F.sum(f"_x_{n}").over(here), F.lit(0)).alias(f"_l_{n}") for n in sums])
    out = _same(keys, local, offsets)
    for n in sums:
        out = out.withColumn(n, F.col(f"_l_{n}") + F.col(f"_o_{n}"))
    return out.drop("_pos", "_chunk", *[f"_{p}_{n}" for n in sums for p in "xlo"])


def beside(rows: DataFrame, value: Column, keys: Sequence[str] = (), name: str = "next", after: bool = True) -> DataFrame:
    """``value`` on the row after (before) each one inside its key, null at the end; ``rows`` have ``_pos`` and ``_chunk`` and need not be all of them."""
    keys = list(keys)
    here = W.partitionBy("_chunk", *keys).orderBy("_pos")
    staged = rows.withColumn("_v", value)
    edge = staged.groupBy("_chunk", *keys).agg((F.min_by if after else F.max_by)("_v", "_pos").alias("_edge"))
    beyond = W.partitionBy(*keys).orderBy(F.desc("_chunk") if after else "_chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = edge.select("_chunk", *keys, F.last("_edge").over(beyond).alias("_carry"))
    local = staged.withColumn("_near", (F.lead if after else F.lag)("_v").over(here))
    return _same(keys, local, carry).withColumn(name, F.coalesce("_near", "_carry")).drop("_v", "_near", "_carry")


def numbered(rows: DataFrame, keys: Sequence[str] = (), name: str = "idx") -> DataFrame:
    """Zero-based position of every row of ``range_chunks`` inside its key; keeps ``_pos`` and ``_chunk``."""
    keys = list(keys)
    sizes = rows.groupBy("_chunk", *keys).agg(F.count("*").alias("_n"), F.min("_pos").alias("_first"))
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(_earlier(keys)), F.lit(0)))
    return _same(keys, rows, offsets.drop("_n")).withColumn(name, F.col("_pos") - F.col("_first") + F.col("_before")).drop("_first", "_before")


def with_previous(
    df: DataFrame, order: str, keys: Sequence[str] = (), name: str = "prev", tie: Sequence[str] = (), chunks: int | None = None
) -> DataFrame:
    """Value of ``order`` on the row before, inside each key (null on the first row)."""
    keys = list(keys)
    rows = range_chunks(df, [*keys, order, *tie], chunks)
    tails = rows.groupBy("_chunk", *keys).agg(F.max(order).alias("_tail"))
    carried = tails.select("_chunk", *keys, F.max("_tail").over(_earlier(keys)).alias("_carry"))
    local = rows.withColumn("_lag", F.lag(order).over(W.partitionBy("_chunk", *keys).orderBy("_pos")))
    out = _same(keys, local, carried)
    return out.withColumn(name, F.coalesce("_lag", "_carry")).drop("_pos", "_chunk", "_lag", "_carry")


def carried_values(
    df: DataFrame, order: Sequence[str | Column], columns: Sequence[str], keys: Sequence[str] = (), backward: bool = False
) -> DataFrame:
    """Adds ``_fill_<column>``: the nearest non-null value at or before (after) each row."""
    keys = list(keys)
    rows = range_chunks(df, [*keys, *order])
    pick = F.min_by if backward else F.max_by
    edge = rows.groupBy("_chunk", *keys).agg(*[pick(F.col(c), F.when(F.col(c).isNotNull(), F.col("_pos"))).alias(f"_e_{c}") for c in columns])
    beyond = W.partitionBy(*keys).orderBy(F.desc("_chunk") if backward else "_chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = edge.select("_chunk", *keys, *[F.last(f"_e_{c}", ignorenulls=True).over(beyond).alias(f"_c_{c}") for c in columns])
    here = W.partitionBy("_chunk", *keys).orderBy(F.desc("_pos") if backward else "_pos").rowsBetween(W.unboundedPreceding, 0)
    local = rows.select("*", *[F.last(c, ignorenulls=True).over(here).alias(f"_l_{c}") for c in columns])
    out = _same(keys, local, carry)
    return out.select(*df.columns, *[F.coalesce(f"_l_{c}", f"_c_{c}").alias(f"_fill_{c}") for c in columns])
