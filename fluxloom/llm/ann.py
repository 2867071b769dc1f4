"""Nearest neighbours by adaptive dimension scan over inverted lists.

A bounded sample places list centres; every row goes to its nearest centre's list, and large lists are cut into blocks by
hashed id. A query visits the blocks of the lists nearest to it; where many visit one list they are
dealt to copies of its blocks, so a task is bounded on both sides. Inside a block the vectors are rotated by one random rotation and stored
in column blocks. After each column block the partial distance, scaled up to all dimensions, is tested against the
tenth best so far: a candidate that is farther by more than the test's margin and a slack for rounding is abandoned. Survivors get their exact distance on the
original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fluxloom.llm.vectors import common_width, matrix, usable
from fluxloom.session import durable, scratch

SAMPLE = 16_384  # rows that place the centres: those of smallest hashed id
LISTS = 128
PROBED = 0.8  # share of the lists a query visits; isotropic data needs most of them
BLOCK_ROWS = 2048
QUERY_ROWS = 32_768  # queries that one task compares with a block; more are dealt to several copies of it
COLUMNS = 16
MARGIN = 3.0
ROUNDING = 1e-12


def centres(sample: np.ndarray, lists: int, rounds: int = 10, seed: int = 11) -> np.ndarray:
    """Lloyd's algorithm; empty lists keep their last centre."""
    rng = np.random.default_rng(seed)
    c = sample[np.sort(rng.choice(len(sample), lists, replace=False))].copy()
    for _ in range(rounds):
        near = nearest(sample, c)
        count = np.bincount(near, minlength=lists)
        for d in range(c.shape[1]):
            total = np.bincount(near, sample[:, d], minlength=lists)
            c[count > 0, d] = total[count > 0] / count[count > 0]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(axis=1) - 2 * x @ c.T, axis=1)


def rotation(width: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, width)))
    return q * np.sign(np.diag(r))


def _assign(c: np.ndarray, probed: int):
    """List of every vector, or, for queries, the ``probed`` nearest lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = matrix(part.column(1), c.shape[1])
                order = np.argsort((c * c).sum(axis=1) - 2 * x @ c.T, axis=1, kind="stable")[:, :probed]
                lists = np.sort(order, axis=1).astype(np.int32)
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * probed)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(lists.reshape(-1))), pa.array([v.tobytes() for v in x], pa.binary())], ["vec_id", "lists", "v"])

    return run


def _search(width: int, k: int):
    turn = rotation(width)

    def scan(x: np.ndarray, norms: np.ndarray, columns: list[np.ndarray], ids: np.ndarray, q: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        qr = q @ turn
        alive = np.flatnonzero(ids != own)
        first, rest = alive[: 4 * k], alive[4 * k :]
        best, at = np.sqrt(((x[first] - q) ** 2).sum(axis=1)), first
        if len(best) > k:
            top = np.lexsort((ids[at], best))[:k]
            best, at = best[top], at[top]
        if len(rest):
            limit = best.max() ** 2 if len(best) >= k else np.inf
            partial = np.zeros(len(rest))
            slack = ROUNDING * (norms[rest] + q @ q)  # copies of q are at 0, but rounded apart by the rotation
            for b, block in enumerate(columns):
                seen = min(width, (b + 1) * COLUMNS)
                partial += ((block[:, rest] - qr[b * COLUMNS : seen, None]) ** 2).sum(axis=0)
                grow = (1 + MARGIN / np.sqrt(seen)) ** 2 if seen < width else 1 + 1e-9
                stay = partial * (width / seen) <= limit * grow + slack
                rest, partial, slack = rest[stay], partial[stay], slack[stay]
            best, at = np.concatenate([best, np.sqrt(((x[rest] - q) ** 2).sum(axis=1))]), np.concatenate([at, rest])
        top = np.lexsort((ids[at], best))[:k]
        return ids[at[top]], best[top]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        data, asked = rows[~rows["query"]].sort_values("vec_id", kind="stable"), rows[rows["query"]]
        if data.empty or asked.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        ids = data.vec_id.to_numpy(np.int64)
        x = np.frombuffer(b"".join(data.v), np.float64).reshape(len(ids), width)
        norms = (x * x).sum(axis=1)
        turned = np.ascontiguousarray((x @ turn).T)
        columns = [turned[i : i + COLUMNS] for i in range(0, width, COLUMNS)]
        out = [scan(x, norms, columns, ids, np.frombuffer(v, np.float64), own) for own, v in zip(asked.vec_id, asked.v)]
        return pd.DataFrame({"query_id": np.repeat(asked.vec_id.to_numpy(np.int64), [len(o[0]) for o in out]), "vec_id": np.concatenate([o[0] for o in out]), "score": np.concatenate([o[1] for o in out])})

    return run


def nearest_neighbours(vectors: DataFrame, queries, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", lists: int = LISTS, probed: float = PROBED, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for every row where the column ``queries`` holds, nearest first.

    Score is the Euclidean distance on the original vectors; ties go to the smaller id. A query's candidates are all rows with another id.
    Rows with a null id, and vectors that are null, zero, not finite or of another width than most, take no part. Repeated queries count once.
    """
    with scratch() as cuts:
        rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("query"))
        rows = rows.where(F.col("vec_id").isNotNull() & usable("v"))
        width = common_width(rows, "v")
        rows = rows.where(F.size("v") == width)
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow().column("v")
        if not len(sample):
            return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        x = np.concatenate([matrix(chunk, width) for chunk in sample.chunks])
        count = max(1, min(lists, int(len(x) ** 0.5)))
        c = centres(x, count)
        visits = count if count < 8 else int(np.ceil(probed * count))
        kinds = "vec_id long, lists array<int>, v binary"
        placed = cuts.cut(rows.select("vec_id", "v").mapInArrow(_assign(c, 1), kinds).select("vec_id", F.col("lists")[0].alias("list"), "v"))
        sizes = placed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
        asked = rows.where("query").dropDuplicates(["vec_id"]).select("vec_id", "v").mapInArrow(_assign(c, visits), kinds)
        asked = cuts.cut(asked)
        # lists are few, so are these figures: blocks of the list's rows, shares of the queries that visit it
        shares = asked.select(F.explode("lists").alias("list")).groupBy("list").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("shares"))
        sizes = cuts.cut(sizes.join(shares, "list"))
        data = placed.join(F.broadcast(sizes), "list").select(
            "list", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "vec_id", "v", F.lit(False).alias("query")
        )
        asked = asked.select("vec_id", "v", F.explode("lists").alias("list")).join(F.broadcast(sizes), "list")
        asked = asked.select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("vec_id", F.lit(1)), "shares").cast("int").alias("share"), "vec_id", "v", F.lit(True).alias("query"))
        found = data.unionByName(asked).groupBy("list", "block", "share").applyInPandas(_search(width, k), "query_id long, vec_id long, score double")
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return durable(best.select("query_id", F.col("rank").cast("int"), "vec_id", "score"))
