"""Near-duplicate embeddings by hierarchical navigable small-world graphs, one per shard.

Vectors are compared inside their label. Equal vectors form one class; classes of a label are dealt to shards of at most about
``SHARD_ROWS``. Every shard builds a graph of its own; every shard's vectors then query every graph of the label. A query
whose whole beam lies over the threshold is widened until it does not, and each pair of shards is audited: brute-force links
of sampled vectors must all have been found, or the beam doubles for the whole pair (up to an exhaustive scan). Links are confirmed by cosine in
double precision. A task returns link counts and a spanning forest, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from fluxloom.llm.graph import Forest, components
from fluxloom.llm.vectors import common_width, usable
from fluxloom.session import durable, scratch

SHARD_ROWS = 2048
DEGREE = 16
BUILD_BEAM = 48
BEAM = 32
EXPAND = 4
AUDITED = 64
RECALL = 0.999
SLACK = 1e-5  # searching is in single precision; confirming is not


class SmallWorld:
    """Layers of neighbour lists over unit vectors in single precision; layer 0 holds all, each higher one about a sixteenth."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray], members: list[np.ndarray]):
        self.x, self.layers, self.members = x, layers, members

    @classmethod
    def build(cls, x: np.ndarray, seed: int = 3) -> SmallWorld:
        n = len(x)
        rank = np.random.default_rng(seed).permutation(n)
        members, layers = [np.arange(n)], []
        while len(members[-1]) > 4 * DEGREE:
            members.append(np.sort(rank[: max(1, len(members[-1]) // 16)]))
        graph = cls(x, layers, members)
        for level in range(len(members) - 1, -1, -1):
            layers.insert(0, np.full((n, DEGREE * (2 if level == 0 else 1)), -1, dtype=np.int32))
            graph._fill(level, rank[np.isin(rank, members[level])])
        return graph

    def _fill(self, level: int, order: np.ndarray) -> None:
        """Inserts nodes in batches that double: each batch searches the graph so far and itself."""
        at, links = 0, self.layers[0]
        while at < len(order):
            batch = order[at : at + max(1, min(256, at))]
            near = self.x[batch] @ self.x[batch].T
            np.fill_diagonal(near, -2)
            own = np.argsort(-near, axis=1)[:, : DEGREE * 2]
            ids, sims = np.where(np.take_along_axis(near, own, 1) > -2, batch[own], -1), np.take_along_axis(near, own, 1)
            if at:
                entry = np.broadcast_to(order[: min(at, 8)], (len(batch), min(at, 8)))
                found, value = self._beam(links, self.x[batch], entry, BUILD_BEAM)
                ids, sims = np.concatenate([found, ids], axis=1), np.concatenate([value, sims], axis=1)
            for i, node in enumerate(batch):
                self._link(links, node, ids[i], sims[i])
            at += len(batch)

    def _pick(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Nearest first, but a candidate nearer to one already picked than to the node waits; the rest fill up."""
        ids = ids[np.argsort(-sims, kind="stable")]
        sims = np.sort(sims)[::-1]
        if len(ids) <= most:
            return ids
        near = self.x[ids] @ self.x[ids].T
        picked, waiting = [], []
        for i in range(len(ids)):
            (waiting if picked and near[i, picked].max() > sims[i] else picked).append(i)
            if len(picked) == most:
                break
        return ids[(picked + waiting)[:most]]

    def _link(self, links: np.ndarray, node: int, ids: np.ndarray, sims: np.ndarray) -> None:
        good = (ids >= 0) & (ids != node)
        ids, first = np.unique(ids[good], return_index=True)
        mine = self._pick(ids, sims[good][first], DEGREE)
        have = links[node][links[node] >= 0]
        mine = np.concatenate([have, mine[~np.isin(mine, have)]])[: links.shape[1]]
        links[node, : len(mine)] = mine
        for other in mine:
            theirs = links[other]
            if (theirs == node).any():
                continue
            free = np.flatnonzero(theirs < 0)
            if len(free):
                theirs[free[0]] = node
            else:
                every = np.append(theirs, node)
                links[other] = self._pick(every, self.x[every] @ self.x[other], links.shape[1])

    def _beam(self, links: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` best nodes found for every query, by expanding the best open nodes of its beam."""
        n, rows = len(q), np.arange(len(q))[:, None]
        seen = np.zeros((n, len(self.x) + 1), dtype=bool)
        seen[:, -1] = True  # place of the empty neighbour
        seen[rows, entry] = True
        ids, sims = np.array(entry, dtype=np.int64), np.einsum("qed,qd->qe", self.x[entry], q)
        open_ = np.ones(ids.shape, dtype=bool)
        while True:
            order = np.argsort(-sims, axis=1, kind="stable")[:, :width]
            ids, sims, open_ = ids[rows, order], sims[rows, order], open_[rows, order]
            active = np.flatnonzero(open_.any(axis=1))
            if not len(active):
                return ids, sims
            best = np.argsort(np.where(open_[active], -sims[active], np.inf), axis=1, kind="stable")[:, :EXPAND]
            take = active[:, None]
            chosen = np.where(open_[take, best], ids[take, best], -1)
            open_[take, best] = False
            new = np.where(chosen[..., None] >= 0, links[chosen], -1).reshape(len(active), -1).astype(np.int64)
            new = np.sort(new, axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new[seen[take, new]] = -1
            seen[take, new] = True
            value = np.where(new >= 0, np.einsum("qed,qd->qe", self.x[new], q[active]), -2).astype(sims.dtype)
            more_ids, more = np.full((n, new.shape[1]), -1, dtype=np.int64), np.full((n, new.shape[1]), -2, dtype=sims.dtype)
            more_ids[active], more[active] = new, value
            ids, sims = np.concatenate([ids, more_ids], axis=1), np.concatenate([sims, more], axis=1)
            open_ = np.concatenate([open_, more_ids >= 0], axis=1)

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Top-down: the highest layer whole, then a small beam on every layer, ``width`` on the lowest."""
        top = self.members[-1]
        order = np.argsort(-(q @ self.x[top].T), axis=1, kind="stable")[:, :8]
        entry = top[order]
        for level in range(len(self.members) - 2, 0, -1):
            entry, _ = self._beam(self.layers[level], q, entry, 8)
        return self._beam(self.layers[0], q, entry, width)


def links_between(graph: SmallWorld, q: np.ndarray, least: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(query row, graph row) of all pairs found over ``least``, with audits and widening as said above."""
    n = len(graph.x)
    audit = np.unique(np.linspace(0, len(q) - 1, min(AUDITED, len(q))).astype(np.int64))
    truth = (q[audit] @ graph.x.T) >= least
    while True:
        if beam >= n:
            return _scan(graph, q, least)
        rows, cols, todo, width = [], [], np.arange(len(q)), beam
        while len(todo):
            late = []
            for at in range(0, len(todo), 256):
                part = todo[at : at + 256]
                if width >= n:
                    r, c = _scan(graph, q[part], least)
                    rows.append(part[r])
                    cols.append(c)
                    continue
                ids, sims = graph.search(q[part], width)
                full = (ids.shape[1] >= width) & (sims.min(axis=1) >= least)
                late.append(part[full])
                r, c = np.nonzero((sims >= least) & (ids >= 0) & ~full[:, None])
                rows.append(part[r])
                cols.append(ids[r, c])
            todo, width = (np.concatenate(late) if late else todo[:0]), 4 * width
        rows, cols = np.concatenate(rows), np.concatenate(cols)
        got = np.isin(rows, audit)
        if got.sum() >= RECALL * truth.sum():
            return rows, cols
        beam *= 2


def _scan(graph: SmallWorld, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    rows, cols = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for at in range(0, len(q), 256):
        r, c = np.nonzero(q[at : at + 256] @ graph.x.T >= least)
        rows.append(r + at)
        cols.append(c)
    return np.concatenate(rows), np.concatenate(cols)


def _unit(v: np.ndarray) -> np.ndarray:
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def _build(width: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep")
        v = np.stack([np.asarray(x, dtype=np.float64) for x in rows.v]).reshape(len(rows), width)
        graph = SmallWorld.build(_unit(v))
        layers = b"".join(x.tobytes() for x in graph.layers)
        members = np.concatenate([[len(graph.members)], [len(m) for m in graph.members], *graph.members]).astype(np.int64)
        return pd.DataFrame({"label": rows.label.iloc[:1], "shard": rows.shard.iloc[:1], "ids": [rows.rep.to_numpy(np.int64).tobytes()], "copies": [rows.copies.to_numpy(np.int64).tobytes()], "vectors": [v.tobytes()], "layers": [layers], "members": [members.tobytes()]})

    return run


def _loaded(row, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, SmallWorld]:
    ids, copies = np.frombuffer(row.ids, np.int64), np.frombuffer(row.copies, np.int64)
    v = np.frombuffer(row.vectors, np.float64).reshape(len(ids), width)
    flat = np.frombuffer(row.members, np.int64)
    sizes = flat[1 : 1 + flat[0]]
    members = np.split(flat[1 + flat[0] :], np.cumsum(sizes)[:-1])
    links, layers, at = np.frombuffer(row.layers, np.int32), [], 0
    for level in range(len(members)):
        degree = DEGREE * (2 if level == 0 else 1)
        layers.append(links[at : at + len(ids) * degree].reshape(len(ids), degree))
        at += len(ids) * degree
    return ids, copies, v, SmallWorld(_unit(v), layers, members)


def _compare(width: int, least: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        one = next(rows[rows.role == "graph"].itertuples())
        two = next(rows[rows.role == "query"].itertuples(), one)
        ids, copies, v, graph = _loaded(one, width)
        ids2, copies2, v2, other = (ids, copies, v, graph) if two is one else _loaded(two, width)
        r, c = links_between(graph, other.x, least - SLACK)
        if two is one:  # found from either end; one of the two is enough
            pair = np.unique(np.stack([np.minimum(r, c), np.maximum(r, c)], axis=1)[r != c], axis=0)
            r, c = pair[:, 0], pair[:, 1]
        norm, norm2 = np.linalg.norm(v, axis=1), np.linalg.norm(v2, axis=1)
        keep = np.zeros(len(r), dtype=bool)
        for at in range(0, len(r), 65_536):
            a, b = r[at : at + 65_536], c[at : at + 65_536]
            keep[at : at + 65_536] = np.einsum("ij,ij->i", v2[a], v[b]) / (norm2[a] * norm[b]) >= least
        r, c = r[keep], c[keep]
        counts = {}
        for own, ends, far in ((ids2, r, copies[c]), (ids, c, copies2[r])):
            total = np.bincount(ends, far, minlength=len(own)).astype(np.int64)
            for i in np.flatnonzero(total):
                counts[int(own[i])] = counts.get(int(own[i]), 0) + int(total[i])
        forest, edges = Forest(len(ids2) + (0 if two is one else len(ids))), []
        shift = 0 if two is one else len(ids2)
        for x, y in zip(r.tolist(), c.tolist()):
            if forest.join(x, y + shift):
                edges.append((int(ids2[x]), int(ids[y])))
        out = [(a, None, n) for a, n in counts.items()] + [(a, b, 0) for a, b in edges]
        return pd.DataFrame(out, columns=["a", "b", "n"]).astype({"a": "int64", "b": "Int64", "n": "int64"})

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Links: equal labels and cosine >= ``least`` in double precision. n_links counts other rows linked directly, exact copies included; the
    component is the smallest id reachable. Rows with a null id or label and vectors that are null, zero, not finite or of another width than
    most link with nothing: no links, their own component, kept. Rows that repeat an id count as separate vectors.
    """
    with scratch() as cuts:
        label = F.col(label_col).cast("string")
        rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
        rows = rows.withColumn("ok", F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("v"))
        width = common_width(rows.where("ok"), "v")
        rows = rows.withColumn("ok", F.coalesce(F.col("ok") & (F.size("v") == width), F.lit(False)))
        classes = cuts.cut(rows.where("ok").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
        shards = classes.groupBy("label").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
        dealt = classes.join(shards, "label").withColumn("shard", F.pmod(F.xxhash64("rep"), "shards").cast("int"))
        kinds = "label string, shard int, ids binary, copies binary, vectors binary, layers binary, members binary"
        graphs = cuts.cut(dealt.select("label", "shard", "rep", "copies", "v").groupBy("label", "shard").applyInPandas(_build(width), kinds))
        graphs = graphs.join(shards, "label")
        units = graphs.withColumn("role", F.lit("graph")).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("shard")))).withColumn("t", F.col("shard"))
        asking = graphs.where("shard < shards - 1").withColumn("role", F.lit("query")).withColumn("t", F.explode(F.sequence(F.col("shard") + 1, F.col("shards") - 1))).withColumn("s", F.col("shard"))
        found = cuts.cut(units.unionByName(asking).groupBy("label", "s", "t").applyInPandas(_compare(width, least), "a long, b long, n long"))
        links = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("far"))
        parts = components(found.where("b is not null").select("a", "b")).withColumnRenamed("vertex", "rep")
        known = classes.join(links, "rep", "left").join(parts, "rep", "left").select("label", "v", (F.coalesce("far", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("comp"))
        known = known.withColumn("ok", F.lit(True))
        out = rows.join(known, ["ok", "label", "v"], "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("comp", "vec_id").alias("component_id"))
        return durable(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
