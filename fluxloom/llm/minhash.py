"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard confirmation.

Two permutations make the whole signature: the first scatters shingles over a circle of 2**32 places, the second is
applied after shifting the circle, once per coordinate. Coordinate k of a set is the least value of
``second(first(x) - k * STEP)`` over its shingles, so coordinates of two sets agree as often as the sets do.

Plan. Documents with equal shingle sets fall into one class first. Classes are banded; in every bucket each
class is compared with the bucket's first one (a star, not all pairs) on full shingle sets. What is still unlinked is
compared with the rest of its bucket in blocks inside tasks, which return a spanning forest of the links found.
With 32 bands of 5 rows a pair at 0.8 shares no band with a chance of 3e-6; a pair is dropped on its signature alone
only when the estimate is five standard errors under the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fluxloom.llm.graph import Forest, components
from fluxloom.llm.words import mix64, release, signed, sliced_words, span_sums, window_keys
from fluxloom.session import durable, scratch

BANDS, ROWS = 32, 5
STEP = np.uint32(0x9E3779B1)  # spreads the shifts over the circle; any odd value does
SECOND = (np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
BLOCK = 512
ROWS_PER_TASK = 2000
BROADCAST_IDS = 1_000_000  # ids of texts to fetch: up to so many (some 20 MB) go to every executor, more are shuffled


def _second(x: np.ndarray) -> np.ndarray:
    """The second permutation of the circle: odd multipliers and shifts, so a bijection of 32 bits."""
    x = x * SECOND[0]
    x ^= x >> np.uint32(15)
    x *= SECOND[1]
    x ^= x >> np.uint32(13)
    return x


def shingle_keys(words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-word shingles of every text, and where each text's keys begin (one more at the end).

    A text with fewer words, but at least one, has its whole sequence as its only shingle.
    """
    keys, starts = window_keys(words.keys, words.first, n)
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < n))
    bounds = np.searchsorted(starts, words.first)
    if len(short):
        own = mix64(span_sums(words.keys, words.first[short], words.first[short + 1]) + count[short].astype(np.uint64))
        keys = np.insert(keys, bounds[short], own)
        bounds = bounds + np.concatenate([[0], np.cumsum((count > 0) & (count < n))])
    return keys, bounds


def signatures(keys: np.ndarray, bounds: np.ndarray, coordinates: int) -> np.ndarray:
    """(texts, coordinates) of 32 bits; texts without shingles keep the largest value everywhere."""
    out = np.full((coordinates, len(bounds) - 1), 0xFFFFFFFF, dtype=np.uint32)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        circle = (keys >> np.uint64(32)).astype(np.uint32)  # the first permutation: bits of a mixed 64-bit key
        for k in range(coordinates):
            out[k, full] = np.minimum.reduceat(_second(circle - np.uint32((k * int(STEP)) & 0xFFFFFFFF)), bounds[:-1][full])
    return np.ascontiguousarray(out.T)


def _profile(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            ids = batch.column(0)
            for a, b, words in sliced_words(batch.column(1), lower=True):
                keys, bounds = shingle_keys(words, n)
                sig = signatures(keys, bounds, BANDS * ROWS)
                size, k1, k2 = [], [], []
                for i in range(b - a):
                    own = np.unique(keys[bounds[i] : bounds[i + 1]])
                    size.append(len(own))
                    k1.append(int(own.sum(dtype=np.uint64)))  # order-free keys of the whole set
                    k2.append(int(mix64(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)))
                bands = band_keys(sig)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a),
                        pa.array(size, pa.int64()),
                        pa.array(signed(np.array(k1, dtype=np.uint64))),
                        pa.array(signed(np.array(k2, dtype=np.uint64))),
                        pa.array([r.tobytes() for r in bands], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "k1", "k2", "bands"],
                )

    return run


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(texts, bands) of 64 bits; the band's number is part of its key."""
    own = mix64(span_sums(sig.reshape(-1).astype(np.uint64), np.arange(0, sig.size, ROWS), np.arange(ROWS, sig.size + 1, ROWS)))
    return mix64(own.reshape(len(sig), BANDS) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(STEP))


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per (class, band)."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        bucket = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.repeat(ids, BANDS))], ["bucket", "rep"])


def _sets(n: int):
    """Sorted distinct shingle keys of every text, and one byte of each signature coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in sliced_words(batch.column(1), lower=True):
                keys, bounds = shingle_keys(words, n)
                own = [np.unique(keys[bounds[i] : bounds[i + 1]]).tobytes() for i in range(b - a)]
                sig = [r.tobytes() for r in (signatures(keys, bounds, BANDS * ROWS) & np.uint32(255)).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(own, pa.binary()), pa.array(sig, pa.binary())], ["rep", "set", "sig"])

    return run


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * |x and y| >= percent * |x or y| for sorted distinct keys."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(small) < percent * len(large) or not len(small):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int(np.count_nonzero(large[at] == small))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(left, right)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return run


def _compare_blocks(percent: int):
    """Links between strays and members of the same unit, of different components, as a spanning forest."""
    least = percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / (BANDS * ROWS)) ** 0.5

    def unit(rows: pd.DataFrame) -> list[tuple[int, int]]:
        rows = rows.drop_duplicates(["rep", "stray"])
        home, stray = rows[~rows.stray], rows[rows.stray]
        if home.empty or stray.empty:
            return []
        sig_h = np.frombuffer(b"".join(home.sig), np.uint8).reshape(len(home), -1)
        sig_s = np.frombuffer(b"".join(stray.sig), np.uint8).reshape(len(stray), -1)
        sets_h = [np.frombuffer(x, np.uint64) for x in home.set]
        sizes = np.array([len(x) for x in sets_h])
        ids_h, comp_h, is_stray = home.rep.to_numpy(), home.comp.to_numpy(), home.lost.to_numpy()
        every = {v: i for i, v in enumerate(pd.unique(np.concatenate([comp_h, stray.comp.to_numpy()])))}
        forest, out = Forest(len(every)), []
        for rep, comp, sig, own in zip(stray.rep, stray.comp, sig_s, stray.set):
            own = np.frombuffer(own, np.uint64)
            agree = (sig_h == sig).mean(axis=1)
            fits = (100 * np.minimum(sizes, len(own)) >= percent * np.maximum(sizes, len(own))) & (agree >= least) & (comp_h != comp)
            fits &= ~is_stray | (ids_h > rep)  # two strays meet twice; once is enough
            for j in np.flatnonzero(fits)[np.argsort(-agree[fits], kind="stable")]:
                x, y = every[comp], every[comp_h[j]]
                if forest.find(x) != forest.find(y) and similar(own, sets_h[j], percent):
                    forest.join(x, y)
                    out.append((int(rep), int(ids_h[j])))
        return out

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = [p for _, part in rows.groupby(["bucket", "i", "j"], sort=False) for p in unit(part)]
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Words are lower-cased A-Z; shingles are ``shingle`` words. Links: 100 * intersection >= ``percent`` * union of the
    shingle sets. Null and empty texts have no shingles and link with nothing. A row with a null id links with
    nothing, has no component and is kept. Repeated rows with one id get the same component; all of them say
    kept if the id is its component. Other columns of ``docs`` are not read.
    """
    with scratch() as cuts:
        source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        profile = cuts.cut(source.mapInArrow(_profile(shingle), "doc_id long, n_shingles long, k1 long, k2 long, bands binary"))
        known = profile.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
        classes = cuts.cut(known.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")))
        member = profile.select("doc_id", "n_shingles", "k1", "k2").join(classes.drop("bands"), ["k1", "k2", "n_shingles"], "left")

        banded = classes.select("rep", "bands").mapInArrow(_banded, "bucket long, rep long").distinct()
        leaders = banded.groupBy("bucket").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1")
        buckets = cuts.cut(banded.join(leaders, "bucket"))
        star = cuts.cut(buckets.where("rep > leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct())
        asked = cuts.cut(star.select(F.col("a").alias("rep")).union(star.select(F.col("b").alias("rep"))).distinct())
        few = asked.count() <= BROADCAST_IDS
        texts = source.join(F.broadcast(asked) if few else asked, source.doc_id == asked.rep, "left_semi").dropDuplicates(["doc_id"])
        sets = cuts.cut(texts.mapInArrow(_sets(shingle), "rep long, set binary, sig binary"))
        pairs = (
            star.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("x")), "a")
            .join(sets.select(F.col("rep").alias("b"), F.col("set").alias("y")), "b")
            .select("a", "b", "x", "y")
        )
        links = cuts.cut(pairs.mapInArrow(_confirm(percent), "a long, b long"))
        found = components(links)

        # Buckets of three and more that the stars left in several components.
        placed = buckets.where("n > 2").join(found.withColumnRenamed("vertex", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
        home = placed.groupBy("bucket").agg(F.min_by("comp", "rep").alias("home"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        home = home.where("lo < hi").drop("lo", "hi")
        rest = placed.join(home, "bucket").withColumn("lost", F.col("comp") != F.col("home"))
        sizes = rest.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.ceil(F.sum(F.col("lost").cast("int")) / BLOCK).alias("lost_blocks"))
        rest = cuts.cut(rest.join(sizes, "bucket").select("bucket", "rep", "comp", "lost", "blocks", "lost_blocks"))
        own = F.xxhash64("rep")
        as_member = rest.withColumn("stray", F.lit(False)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("lost_blocks").cast("int") - 1))).withColumn("j", F.pmod(own, "blocks").cast("int"))
        as_stray = rest.where("lost").withColumn("stray", F.lit(True)).withColumn("i", F.pmod(own, "lost_blocks").cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
        units = as_member.unionByName(as_stray).drop("blocks", "lost_blocks")
        tasks = max(1, units.count() // ROWS_PER_TASK)
        units = units.join(sets, "rep").withColumn("task", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(tasks)))
        more = units.groupBy("task").applyInPandas(_compare_blocks(percent), "a long, b long")
        more = cuts.cut(more)
        if not more.isEmpty():
            found = components(links.unionByName(more))
        out = (
            member.join(found.withColumnRenamed("vertex", "rep"), "rep", "left")
            .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
        )
        return durable(out)
