"""Substring de-duplication by relative Lempel-Ziv parsing against an index of reference blocks.

Every document is cut into content-defined blocks: a block is a run of consecutive window starts (a window is
``window`` words) with one anchor, the least key of the ``GRAM``-word grams in the window. Equal windows have equal
anchors, so a window can only repeat inside blocks that share an anchor: the anchor is the index of the reference.

Parsing. A block whose very text stands in an earlier document is one factor. Every other block with an indexed anchor is
factored greedily: from each start the earliest document holding that window is the reference, and the factor runs on
while the following windows have the same one. A factor of m window starts covers m + window - 1 words. Windows that straddle a
block or factor boundary belong to a block by their own anchor, so a match that continues with another reference is
not lost: the union of the factors is exactly the set of words in windows that an earlier document holds.

Plan. Documents with equal word sequences are one factor each and leave the rest of the plan. The first pass ships only anchors;
window keys are made for blocks with a shared anchor alone, first occurrences of ragged blocks are compared in tasks of bounded
size, and anchors with many different blocks are split by window key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fluxloom.llm.words import Words, mix64, release, signed, sliced_words, span_sums, window_keys
from fluxloom.session import durable, scratch

WINDOW = 50
GRAM = 10
LONGEST_BLOCK = 256
SPLIT_AT = 2000
BLOCKS_PER_TASK = 4000
BROADCAST_IDS = 1_000_000  # ids of texts to fetch: up to so many (some 30 MB) go to every executor, more are shuffled
_SECOND = 0xD6E8FEB86659FD93


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` consecutive values."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def window_anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor of every window inside one text, and the word it starts at."""
    n = len(words)
    starts = np.arange(max(0, n - window + 1))
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts
    grams = mix64(span_sums(words.keys, np.arange(n - GRAM + 1), np.arange(GRAM, n + 1), MIXED))
    text = np.searchsorted(words.first, starts, side="right") - 1
    inside = starts + window <= words.first[text + 1]
    return _sliding_min(grams, window - GRAM + 1)[inside], starts[inside]


MIXED = 0xA0761D6478BD642F


def _heads(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for a, b, words in sliced_words(batch.column(2), lower=False):
                anchors, starts = window_anchors(words, window)
                bounds = np.searchsorted(starts, words.first)
                own = [signed(np.unique(anchors[bounds[i] : bounds[i + 1]])) for i in range(b - a)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
                values = np.concatenate(own) if own else np.zeros(0, dtype=np.int64)
                left, right = words.first[:-1], words.first[1:]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(1).slice(a, b - a),
                        pa.array(right - left, pa.int64()),
                        pa.array(signed(mix64(span_sums(words.keys, left, right)))),
                        pa.array(signed(mix64(span_sums(words.keys, left, right, _SECOND)))),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64())),
                    ],
                    ["doc_id", "tk", "n_words", "k1", "k2", "anchors"],
                )

    return run


def _blocks(window: int):
    """Blocks whose anchor is in the row's list of shared anchors, with the keys of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = batch.column(3)
            for a, b, words in sliced_words(batch.column(2), lower=False):
                anchors, starts = window_anchors(words, window)
                keys, _ = window_keys(words.keys, words.first, window)
                text = np.searchsorted(words.first, starts, side="right") - 1
                new = np.ones(len(starts), dtype=bool)
                new[1:] = (anchors[1:] != anchors[:-1]) | (text[1:] != text[:-1])
                since = np.arange(len(starts)) - np.maximum.accumulate(np.where(new, np.arange(len(starts)), 0))
                new |= since % LONGEST_BLOCK == 0
                left = np.flatnonzero(new)
                right = np.append(left[1:], len(starts))[: len(left)]
                lists = shared.slice(a, b - a)
                wanted, owner = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(b - a), lists.value_lengths().to_numpy(zero_copy_only=False))
                # (text, anchor) pairs are compared as one mixed key
                pair = mix64(wanted.view(np.uint64) + mix64(owner.astype(np.uint64)))
                mine = mix64(anchors[left] + mix64(text[left].astype(np.uint64))) if len(left) else np.zeros(0, dtype=np.uint64)
                keep = np.isin(mine, pair)
                left, right = left[keep], right[keep]
                run_key = mix64(span_sums(keys, left, right, MIXED) + (right - left).astype(np.uint64)) if len(left) else np.zeros(0, dtype=np.uint64)
                rows = pa.array(text[left])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a).take(rows),
                        batch.column(1).slice(a, b - a).take(rows),
                        pa.array(signed(anchors[left])),
                        pa.array((starts[left] - words.first[text[left]]).astype(np.int64)),
                        pa.array((right - left).astype(np.int64)),
                        pa.array(signed(run_key)),
                        pa.array([keys[x:y].tobytes() for x, y in zip(left, right)], pa.binary()),
                    ],
                    ["doc_id", "tk", "anchor", "start", "n", "run_key", "windows"],
                )

    return run


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Splits blocks of anchors with many different ones by window key, so that one window still meets in one place."""
    for batch in batches:
        parts = batch.column("parts").to_numpy(zero_copy_only=False)
        windows = batch.column("windows").to_pylist()
        row, salt, at, keys = [], [], [], []
        for i, (p, w) in enumerate(zip(parts, windows)):
            own = np.frombuffer(w, np.uint64)
            which = (own % np.uint64(p)).astype(np.int64) if p > 1 else None
            for s in [0] if p <= 1 else np.unique(which):
                here = np.arange(len(own)) if p <= 1 else np.flatnonzero(which == s)
                row.append(i)
                salt.append(int(s))
                at.append(here.astype(np.int32).tobytes())
                keys.append(own[here].tobytes())
        rows = pa.array(np.array(row, dtype=np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(c).take(rows) for c in ("doc_id", "tk", "anchor", "start")] + [pa.array(salt, pa.int64()), pa.array(at, pa.binary()), pa.array(keys, pa.binary())],
            ["doc_id", "tk", "anchor", "start", "salt", "at", "windows"],
        )


def _factor(window: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        n = np.array([len(x) // 8 for x in rows.windows])
        key = np.frombuffer(b"".join(rows.windows), np.uint64)
        doc = np.repeat(rows.doc_id.to_numpy(np.int64), n)
        pos = np.repeat(rows.start.to_numpy(np.int64), n) + np.frombuffer(b"".join(rows["at"]), np.int32)
        tk = np.repeat(rows.tk.to_numpy(np.int64), n)
        order = np.lexsort((doc, key))
        first = np.ones(len(order), dtype=bool)
        first[1:] = key[order][1:] != key[order][:-1]
        ref = np.empty(len(order), dtype=np.int64)
        ref[order] = doc[order][np.flatnonzero(first)[np.cumsum(first) - 1]] if len(order) else []
        dup = np.flatnonzero(ref < doc)
        dup = dup[np.lexsort((pos[dup], tk[dup], doc[dup]))]
        doc, pos, tk, ref = doc[dup], pos[dup], tk[dup], ref[dup]
        new = np.ones(len(dup), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (tk[1:] != tk[:-1]) | (pos[1:] > pos[:-1] + 1) | (ref[1:] != ref[:-1])
        left = np.flatnonzero(new)
        right = np.append(left[1:], len(dup))[: len(left)] - 1
        return pd.DataFrame({"doc_id": doc[left], "tk": tk[left], "start": pos[left], "length": pos[right] - pos[left] + window, "ref_doc": ref[left]})

    return run


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tk"), text.alias("text"))


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Factors (doc_id, tk, start, length, ref_doc): words ``start .. start+length`` that ``ref_doc`` < doc_id holds too.

    ``tk`` is Spark's xxhash64 of the text and tells apart rows that share an id. Factors of one document may overlap. Rows with a
    null id and texts under ``window`` words take no part; a passage repeated inside one document alone is no duplicate.
    """
    with scratch() as cuts:
        source = _source(docs, id_col, text_col)
        heads = source.where("doc_id is not null").mapInArrow(_heads(window), "doc_id long, tk long, n_words long, k1 long, k2 long, anchors array<long>")
        heads = cuts.cut(heads.where(F.col("n_words") >= window))
        firsts = heads.groupBy("k1", "k2", "n_words").agg(F.min("doc_id").alias("ref_doc"))
        heads_ = heads.join(firsts, ["k1", "k2", "n_words"])
        copies = heads_.where("ref_doc < doc_id").select("doc_id", "tk", F.lit(0).cast("long").alias("start"), F.col("n_words").alias("length"), "ref_doc")

        marks = cuts.cut(heads_.where("ref_doc = doc_id").select("doc_id", "tk", F.explode("anchors").alias("anchor")).distinct())
        index = marks.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
        needed = marks.join(index, "anchor").groupBy("doc_id", "tk").agg(F.collect_list("anchor").alias("anchors"))
        needed = cuts.cut(needed)
        if needed.count() <= BROADCAST_IDS:  # only texts that are parsed are shuffled
            source = source.join(F.broadcast(needed.select("doc_id", "tk")), ["doc_id", "tk"], "left_semi")
        blocks = source.join(needed, ["doc_id", "tk"]).select("doc_id", "tk", "text", "anchors")
        blocks = cuts.cut(blocks.mapInArrow(_blocks(window), "doc_id long, tk long, anchor long, start long, n long, run_key long, windows binary"))

        known = cuts.cut(blocks.groupBy("anchor", "run_key").agg(F.min("doc_id").alias("ref_doc")))
        placed = blocks.drop("windows").join(known, ["anchor", "run_key"])
        whole = placed.where("ref_doc < doc_id").select("doc_id", "tk", "start", (F.col("n") + window - 1).alias("length"), "ref_doc")

        ragged = known.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
        ragged = known.join(ragged, "anchor").select("anchor", "run_key", F.col("ref_doc").alias("doc_id"), F.ceil(F.col("kinds") / SPLIT_AT).alias("parts"))
        dealt = blocks.join(ragged, ["anchor", "run_key", "doc_id"]).select("doc_id", "tk", "anchor", "start", "parts", "windows")
        tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), ragged.count() // BLOCKS_PER_TASK)
        dealt = dealt.mapInArrow(_deal, "doc_id long, tk long, anchor long, start long, salt long, at binary, windows binary")
        dealt = dealt.withColumn("task", F.pmod(F.xxhash64("anchor", "salt"), F.lit(tasks)))
        parsed = dealt.groupBy("task").applyInPandas(_factor(window), "doc_id long, tk long, start long, length long, ref_doc long")
        return durable(copies.unionByName(whole).unionByName(parsed))


def kept_bytes(words: Words, removed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept words joined by one space, text after text, and the end of each text (its last space included)."""
    keep = np.flatnonzero(~removed)
    size = words.ends[keep] - words.starts[keep] + 1
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total) + np.repeat(words.starts[keep] - (ends - size), size)
    data = words.data[np.minimum(at, len(words.data) - 1)] if total else np.zeros(0, dtype=np.uint8)
    data[ends - 1] = 32
    count = np.searchsorted(keep, words.first[1:])
    return data, np.concatenate([[0], ends])[count]


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2)
            for a, b, words in sliced_words(batch.column(1), lower=False):
                own = spans.slice(a, b - a)
                owner = np.repeat(np.arange(b - a), own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                flat = own.flatten()
                start = flat.field(0).to_numpy(zero_copy_only=False) + words.first[owner]
                cover = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(cover, start, 1)
                np.add.at(cover, start + flat.field(1).to_numpy(zero_copy_only=False), -1)
                removed = np.cumsum(cover[:-1]) > 0
                data, ends = kept_bytes(words, removed)
                view, begin, digest, texts = memoryview(data), 0, [], []
                for end in ends:
                    own = view[begin : max(begin, int(end) - 1)]
                    digest.append(hashlib.sha256(own).hexdigest())
                    if with_text:
                        texts.append(bytes(own).decode("utf-8", "replace"))
                    begin = int(end)
                gone = np.concatenate([[0], np.cumsum(removed)])[words.first]
                columns = [batch.column(0).slice(a, b - a), pa.array(np.diff(words.first), pa.int64()), pa.array(np.diff(gone), pa.int64()), pa.array(digest, pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    original = batch.column(1).slice(a, b - a).to_pylist()
                    columns.append(pa.array([t if cut else o for t, cut, o in zip(texts, np.diff(gone), original)], pa.string()))
                    columns += [batch.column(i).slice(a, b - a) for i in range(3, batch.num_columns)]
                    names += ["text", *batch.schema.names[3:]]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _with_spans(source: DataFrame, spans: DataFrame) -> DataFrame:
    """``source`` with the list of its spans. While the ids are few, texts that lose nothing are not shuffled."""
    keys = ["doc_id", "tk"]
    lists = spans.groupBy(*keys).agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    ids = spans.select(*keys).distinct()
    if ids.count() > BROADCAST_IDS:
        return source.join(lists, keys, "left")
    ids = F.broadcast(ids)
    cut = source.join(ids, keys, "left_semi").join(lists, keys)
    whole = source.join(ids, keys, "left_anti").withColumn("spans", F.lit(None).cast(lists.schema["spans"].dataType))
    return cut.unionByName(whole)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): every row of ``docs`` without the words of its duplicate spans.

    Null texts count as empty. A row with a null id keeps all its words. The digest is over the kept words joined by one space.
    """
    spans = duplicate_spans(docs, id_col, text_col, window)
    rows = _with_spans(_source(docs, id_col, text_col), spans).select("doc_id", "text", "spans")
    return rows.mapInArrow(_cut(False), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with new columns n_words, n_removed, kept_sha256 and the text cut where something was removed.

    Texts that lose nothing stay as they are, byte for byte; null texts become empty. Other columns are carried along.
    """
    spans = duplicate_spans(docs, id_col, text_col, window)
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    carried = F.struct(*[F.col(c) for c in others]).alias("_others") if others else F.lit(None).cast("struct<_none:int>").alias("_others")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tk"), text.alias("text"), carried)
    rows = _with_spans(source, spans).select("doc_id", "text", "spans", "_others")
    kind = source.schema["_others"].dataType.simpleString()
    out = rows.mapInArrow(_cut(True), f"doc_id long, n_words long, n_removed long, kept_sha256 string, text string, _others {kind}")
    taken = {"n_words", "n_removed", "kept_sha256"} & set(others)
    added = [c for c in ("n_words", "n_removed", "kept_sha256") if c not in taken]
    return out.select(*[F.col("doc_id").alias(c) if c == id_col else F.col("text").alias(c) if c == text_col else F.col("_others")[c].alias(c) for c in docs.columns], *added)
