"""Best-fit packing by hierarchical residual merging.

Texts become subword ids plus an end id; longer ones are cut into full pieces and a rest. Partitions pack their pieces best-fit
(longest first, fullest bin that takes it), emit the nearly full bins, and pass the underfull ones on as items. A tree of
merges packs those again, each level in fewer groups of bounded size, until one group or no gain is left.

Subword ids are made per distinct word of a slice: the tokenizer's steps never look across white space, so words
encode on their own. A bounded table of words already met saves most calls.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fluxloom.llm.words import Words, kept, sliced_words
from fluxloom.session import durable, scratch

LENGTH = 2048
NEARLY_FULL = 0.98
BINS_PER_GROUP = 20_000
FAN_IN = 8
KNOWN_WORDS = 400_000

_ENCODERS: dict[str, WordEncoder] = kept({})


class WordEncoder:
    """Ids of words; the first ``KNOWN_WORDS`` different words met are remembered.

    New words are encoded many in one text, with a digit between them: the tokenizer takes every digit for itself,
    so its id ends a word. Words that hold that digit are encoded one by one.
    """

    MARK = "0"
    TOGETHER = 500

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self._ids(self.MARK)
        self.ids = np.zeros(0, dtype=np.int32)
        empty = (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32))
        self.levels = [empty, empty]  # a large sorted table and the words met since it was made: keys, place, number of ids

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """The worker's encoder of a vocabulary file."""
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _fresh(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of new words, the number of ids of each, and where each word's ids begin."""
        mark = self.MARK.encode()
        single = len(self.mark) != 1
        ids, size = [], np.zeros(len(texts), dtype=np.int64)
        alone = [i for i, t in enumerate(texts) if single or mark in t]
        together = [i for i, t in enumerate(texts) if not (single or mark in t)]
        order = together + alone
        for at in range(0, len(together), self.TOGETHER):
            part = together[at : at + self.TOGETHER]
            got = np.array(self._ids(b" 0 ".join(texts[i] for i in part).decode("utf-8") + " 0"), dtype=np.int32)
            ends = np.flatnonzero(got == self.mark[0])
            size[part] = np.diff(ends, prepend=-1) - 1
            ids.append(got[got != self.mark[0]])
        for i in alone:
            got = np.array(self._ids(texts[i].decode("utf-8")), dtype=np.int32)
            size[i] = len(got)
            ids.append(got)
        at = np.empty(len(texts), dtype=np.int64)
        at[order] = np.cumsum(size[order]) - size[order]
        return np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32), size, at

    def encode(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and the number of ids of each word."""
        unique, inverse = np.unique(words.keys, return_inverse=True)
        at, size, known = np.zeros(len(unique), dtype=np.int64), np.zeros(len(unique), dtype=np.int64), np.zeros(len(unique), dtype=bool)
        for keys, places, sizes in self.levels:
            if len(keys):
                place = np.minimum(np.searchsorted(keys, unique), len(keys) - 1)
                hit = keys[place] == unique
                at[hit], size[hit] = places[place[hit]], sizes[place[hit]]
                known |= hit
        new = np.flatnonzero(~known)
        first = np.empty(len(unique), dtype=np.int64)
        first[inverse] = np.arange(len(words))
        fresh, size[new], fresh_at = self._fresh([words.text(i) for i in first[new]])
        at[new] = len(self.ids) + fresh_at
        ids = np.concatenate([self.ids, fresh])
        if len(new) and sum(len(level[0]) for level in self.levels) < KNOWN_WORDS:
            self.ids = ids
            self.levels[1] = self._merged(self.levels[1], (unique[new], at[new], size[new].astype(np.int32)))
            if 4 * len(self.levels[1][0]) > len(self.levels[0][0]):
                self.levels = [self._merged(*self.levels), tuple(x[:0] for x in self.levels[1])]
        count = size[inverse]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        return ids[np.arange(total) + np.repeat(at[inverse] - (ends - count), count)], count

    @staticmethod
    def _merged(left: tuple, right: tuple) -> tuple:
        keys = np.concatenate([left[0], right[0]])
        order = np.argsort(keys, kind="stable")
        return tuple(np.concatenate([x, y])[order] for x, y in zip(left, right))


def _pieces(path: str, length: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(path)
        for batch in batches:
            for a, b, words in sliced_words(batch.column(1), lower=False):
                ids, count = encoder.encode(words)
                bounds = np.concatenate([[0], np.cumsum(count)])[words.first]
                row, piece, start, size, crc, content = [], [], [], [], [], []
                for i in range(b - a):
                    own = np.append(ids[bounds[i] : bounds[i + 1]], end_id).astype("<u4")
                    for p, s in enumerate(range(0, len(own), length)):
                        part = own[s : s + length].tobytes()
                        row.append(i)
                        piece.append(p)
                        start.append(s)
                        size.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            content.append(part)
                columns = [batch.column(0).slice(a, b - a).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, size, crc)]]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(content, pa.binary())] if with_ids else []), names + (["ids"] if with_ids else []))

    return run


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every text's ids and ``end_id``, cut at ``length``.

    Null texts count as empty and have the end id alone. Rows with null or repeated ids are cut like all others. ``ids`` holds
    little-endian unsigned 32-bit ids.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_pieces(path, length, end_id, with_ids), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every item: longest first, into the fullest bin that takes it."""
    bins, offsets = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, fill = 0, []  # bit r: some bin has r places left
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = open_rooms >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                open_rooms &= ~(1 << left)
        else:
            left, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        left -= size
        room[left].append(b)
        open_rooms |= 1 << left
    return bins, offsets


def _round(length: int, least: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        items = rows.groupby("bin", sort=True)["length"].sum()
        bins, offsets = best_fit(items.to_numpy(np.int64), length)
        names = items.index.to_numpy(np.int64)
        name = np.full(bins.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(name, bins, names)
        fill = np.bincount(bins, items.to_numpy(np.int64))
        at = np.searchsorted(names, rows["bin"].to_numpy(np.int64))
        rows = rows.copy()
        rows["offset"] = rows["offset"].to_numpy(np.int64) + offsets[at]
        rows["bin"] = name[bins[at]]
        rows["done"] = fill[bins[at]] >= least
        return rows[["bin", "offset", "length", "row", "done"]]

    return run


def pack(cut: DataFrame, length: int = LENGTH, nearly_full: float = NEARLY_FULL, bins_per_group: int = BINS_PER_GROUP) -> DataFrame:
    """``cut`` (any rows with a column ``length`` of 1 to ``length``) with sequence_id and offset.

    Every row is in exactly one sequence; a sequence's rows stand without gaps from offset 0 and sum up to at most ``length``.
    """
    given = "_row"
    while given in cut.columns:
        given += "_"
    with scratch() as cuts:
        cut = cuts.cut(cut.withColumn(given, F.monotonically_increasing_id()))
        items = cut.select(F.col(given).alias("row"), F.col("length").cast("long").alias("length"))
        kinds = "bin long, offset long, length long, row long, done boolean"
        full = items.where(F.col("length") >= length)
        emitted = [full.select(F.col("row").alias("bin"), F.lit(0).cast("long").alias("offset"), "row")]
        left = items.where(F.col("length") < length).select(F.col("row").alias("bin"), F.lit(0).cast("long").alias("offset"), "length", "row")
        bins, groups = left.count(), None
        while bins:
            wanted = -(-bins // bins_per_group)
            groups = wanted if groups is None else max(-(-groups // FAN_IN), wanted)
            dealt = left.withColumn("_group", F.pmod(F.xxhash64("bin"), F.lit(groups)))
            packed = cuts.cut(dealt.groupBy("_group").applyInPandas(_round(length, int(nearly_full * length)), kinds))
            under = packed.where(~F.col("done"))
            now = under.select("bin").distinct().count()
            if groups == 1 or now > 0.9 * bins:  # one group has seen everything, or nothing fits any more
                emitted.append(packed.select("bin", "offset", "row"))
                break
            emitted.append(packed.where("done").select("bin", "offset", "row"))
            left, bins = under.drop("done"), now
        placed = emitted[0]
        for part in emitted[1:]:
            placed = placed.unionByName(part)
        placed = placed.select(F.col("row").alias(given), F.col("bin").alias("sequence_id"), "offset")
        return durable(cut.drop("sequence_id", "offset").join(placed, given).drop(given))
