"""Periodic runs of words by maximal-pair enumeration over the LCP-interval tree of every text.

A run is a stretch of consecutive words with smallest period q and at least ``max(LEAST, POWER * q)`` words that no neighbouring word
extends. Its first word s and s + q start a maximal pair: the longest common prefix l of the two suffixes ends where the
period breaks, the words to their left differ, and l >= (POWER - 1) * q. Conversely, take all places of one interval of the tree in order:
two neighbours of different left words that first meet in this interval, l being its depth, at a distance q with l >= (POWER - 1) * q and
q + l >= LEAST are a run as they stand. A smaller period would put another place of the interval between them, so neighbours suffice and no pair is
extended or compared with another.

Tree. Such an l has at least ``SHORTEST`` words, so only suffixes whose first four words occur twice in their text are sorted, by prefix
doubling over all texts of a slice at once (a word's number is its text's own, so nothing matches across texts). Depths between neighbours in
the order come from the same names. Intervals are then closed bottom-up with a stack; each keeps its places sorted, with the left word as
their class, and the smaller list is always merged into the larger one.

Rows. Null and empty texts have no words and no runs. Rows with a repeated or null id are handled one by one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StructType

LEAST = 6  # words of a run, at least
POWER = 4  # times its period, at least
SHORTEST = 5  # depth of a pair's interval: LEAST - 1 words at period 1, (POWER - 1) * q or more at longer ones
SLICE_CHARS = 1 << 20  # texts taken together; a longer text is taken alone, whole
LARGE = 4096  # places of an interval that one flat list holds; more are kept in blocks


class Places:
    """Sorted places of a large interval in blocks, so that a new place moves one block only."""

    __slots__ = ("blocks", "firsts", "size")

    def __init__(self, places: list[int]):
        half = LARGE // 2
        self.blocks = [places[i : i + half] for i in range(0, len(places), half)]
        self.firsts = [b[0] for b in self.blocks]
        self.size = len(places)

    def __len__(self) -> int:
        return self.size

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def put(self, x: int) -> tuple[int, int]:
        """Adds a place; the places next to it, or -1."""
        at = max(0, bisect_left(self.firsts, x) - 1)
        block = self.blocks[at]
        k = bisect_left(block, x)
        left = block[k - 1] if k else -1
        right = block[k] if k < len(block) else (self.firsts[at + 1] if at + 1 < len(self.blocks) else -1)
        block.insert(k, x)
        self.firsts[at] = block[0]
        self.size += 1
        if len(block) > LARGE:
            half = len(block) // 2
            self.blocks[at : at + 1] = [block[:half], block[half:]]
            self.firsts[at : at + 1] = [block[0], block[half]]
        return left, right


def _merge(large: list[int] | Places, small: list[int] | Places) -> tuple[list[int] | Places, list[tuple[int, int]]]:
    """Both lists as one, and the neighbours in it of which one comes from either list."""
    if len(large) < len(small):
        large, small = small, large
    if isinstance(large, list) and len(large) + len(small) > LARGE:
        large = Places(large)
    met = []
    if isinstance(large, Places):
        added = set(small)
        for x in small:
            left, right = large.put(x)
            if left >= 0 and left not in added:
                met.append((left, x))
            # a later place of ``small`` may still come between: sorted out below
            if right >= 0:
                met.append((x, right))
        kept = []
        rest = sorted(added)
        for x, y in met:
            k = bisect_left(rest, x + 1)
            if k == len(rest) or rest[k] >= y:
                kept.append((x, y))
        return large, kept
    if len(small) == 1:
        x = small[0]
        k = bisect_left(large, x)
        if k:
            met.append((large[k - 1], x))
        if k < len(large):
            met.append((x, large[k]))
        large.insert(k, x)
        return large, met
    added = set(small)
    merged = sorted(large + small)
    for x, y in zip(merged, merged[1:]):
        if (x in added) != (y in added):
            met.append((x, y))
    return merged, met


def _names(ids: np.ndarray) -> np.ndarray:
    """Rank of every value; equal values share one."""
    return np.unique(ids, return_inverse=True)[1].astype(np.int64)


def suffix_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes whose first four words occur twice, in order, and the depth each shares with the one before it.

    Depths under four are given as 0. ``words`` are numbers; a number stands in one text only, so no depth crosses texts.
    """
    n = len(words)
    if n < LEAST:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    top = int(words.max()) + 1

    def ahead(names: np.ndarray, h: int) -> np.ndarray:
        """Names h words on; beyond the end every place has a name of its own."""
        return np.concatenate([names[h:], int(names.max()) + 1 + np.arange(min(h, n), dtype=np.int64)])

    one = words.astype(np.int64)
    two = _names(one * (top + n) + ahead(one, 1))
    levels = [(1, one), (2, two)]
    pair = two * (2 * n + 2) + ahead(two, 2)
    order = np.argsort(pair, kind="stable")
    ranked = pair[order]
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    group = np.flatnonzero(fresh)
    head = np.repeat(group, np.diff(np.append(group, n)))
    names = np.empty(n, dtype=np.int64)
    names[order] = head  # a group's name is its place in the order, so refined names keep the order
    size = np.repeat(np.diff(np.append(group, n)), np.diff(np.append(group, n)))
    active = order[size > 1]
    start = head[size > 1]
    final = active
    h = 4
    levels.append((h, names))
    # ``final`` holds the repeated suffixes; groups of it are refined where they stand until all names differ.
    slots = np.arange(len(active))
    while len(active):
        nxt = ahead(names, h)[active]
        by = np.lexsort((nxt, start))
        active, start, nxt = active[by], start[by], nxt[by]
        final[slots] = active
        fresh = np.ones(len(active), dtype=bool)
        fresh[1:] = (start[1:] != start[:-1]) | (nxt[1:] != nxt[:-1])
        group = np.flatnonzero(fresh)
        sizes = np.diff(np.append(group, len(active)))
        first_of = np.ones(len(active), dtype=bool)
        first_of[1:] = start[1:] != start[:-1]
        base = np.maximum.accumulate(np.where(first_of, np.arange(len(active)), 0))
        new = start + np.repeat(group, sizes) - base
        names = names.copy()
        names[active] = new
        h *= 2
        levels.append((h, names))
        more = np.repeat(sizes, sizes) > 1
        active, start, slots = active[more], new[more], slots[more]
    a, b = final[:-1].copy(), final[1:].copy()
    depth = np.zeros(len(a), dtype=np.int64)
    for h, names in reversed(levels):
        far = np.maximum(a, b) < n
        same = np.zeros(len(a), dtype=bool)
        same[far] = names[a[far]] == names[b[far]]
        depth[same] += h
        a[same] += h
        b[same] += h
    depth[depth < 4] = 0
    return final, np.concatenate([[0], depth]) if len(final) else depth


def find_runs(words: np.ndarray, left: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, in no order. ``left`` is the word before each place, -1 where a text begins."""
    order, depths = suffix_order(words)
    if not len(order):
        return []
    before = left.tolist()
    found: list[tuple[int, int, int]] = []

    def join(depth: int, a: list[int] | Places, b: list[int] | Places) -> list[int] | Places:
        """Two children of an interval as one list; the runs among the pairs that meet are noted."""
        merged, met = _merge(a, b)
        for x, y in met:
            q = y - x
            if depth >= (POWER - 1) * q and depth + q >= LEAST and before[x] != before[y]:
                found.append((x, depth + q, q))
        return merged

    open_intervals: list[list] = []  # [depth, places], depths rise
    child: list[int] | Places = []
    for place, depth in zip(order.tolist(), depths.tolist()):
        while open_intervals and open_intervals[-1][0] > depth:
            inner, places = open_intervals.pop()
            child = join(inner, places, child)
        if depth >= SHORTEST:
            if open_intervals and open_intervals[-1][0] == depth:
                open_intervals[-1][1] = join(depth, open_intervals[-1][1], child)
            else:
                open_intervals.append([depth, child])
        child = [place]
    while open_intervals:
        inner, places = open_intervals.pop()
        child = join(inner, places, child)
    return found


def runs_of_texts(texts: list[str | None]) -> list[tuple[list[tuple[int, int, int]], str]]:
    """Of every text its runs by start and period, and the text without what repeats: a run keeps its first period."""
    split = [(t or "").encode().split() for t in texts]  # bytes: exactly 0x20 and 0x09-0x0D part words
    numbers, left, first = [], [], [0]
    known = 0
    for words in split:
        own = dict(zip(dict.fromkeys(words), range(known, known + len(words))))
        known += len(own)
        ids = [*map(own.__getitem__, words)]
        numbers += ids
        left += [-1, *ids[:-1]] if ids else []
        first.append(len(numbers))
    of_text: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    found = find_runs(np.array(numbers, dtype=np.int64), np.array(left, dtype=np.int64))
    if found:
        owner = np.searchsorted(np.array(first), np.array([r[0] for r in found]), side="right") - 1
        for t, (start, length, period) in zip(owner.tolist(), found):
            of_text[t].append((start - first[t], length, period))
    out = []
    for words, runs in zip(split, of_text):
        runs.sort(key=lambda r: (r[0], r[2]))
        if runs:
            stays = np.ones(len(words), dtype=bool)
            for start, length, period in runs:
                stays[start + period : start + length] = False
            words = [words[i] for i in np.flatnonzero(stays)]
        out.append((runs, b" ".join(words).decode()))
    return out


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUN_TYPE = StructType().add("start", "long").add("length", "long").add("period", "long")


def _sliced(texts: list[str | None], slice_chars: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about so many characters; a longer text is a range of its own."""
    row = 0
    while row < len(texts):
        stop, size = row, 0
        while stop < len(texts) and (stop == row or size + len(texts[stop] or "") <= slice_chars):
            size += len(texts[stop] or "")
            stop += 1
        yield row, stop
        row = stop


def with_runs(docs: DataFrame, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """Every row of ``docs`` with n_runs (long), runs (by start, then period) and collapsed, the text of the kept words joined by one space.

    Needs ``text``; given columns of these three names are replaced. Null and empty texts have no runs and an empty collapsed text.
    """
    made = ("n_runs", "runs", "collapsed")
    rest = [c for c in docs.columns if c not in made]
    at = rest.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for a, b in _sliced(texts, slice_chars):
                results = runs_of_texts(texts[a:b])
                runs = [[dict(zip(("start", "length", "period"), r)) for r in found] for found, _ in results]
                yield pa.RecordBatch.from_arrays(
                    [c.slice(a, b - a) for c in batch.columns]
                    + [pa.array([len(r) for r in runs], pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array([text for _, text in results], pa.string())],
                    [*rest, *made],
                )

    given = docs.select(*rest)
    schema = StructType([*given.schema.fields]).add("n_runs", "long").add("runs", ArrayType(RUN_TYPE)).add("collapsed", "string")
    return given.mapInArrow(run, schema)


def strongest(runs: str = "runs") -> Column:
    """The run with the greatest length per period; ties go to the smaller start, then the smaller period. Null without runs."""
    none = F.lit(None).cast(RUN_TYPE)
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, none, lambda best, r: F.when(better(best, r), r).otherwise(best))
