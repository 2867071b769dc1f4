"""Alignment of two tokenizers' tokens by lockstep merging of their byte ranges, and how often the corpus links their ids.

Both tokenizers read the same bytes: a space and the text. Their tokens are merged by byte offset. All texts of a slice run at once: one NumPy
state vector holds for every text the pointers into its A and its B tokens. Each step emits the link of the two tokens pointed at, advances
the pointer whose token ends first, and both, with a cut, where both end at one offset. Texts that are through leave the vector. A long text
enters as several lanes, each starting at an offset where a token of either side ends, so that the number of steps is bounded by the lane and
not by the longest text; its lanes are put together again by their places.

Corpus counts. A slice is a block: one row with its own dictionary of linked id pairs, how many of its documents hold each, and for every document
places in the dictionary with multiplicities. Only dictionaries are summed over the corpus, and each block asks once for each of its pairs, so a pair that
every document holds meets in one row per block. A pair's rows are dealt by a salt besides. Answers return to their block and give the figures
of its documents.

Rows. Texts that are null or empty, or whose joined A or B bytes are not the space and the text, have no tokens: all zeros. Ids may be null or repeated, each
row counts as a document. An empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from fluxloom.session import durable, scratch

SLICE_CHARS = 1 << 20  # texts aligned together; a longer text is a slice of its own, whole
LANE = 768  # tokens of side A that a lane takes before it may end at the next common offset
SHIFT = 32  # an id pair is one number: id of A, then id of B
SALTS = 16

Encode = Callable[[list[str]], list[np.ndarray]]


class Side:
    """One tokenizer: ``encode`` gives the ids of texts, ``data[start[i]:start[i + 1]]`` the bytes of id i."""

    def __init__(self, encode: Encode, tokens: list[bytes]):
        self.encode = encode
        self.size = np.array([len(t) for t in tokens], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.data = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """The joined bytes of tokens."""
        sizes = self.size[ids]
        first = np.cumsum(sizes) - sizes
        return self.data[np.repeat(self.start[ids] - first, sizes) + np.arange(int(sizes.sum()))]


def _byte_level() -> dict[str, int]:
    """Byte of every character of byte-level pieces: printable Latin-1 stands for itself, the rest for 256 and up, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(other)}}


@lru_cache(maxsize=2)
def byte_side(path: str) -> Side:
    """A byte-level tokenizer file. Special tokens' strings inside a text are plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(path)
    coder.encode_special_tokens = True
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    of = _byte_level()
    tokens = [b""] * (1 + max([*vocabulary.values(), *coder.get_vocab().values()]))
    for piece, i in vocabulary.items():
        tokens[i] = bytes(of[c] for c in piece) if all(c in of for c in piece) else piece.encode()

    def encode(texts: list[str]) -> list[np.ndarray]:
        # one text at a time: the library's own result is many times a text's size
        return [np.array(coder.encode(" " + t, add_special_tokens=False).ids, dtype=np.int64) for t in texts]

    return Side(encode, tokens)


@lru_cache(maxsize=2)
def rank_side(path: str, pattern: str) -> Side:
    """The same kind of tokenizer from a file of ranks (base64 of the bytes, a space, the id) and its splitting pattern."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(i) for token, i in map(bytes.split, file)}
    coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    tokens = [b""] * (1 + max(ranks.values()))
    for token, i in ranks.items():
        tokens[i] = token
    return Side(lambda texts: [np.array(coder.encode_ordinary(" " + t), dtype=np.int64) for t in texts], tokens)


@lru_cache(maxsize=2)
def piece_side(path: str) -> Side:
    """A sentence-piece model: U+2581 is a space, ``<0xHH>`` a byte; it puts the space before the text itself."""
    import sentencepiece

    coder = sentencepiece.SentencePieceProcessor(model_file=path)
    tokens = []
    for i in range(coder.get_piece_size()):
        piece = coder.id_to_piece(i)
        tokens.append(bytes([int(piece[3:5], 16)]) if coder.is_byte(i) else piece.replace("▁", " ").encode())
    return Side(lambda texts: [np.array(coder.encode(t, num_threads=1), dtype=np.int64) for t in texts], tokens)


def _same_bytes(side: Side, ids: list[np.ndarray], raw: list[bytes]) -> np.ndarray:
    """Which texts' joined token bytes are exactly ``raw``."""
    out = np.zeros(len(ids), dtype=bool)
    for i, (own, want) in enumerate(zip(ids, raw)):
        out[i] = int(side.size[own].sum()) == len(want) and side.bytes_of(own).tobytes() == want
    return out


def _lanes(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in A and B where lanes start: at every text, and at the first common offset after each ``LANE`` tokens of a long one."""
    starts_a, starts_b = [first_a[:-1]], [first_b[:-1]]
    for t in np.flatnonzero(np.diff(first_a) > LANE + LANE // 2):
        a, b = ends_a[first_a[t] : first_a[t + 1]], ends_b[first_b[t] : first_b[t + 1]]
        aim, at = LANE, []
        while aim < len(a):
            # look a few tokens ahead for one that ends where a token of B ends
            near = a[aim - 1 : aim + 63]
            k = np.searchsorted(b, near)
            hit = np.flatnonzero(b[k] == near)  # the last offsets are equal, so k stays inside
            if not len(hit):
                aim += 64
                continue
            here = aim + int(hit[0])
            if here < len(a):
                at.append((here, int(k[hit[0]]) + 1))
            aim = here + LANE
        if at:
            starts_a.append(first_a[t] + np.array([x for x, _ in at]))
            starts_b.append(first_b[t] + np.array([y for _, y in at]))
    all_a, all_b = np.concatenate(starts_a), np.concatenate(starts_b)
    order = np.argsort(all_a, kind="stable")
    return all_a[order], all_b[order]


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (place in A, place in B), in text order, and whether a cut follows each.

    Tokens of all texts lie one after the other; ``ends`` are byte offsets that go on from text to text, ``first`` the places where the texts' tokens
    begin. Every text has tokens, and both sides of a text end at one offset.
    """
    a, b = _lanes(ends_a, ends_b, first_a, first_b)
    stop_a = np.append(a[1:], first_a[-1])
    longest = (stop_a - a) + (np.append(b[1:], first_b[-1]) - b)
    slot = np.cumsum(longest) - longest  # a lane makes fewer links than it has tokens
    room = int(longest.sum())
    link_a, link_b = np.full(room, -1, dtype=np.int64), np.zeros(room, dtype=np.int64)
    cut = np.zeros(room, dtype=bool)
    while len(a):
        end_a, end_b = ends_a[a], ends_b[b]
        link_a[slot], link_b[slot] = a, b
        cut[slot] = end_a == end_b
        slot += 1
        a = a + (end_a <= end_b)
        b = b + (end_b <= end_a)
        alive = a < stop_a
        if not alive.all():  # texts that are through leave the state
            a, b, slot, stop_a = a[alive], b[alive], slot[alive], stop_a[alive]
    made = link_a >= 0
    return link_a[made], link_b[made], cut[made]


def _texts_of_groups(ids_a, ids_b, group_a, group_b, bounds_a, bounds_b, names) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of every text."""
    last_a = np.append(group_a[1:] != group_a[:-1], True)
    last_b = np.append(group_b[1:] != group_b[:-1], True)
    # A token's place in the mixed order: tokens of its own side before it, and the other side's of earlier groups (A first).
    groups = int(group_a[-1]) + 1 if len(group_a) else 0
    n_a, n_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    before_a, before_b = np.cumsum(n_a), np.cumsum(n_b) - n_b
    mixed = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
    mixed[np.arange(len(ids_a)) + before_b[group_a]] = ids_a * 4 + last_a
    mixed[np.arange(len(ids_b)) + before_a[group_b]] = ids_b * 4 + 2 + last_b
    bounds = bounds_a + bounds_b
    return ["".join(map(names.__getitem__, mixed[x:y].tolist()))[:-1] for x, y in zip(bounds[:-1], bounds[1:])]


@lru_cache(maxsize=1)
def _names(n: int) -> list[str]:
    """Text of an id, by side and by what follows: id * 4, plus 2 for side B, plus 1 at the end of its group."""
    return [f"{i}{mark}" for i in range(n) for mark in (",", "|", ",", ";")]


def align(texts: list[str | None], a: Side, b: Side) -> dict[str, np.ndarray | list]:
    """Figures of every text, and its links as distinct id pairs with multiplicities.

    n_a, n_b, n_groups, n_links and groups ('' without tokens) are per text; pair, times are the distinct pairs of
    text 0, then of text 1 and so on, ``first`` their bounds.
    """
    n = len(texts)
    out = {k: np.zeros(n, dtype=np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
    groups: list[str] = [""] * n
    here = [i for i, t in enumerate(texts) if t]
    raw = [b" " + texts[i].encode() for i in here]
    ids_a, ids_b = a.encode([texts[i] for i in here]), b.encode([texts[i] for i in here])
    fine = _same_bytes(a, ids_a, raw) & _same_bytes(b, ids_b, raw)
    kept = np.flatnonzero(fine)
    rows = np.array(here, dtype=np.int64)[kept]
    pair = times = np.zeros(0, dtype=np.int64)
    owner = np.zeros(0, dtype=np.int64)
    if len(kept):
        ids_a, ids_b = [ids_a[i] for i in kept], [ids_b[i] for i in kept]
        first_a = np.concatenate([[0], np.cumsum([len(x) for x in ids_a])])
        first_b = np.concatenate([[0], np.cumsum([len(x) for x in ids_b])])
        flat_a, flat_b = np.concatenate(ids_a), np.concatenate(ids_b)
        link_a, link_b, cut = lockstep(np.cumsum(a.size[flat_a]), np.cumsum(b.size[flat_b]), first_a, first_b)
        group = np.cumsum(cut) - cut
        group_a, group_b = np.empty(len(flat_a), dtype=np.int64), np.empty(len(flat_b), dtype=np.int64)
        group_a[link_a], group_b[link_b] = group, group
        text = np.searchsorted(first_a, link_a, side="right") - 1
        out["n_a"][rows], out["n_b"][rows] = np.diff(first_a), np.diff(first_b)
        out["n_groups"][rows] = np.bincount(text[cut], minlength=len(rows))
        out["n_links"][rows] = np.bincount(text, minlength=len(rows))
        names = _names(max(len(a.size), len(b.size)))
        for i, value in zip(rows, _texts_of_groups(flat_a, flat_b, group_a, group_b, first_a, first_b, names)):
            groups[i] = value
        # distinct pairs of a text: id pairs are numbered in the slice first, so that text and pair fit one number
        codes, number = np.unique((flat_a[link_a] << SHIFT) | flat_b[link_b], return_inverse=True)
        both, times = np.unique(rows[text] * len(codes) + number, return_counts=True)
        owner, pair = both // len(codes), codes[both % len(codes)]
    first = np.searchsorted(owner, np.arange(n + 1))
    return {**out, "groups": groups, "pair": pair, "times": times, "first": first}


def _narrow(x: np.ndarray) -> bytes:
    """The width, then the numbers in as few bytes each as the largest needs."""
    width = 1 if not len(x) or x.max() < 1 << 8 else 2 if x.max() < 1 << 16 else 4 if x.max() < 1 << 32 else 8
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _wide(x: bytes) -> np.ndarray:
    return np.frombuffer(x, dtype=f"<u{x[0]}", offset=1).astype(np.int64)


def _coded(make_sides, slice_chars: int, id_type: pa.DataType):
    """One row per block: the figures of its documents, their links as places in the block's dictionary, and the dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        a, b = make_sides()
        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1).to_pylist()
            row = 0
            while row < len(texts):
                stop, size = row, 0
                while stop < len(texts) and (stop == row or size + len(texts[stop] or "") <= slice_chars):
                    size += len(texts[stop] or "")
                    stop += 1
                got = align(texts[row:stop], a, b)
                pairs, place, docs = np.unique(got["pair"], return_inverse=True, return_counts=True)
                n = stop - row
                first = got["first"]
                # places rise within a document: their differences are small
                steps = np.diff(place, prepend=0)
                begins = first[:-1][first[1:] > first[:-1]]
                steps[begins] = place[begins]
                hashes = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in got["groups"]]
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), values)  # noqa: B023,E731
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part << 33 | made], pa.int64()),
                        one(batch.column(0).slice(row, n).cast(id_type)),
                        *[one(pa.array(got[k], pa.int64())) for k in ("n_a", "n_b", "n_groups", "n_links")],
                        one(pa.array(hashes, pa.string())),
                        pa.array([_narrow(np.diff(first))], pa.binary()),
                        pa.array([_narrow(steps)], pa.binary()),
                        pa.array([_narrow(got["times"])], pa.binary()),
                        pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pa.array(pairs, pa.int64())),
                        pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pa.array(docs, pa.int64())),
                    ],
                    ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "sizes", "steps", "times", "pairs", "docs"],
                )
                made += 1
                row = stop

    return run


FIGURES = ("n_a", "n_b", "n_groups", "n_links")


def _finish(names: list[str]):
    """Documents of a block with their corpus figures."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        order = np.argsort(answers["pair"].to_numpy(), kind="stable")
        known, count, best = (answers[c].to_numpy()[order] for c in ("pair", "docs", "best"))
        r = {c: blocks[c].combine_chunks() for c in blocks.column_names}
        sizes, steps, times = (_wide(r[c][0].as_py()) for c in ("sizes", "steps", "times"))
        first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        climbed = np.concatenate([[0], np.cumsum(steps)])
        place = climbed[1:] - np.repeat(climbed[first[:-1]], sizes)
        at = np.searchsorted(known, r["pairs"].flatten().to_numpy())[place]

        def total(x: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
            return sums[first[1:]] - sums[first[:-1]]

        figures = {"n_best": pa.array(total(times * best[at])), "count_sum": pa.array(total(times * count[at]))}
        return pa.table([figures[c] if c in figures else r[c].flatten() for c in names], names=names)

    return run


def aligned(docs: DataFrame, make_sides: Callable[[], tuple[Side, Side]], slice_chars: int = SLICE_CHARS) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs) of ``docs`` (doc_id, text).

    Documents: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair count is the highest of their A id, ties included), count_sum (pair
    counts summed over links) and groups_sha256. Pairs: a, b, docs (how many documents link the ids) and best. Other columns of ``docs`` are not read.
    """
    given = docs.select("doc_id", "text")
    id_type = given.schema["doc_id"].dataType
    out = StructType().add("doc_id", id_type)
    for c in (*FIGURES, "n_best", "count_sum"):
        out = out.add(c, "long")
    out = out.add("groups_sha256", "string")
    many = lambda t: ArrayType(t)
    block = StructType().add("block", "long").add("doc_id", many(id_type))
    for c in FIGURES:
        block = block.add(c, many(LongType()))
    block = block.add("groups_sha256", many(StringType()))
    for c in ("sizes", "steps", "times"):
        block = block.add(c, "binary")
    block = block.add("pairs", many(LongType())).add("docs", many(LongType()))
    with scratch() as cuts:
        coded = cuts.cut(given.mapInArrow(_coded(make_sides, slice_chars, to_arrow_type(id_type)), block))
        asked = coded.select("block", F.explode(F.arrays_zip("pairs", "docs")).alias("x")).select("block", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))
        sums = asked.groupBy("pair").agg(F.sum("docs").alias("docs")).withColumn("a", F.shiftright("pair", SHIFT))
        top = sums.groupBy("a").agg(F.max("docs").alias("top"))
        pairs = durable(sums.join(top, "a").select("pair", "docs", (F.col("docs") == F.col("top")).alias("best")))
        # Each block asks once per pair; a pair that all blocks ask for is dealt by a salt.
        salt = F.pmod(F.col("block"), F.lit(SALTS))
        salted = pairs.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        answers = asked.select(F.col("block").alias("to"), "pair", salt.alias("salt")).join(salted, ["pair", "salt"]).select("to", "pair", "docs", "best")
        names = out.fieldNames()
        done = coded.drop("docs").groupBy("block").cogroup(answers.groupBy("to")).applyInArrow(_finish(names), out)
        found = durable(done)
    split = pairs.select(F.shiftright("pair", SHIFT).alias("a"), F.col("pair").bitwiseAND((1 << SHIFT) - 1).alias("b"), "docs", "best")
    return found, split
