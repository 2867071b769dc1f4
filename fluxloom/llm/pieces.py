"""SentencePiece encoding and decoding of a byte-pair model as a relational lattice.

Texts are split into units that no piece crosses: between characters that are neighbours in no piece, so before white space at the latest. Every
different unit is encoded once: its substrings up to the longest piece are exploded and equi-joined to the piece table, the edges found are grouped by the unit's 64-bit key, and
Spark's ``aggregate`` folds them. A byte-pair model does not choose the path of best summed score, which is what a Viterbi fold finds; its
tokenizer joins the neighbouring pair of best score first. So the fold keeps the unit's cuts as bits and applies an edge where it joins exactly two present
pieces. One pass over the edges, best first, does that unless a join completes the parts of a better edge that was passed by (the vocabulary tells
which pieces can, and only their joins are looked after); such units are folded step by step, taking the best edge of all each time. The result is that of the reference library, id by id. Characters without a piece become byte pieces.
Units of over ``LONGEST`` characters do not fit the bits; they are joined one by one in the task that holds their texts, by the same rule.

Units meet their documents again by bucket of documents: each bucket asks once for every unit it holds, however often it occurs there. The buckets that ask
for a unit travel with it, and its ids go back to them; texts are shuffled once, for both the asking and the meeting, in compressed batches of a bucket's rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from fluxloom.llm.words import MIX, SLICE_BYTES, mix64, signed, span_sums, text_buffer

SPACE = "▁"
LONGEST = 60
BUCKET_CHARS = 48_000_000
PACKED_BYTES = 1 << 21  # of texts that travel together
CHARS_PER_TASK = 4_000_000
ID_BITS = 22
LATE = 1 << ID_BITS - 1  # the highest of them; ids and code points are below
TOGETHER = 256  # texts decoded and handed on in one go
PACKED_LEVEL = 6  # of compression


class Pieces:
    """The piece table of a model file: text, id and rank (0 joins first), and the id of byte 0."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.texts = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        plain = [i for i in range(len(self.texts)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.byte0 = model.piece_to_id("<0x00>")
        if self.byte0 == model.unk_id():
            raise ValueError("the model has no byte pieces")
        if any(SPACE in self.texts[i].lstrip(SPACE) for i in plain):
            raise ValueError("a piece crosses words")
        self.rows = [(self.texts[i], i, -float(model.get_score(i))) for i in plain]
        self.width = max(len(t) for t, _, _ in self.rows)

    def id_type(self) -> str:
        """The narrowest type of ids: they travel in it."""
        return "smallint" if len(self.texts) <= 1 << 15 else "int"

    def touching(self) -> np.ndarray:
        """Whether a character that ends in byte a and one that begins with byte b are neighbours in any piece, by 256 * a + b. Others are never joined.

        True inside a character.
        """
        out = np.zeros((256, 256), dtype=bool)
        out[:, 0x80:0xC0] = True
        for text, _, _ in self.rows:
            chars = [c.encode("utf-8") for c in text.replace(SPACE, " ")]
            for a, b in zip(chars, chars[1:]):
                out[a[-1], b[0]] = True
        return out.reshape(-1)

    def late(self) -> set[str]:
        """Pieces that are a part of a piece that joins no later than they do: only these can complete the parts of an edge passed by."""
        ranks = {t: r for t, _, r in self.rows}
        splits = ((text, r, a, b) for text, _, r in self.rows for a, b in ((text[:k], text[k:]) for k in range(1, len(text))))
        return {x for _, r, a, b in splits for x, y in ((a, b), (b, a)) if len(x) > 1 and ranks.get(x, -np.inf) >= r and (len(y) == 1 or y in ranks)}


class Units:
    """Units of consecutive texts: byte spans in ``data`` (white space as 0x20), 64-bit keys, lengths, and the first unit of every text.

    ``touching`` is that of the pieces. A dummy space opens every text that is not empty, as in the library.
    """

    def __init__(self, raw: np.ndarray, text_ends: np.ndarray, touching: np.ndarray):
        begins = np.concatenate([[0], text_ends[:-1]])
        full = text_ends > begins
        self.data = np.insert(raw, begins[full], 32)
        text_ends = text_ends + np.cumsum(full)
        opens = np.concatenate([[0], text_ends[:-1]])[full]
        start = np.ones(len(self.data), dtype=bool)
        start[1:] = ~touching[self.data[:-1].astype(np.uint16) << 8 | self.data[1:]]
        start[opens] = True
        self.starts = np.flatnonzero(start)
        self.ends = np.append(self.starts[1:], len(self.data)) if len(self.starts) else self.starts
        sums = span_sums(self.data.astype(np.uint64) + np.uint64(1), self.starts, self.ends)
        self.keys = mix64(sums + (self.ends - self.starts).astype(np.uint64) * np.uint64(MIX[1]))
        chars = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        self.long = chars[self.ends] - chars[self.starts] > LONGEST
        self.first = np.searchsorted(self.starts, np.concatenate([[0], text_ends]))

    def texts(self, chosen: np.ndarray) -> pa.Array:
        """The chosen units, with ``SPACE`` for white space."""
        starts, size = self.starts[chosen], self.ends[chosen] - self.starts[chosen]
        at = np.concatenate([[0], np.cumsum(size)])
        data = self.data[np.arange(at[-1]) + np.repeat(starts - at[:-1], size)]
        found = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])
        return pc.replace_substring(found, " ", SPACE)


def _sliced_units(column: pa.Array, touching: np.ndarray) -> Iterator[tuple[int, Units]]:
    """(number of texts, units) over slices of about ``SLICE_BYTES``; a longer text is a slice of its own."""
    raw, ends = text_buffer(pc.replace_substring(column, SPACE, " "))
    row, n = 0, len(ends)
    while row < n:
        begin = int(ends[row - 1]) if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, begin + SLICE_BYTES, side="right")))
        yield stop - row, Units(raw[begin : int(ends[stop - 1])], ends[row:stop] - begin, touching)
        row = stop


def _packed(buckets: int):
    """(bucket, texts): consecutive rows (doc_id, text) of a task, about ``PACKED_BYTES`` together and compressed, dealt to the buckets in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = TaskContext.get().partitionId() * 7919
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            for row in np.split(np.arange(len(ends)), 1 + np.flatnonzero(np.diff(ends // PACKED_BYTES))):
                if not len(row):
                    continue
                sink, rows = pa.BufferOutputStream(), batch.slice(row[0], len(row))
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", PACKED_LEVEL))) as stream:
                    stream.write_batch(rows)
                bucket = (bucket + 1) % buckets
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["bucket", "texts"])

    return run


def _unpacked(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) of what ``_packed`` made, one batch of them at a time."""
    for texts in table.column("texts"):
        yield from pa.ipc.open_stream(texts.as_buffer())


def _asked(touching: np.ndarray):
    """(bucket, key, unit) of a bucket's texts, each unit once; long ones are not asked for."""

    def run(table: pa.Table) -> pa.Table:
        seen, keys, texts = np.zeros(0, dtype=np.uint64), [], []
        for batch in _unpacked(table):
            for _, units in _sliced_units(batch.column("text"), touching):
                key, at = np.unique(units.keys, return_index=True)
                at = at[~units.long[at]]
                key = units.keys[at]
                fresh = np.searchsorted(seen, key)
                new = seen[np.minimum(fresh, len(seen) - 1)] != key if len(seen) else np.ones(len(key), dtype=bool)
                keys.append(key[new])
                texts.append(units.texts(at[new]))
                seen = np.insert(seen, fresh[new], key[new])
        n = sum(len(k) for k in keys)
        bucket = pa.array(np.full(n, table.column("bucket")[0].as_py() if len(table) else 0, dtype=np.int32))
        unit = pa.chunked_array(texts, pa.large_string()).combine_chunks().cast(pa.string())
        return pa.table({"bucket": bucket, "key": pa.array(signed(np.concatenate([np.zeros(0, np.uint64), *keys]))), "unit": unit})

    return run


def _lattice(units: DataFrame, pieces: Pieces) -> DataFrame:
    """(buckets, key, ids) of units (buckets, key, unit) up to ``LONGEST`` characters, which lie together by ``key``.

    An edge is one number: the order in which its piece joins, where it starts, its size, whether its piece is ``late``, and the piece's id; for a
    character without a piece the order is the last and its code point stands for the id.
    """
    n = F.char_length("unit")
    order = {r: k for k, r in enumerate(sorted({r for _, _, r in pieces.rows}))}
    if max(len(order), max(i for _, i, _ in pieces.rows)) >= LATE:
        raise ValueError("the model has too many pieces")
    left = lambda c, bits: F.call_function("shiftleft", c, bits if isinstance(bits, Column) else F.lit(bits))
    last = len(order) << ID_BITS + 12
    late = pieces.late()
    table = units.sparkSession.createDataFrame([(t, (order[r] << ID_BITS + 12) + i + LATE * (t in late)) for t, i, r in pieces.rows], "piece string, code long")
    starts = units.select("buckets", "key", "unit", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    spans = starts.select("buckets", "key", "unit", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.width), n - F.col("i")))).alias("size"))
    spans = spans.select(F.when((F.col("i") == 0) & (F.col("size") == 1), F.col("buckets")).alias("buckets"), "key", "i", "size", F.substring("unit", F.col("i") + 1, F.col("size")).alias("piece"))
    edges = spans.join(F.broadcast(table), "piece", "left").where(F.col("code").isNotNull() | (F.col("size") == 1))
    code = F.coalesce("code", last + F.ascii("piece")) + left((F.col("i") * 64 + F.col("size")).cast("long"), ID_BITS)
    grouped = edges.groupBy("key").agg(F.first("buckets", ignorenulls=True).alias("buckets"), F.array_sort(F.collect_list(code)).alias("codes"))

    def edge(c: Column) -> Column:
        low = left(F.lit(1).cast("long"), F.shiftright(c, ID_BITS + 6).bitwiseAND(63).cast("int"))
        high = left(low, F.shiftright(c, ID_BITS).bitwiseAND(63).cast("int"))
        return F.struct(c.alias("code"), (low + high).alias("ends"), (high - low).alias("inside"), low.alias("low"), (c.bitwiseAND(LATE) > 0).alias("late"))

    def present(cuts: Column, e: Column, pieces_inside: int) -> Column:
        return (cuts.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(cuts.bitwiseAND(e["inside"])) == pieces_inside)

    def joined(cuts: Column, e: Column) -> Column:
        return cuts - cuts.bitwiseAND(e["inside"]) + e["low"]

    def one_pass(state: Column, e: Column) -> Column:
        cuts = joined(state["cuts"], e)
        passed = e["late"] & F.exists("joins", lambda f: (f["code"] < e["code"]) & present(cuts, f, 2))
        return F.when(present(state["cuts"], e, 2), F.struct(cuts.alias("cuts"), (state["late"] | passed).alias("late"))).otherwise(state)

    def best_of_all(cuts: Column, _: Column) -> Column:
        best = F.get(F.filter("joins", lambda e: present(cuts, e, 2)), F.lit(0))
        return F.coalesce(joined(cuts, best), cuts)

    def ids(e: Column) -> Column:
        """Of a present piece (where it starts, id or code point, whether it has an id)."""
        c, mark, low = e["id"], lambda bits: F.shiftright(e["id"], bits).bitwiseAND(63) + 128, lambda c: c.cast("int") + pieces.byte0
        each = F.when(c < 0x80, F.array(low(c))).when(c < 0x800, F.array(low(F.shiftright(c, 6) + 0xC0), low(mark(0))))
        each = each.when(c < 0x10000, F.array(low(F.shiftright(c, 12) + 0xE0), low(mark(6)), low(mark(0))))
        each = each.otherwise(F.array(low(F.shiftright(c, 18) + 0xF0), low(mark(12)), low(mark(6)), low(mark(0))))
        return F.when(e["known"], F.array(e["id"])).otherwise(each)

    several = lambda c: F.shiftright(c, ID_BITS).bitwiseAND(63) > 1
    grouped = grouped.withColumn("joins", F.transform(F.filter("codes", several), edge))
    size = F.aggregate("codes", F.lit(0).cast("long"), lambda m, c: F.greatest(m, F.shiftright(c, ID_BITS + 6).bitwiseAND(63) + 1))
    grouped = grouped.withColumn("every", left(F.lit(1).cast("long"), (size + 1).cast("int")) - 1)
    grouped = grouped.withColumn("pass", F.aggregate("joins", F.struct(F.col("every").alias("cuts"), F.lit(False).alias("late")), one_pass))
    stepwise = F.aggregate(F.sequence(F.lit(2), F.greatest(F.bit_count("every"), F.lit(2))), F.col("every"), best_of_all)
    grouped = grouped.withColumn("cuts", F.when(F.col("pass.late"), stepwise).otherwise(F.col("pass.cuts")))
    here = lambda c: present(F.col("cuts"), edge(c), 1)
    piece = lambda c: F.struct(F.shiftright(c, ID_BITS + 6).bitwiseAND(63).cast("int").alias("i"), c.bitwiseAND(LATE - 1).cast("int").alias("id"), (c < last).alias("known"))
    path = F.array_sort(F.transform(F.filter("codes", here), piece))
    plain = F.transform("path", lambda e: e["id"])
    grouped = grouped.select("buckets", "key", path.alias("path"))
    found = F.when(F.exists("path", lambda e: ~e["known"]), F.flatten(F.transform("path", ids))).otherwise(plain)
    return grouped.select("buckets", "key", found.cast(f"array<{pieces.id_type()}>").alias("ids"))


def join_pairs(unit: str, ranks: dict[str, float], ids: dict[str, int], byte0: int) -> list[int]:
    """The same rule for one unit: join the leftmost neighbouring pair of best rank until none is a piece. Pairs wait in a heap, so a unit of n
    characters takes n * log(n) steps."""
    parts: list[str | None] = list(unit)
    before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
    waiting = [(ranks[x + y], k, x + y) for k, (x, y) in enumerate(zip(unit, unit[1:])) if x + y in ranks]
    heapify(waiting)
    while waiting:
        _, k, joined = heappop(waiting)
        right = after[k]
        # the pair may be gone: one of its parts was joined with another neighbour meanwhile
        if parts[k] is None or right >= len(parts) or parts[k] + parts[right] != joined:
            continue
        parts[k], parts[right], after[k] = joined, None, after[right]
        if after[k] < len(parts):
            before[after[k]] = k
        for left, end in ((before[k], k), (k, after[k])):
            if left >= 0 and end < len(parts) and parts[left] + parts[end] in ranks:
                heappush(waiting, (ranks[parts[left] + parts[end]], left, parts[left] + parts[end]))
    return [i for p in parts if p is not None for i in ([ids[p]] if p in ids else [byte0 + b for b in p.encode("utf-8")])]


def _assembled(rows: list[tuple[str, int, float]], byte0: int, touching: np.ndarray, id_type: str):
    """A bucket's texts with the ids of their units, from what it asked for."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("ids", pa.list_(pa.int16() if id_type == "smallint" else pa.int32()))])

    def run(packed: pa.Table, known: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()  # what the worker's earlier tasks have left
        ranks, ids = {t: r for t, _, r in rows}, {t: i for t, i, _ in rows}
        lists = known.column("ids").combine_chunks()
        keys, sizes, flat = known.column("key").to_numpy().view(np.uint64), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy()
        order = np.argsort(keys)
        keys, size, start = keys[order], sizes[order], (np.cumsum(sizes) - sizes)[order]
        found, long, kind = [schema.empty_table()], {}, schema.field("ids").type.value_type.to_pandas_dtype()
        for batch in _unpacked(packed):
            out, counts = [], []
            for _, units in _sliced_units(batch.column("text"), touching):
                place = np.minimum(np.searchsorted(keys, units.keys), max(len(keys) - 1, 0))
                at, count, pool = (start[place], size[place], flat) if len(keys) else (np.zeros(len(place), np.int64), np.zeros(len(place), np.int64), flat)
                if not (units.long | (keys[place] == units.keys if len(keys) else False)).all():
                    raise ValueError("a unit has come back without its ids")
                if units.long.any():
                    which, own = np.unique(units.keys[units.long], return_index=True)
                    for k, text in zip(which.tolist(), units.texts(np.flatnonzero(units.long)[own]).to_pylist()):
                        if k not in long:
                            long[k] = np.array(join_pairs(text, ranks, ids, byte0), dtype=kind)
                    more = [long[k] for k in units.keys[units.long].tolist()]
                    at, count = at.copy(), count.copy()
                    count[units.long] = [len(x) for x in more]
                    at[units.long] = len(flat) + np.cumsum(count[units.long]) - count[units.long]
                    pool = np.concatenate([flat, *more])
                ends = np.concatenate([[0], np.cumsum(count)])
                out.append(pool[np.arange(ends[-1]) + np.repeat(at - ends[:-1], count)].astype(kind))
                counts.append(np.diff(ends[units.first]))
            offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *counts]))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, kind), *out])))
            found.append(pa.Table.from_arrays([batch.column("doc_id"), batch.column("text").cast(pa.string()), lists], schema=schema))
        return pa.concat_tables(found)

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, ids) for every row of ``docs``; the text is null where it was, and then has no ids.

    Ids are those of the model file's library. Empty texts have none. Rows with null or repeated ids are encoded like others. Other columns are not read.
    The result is not written down: it is made where it is read.
    """
    pieces = Pieces(path)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = int(rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0])
    touching = pieces.touching()
    dealt = rows.mapInArrow(_packed(total // BUCKET_CHARS + 1), "bucket int, texts binary").groupBy("bucket")
    asked = dealt.applyInArrow(_asked(touching), "bucket int, key long, unit string").repartition(total // CHARS_PER_TASK + 1, "key")
    units = asked.groupBy("key").agg(F.collect_list("bucket").alias("buckets"), F.first("unit").alias("unit"))
    known = _lattice(units, pieces).select(F.explode("buckets").alias("bucket"), "key", "ids")
    kind = pieces.id_type()
    found = dealt.cogroup(known.groupBy("bucket")).applyInArrow(_assembled(pieces.rows, pieces.byte0, touching, kind), f"doc_id long, text string, ids array<{kind}>")
    return found.select("doc_id", "text", F.col("ids").cast("array<int>").alias("ids"))


def _decoded(texts: list[str], byte0: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = [bytes([i - byte0]) if byte0 <= i < byte0 + 256 else t.replace(SPACE, " ").encode("utf-8") for i, t in enumerate(texts)]
        size = np.array([len(x) for x in raw], dtype=np.int64)
        start, data = np.cumsum(size) - size, np.frombuffer(b"".join(raw), dtype=np.uint8)
        pa.default_memory_pool().release_unused()  # what the worker's earlier tasks have left
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                part = batch.column(batch.num_columns - 1)
                ids = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(size[ids])])
                text = data[np.arange(ends[-1]) + np.repeat(start[ids] - ends[:-1], size[ids])].tobytes()
                counts = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
                bounds = ends[np.concatenate([[0], np.cumsum(counts)])].tolist()
                out = [text[a:b].decode("utf-8", "replace").removeprefix(" ") if known else None for a, b, known in zip(bounds, bounds[1:], part.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "decoded"])

    return run


def decode(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with ``decoded`` (replacing a column of that name): the text of the ids, without the dummy space. Ids travel in the narrowest type."""
    kept = [c for c in rows.columns if c not in ("decoded", ids_col)]
    model = Pieces(path)
    given = rows.schema[ids_col].dataType
    rows = rows.select(*kept, F.col(ids_col).cast(f"array<{model.id_type()}>").alias(ids_col))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    found = rows.mapInArrow(_decoded(model.texts, model.byte0), f"{kinds}, decoded string")
    return found.select(*kept, F.col(ids_col).cast(given).alias(ids_col), "decoded")
