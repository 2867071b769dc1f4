"""Long units against the library, in useful time."""

import os
import random
import time

import numpy as np
import pyarrow as pa
import sentencepiece

from fluxloom.llm import pieces, queries
from fluxloom.session import shared_folder


def test_long_units_equal_the_library():
    path = queries.vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(library.id_to_piece(i), i, -library.get_score(i)) for i in range(library.get_piece_size()) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i))]
    ranks, ids, byte0 = {t: r for t, _, r in rows}, {t: i for t, i, _ in rows}, library.piece_to_id("<0x00>")
    rng = random.Random(3)
    texts = ["".join(rng.choice(alphabet) for _ in range(n)) for alphabet in ("ab", "etaoinshr", "漢字日本語", "ab🙂é", "the") for n in (1, 2, 3, 61, 400)] + ["a" * 500]
    for text in texts:
        assert pieces.join_pairs("▁" + text, ranks, ids, byte0) == library.encode(text), text[:40]
    begin = time.time()
    long = "".join(rng.choice("etaoinshrdlu") for _ in range(100_000))
    assert pieces.join_pairs("▁" + long, ranks, ids, byte0) == library.encode(long) and time.time() - begin < 5


def test_encoding_by_buckets_writes_nothing_down(spark, monkeypatch):
    """Units of every kind over several buckets and tasks; texts pass through one shuffle and no table in the shared folder."""
    monkeypatch.setattr(pieces, "BUCKET_CHARS", 4000)
    monkeypatch.setattr(pieces, "CHARS_PER_TASK", 2000)
    path = queries.vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(5)
    alphabets = ["ab ", "etaoin shr", "漢字日本語 ", "ab🙂é▁ ", "the  \n", "&$#*ß ü"]
    rows = [(i % 7 if i % 5 else None, "".join(rng.choice(alphabets[i % 6]) for _ in range(rng.choice([0, 1, 3, 20, 200, 900])))) for i in range(120)]
    rows += [(1, None), (1, ""), (2, "   "), (3, "▁"), (3, "a▁▁b"), (4, "x" * 500), (4, " trailing  "), (5, "a" * 59), (5, "é" * 60), (5, "é" * 61), (5, "é" * 61)]
    folder = shared_folder(spark)
    before = set(os.listdir(folder))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = pieces.decode(pieces.encode(docs, path), path).collect()
    assert set(os.listdir(folder)) == before
    order = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r.doc_id, r.text) for r in got), key=order) == sorted(rows, key=order)
    for r in got:
        assert list(r.ids) == library.encode(r.text or "") and r.decoded == (r.text or "").replace("▁", " "), r.text[:40]
    assert pieces.encode(docs.where("false"), path).count() == 0


def test_units_end_where_no_piece_goes_on():
    """Fewer different units: a mark after a word, digits and capitals inside it do not make another one."""
    table = pieces.Pieces(queries.vocabulary("piece_bpe_32k.model"))
    texts = pa.array(["river, river. river7 river42", "river", None, "", "  a"])
    (n, units), = pieces._sliced_units(texts, table.touching())
    assert n == 5 and units.texts(np.arange(len(units.keys))).to_pylist()[:5] == ["▁river", ",", "▁river", ".", "▁river"]
    assert units.first.tolist() == [0, 9, 10, 10, 10, 11]
    assert len({t for t in units.texts(np.arange(len(units.keys))).to_pylist() if "r" in t}) == 1


def test_late_pieces_complete_better_ones(spark):
    """Where pieces are learnt out of order, a join can complete the parts of an edge passed by; the stepwise fold must see to it."""
    made = pieces.Pieces.__new__(pieces.Pieces)
    made.rows = [(t, i, float(r)) for i, (t, r) in enumerate([("a", 90), ("b", 91), ("c", 92), ("d", 93), ("abc", 1), ("bc", 5), ("ab", 7), ("cd", 3), ("abcd", 2), ("da", 2)])]
    made.texts, made.byte0, made.width = [t for t, _, _ in made.rows], 100, 4
    assert made.late() == {"ab", "bc", "cd"}
    rng = random.Random(4)
    units = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 14))) for _ in range(300)})
    rows = spark.createDataFrame([([0], k, t) for k, t in enumerate(units)], "buckets array<int>, key long, unit string")
    got = {r.key: list(r.ids) for r in pieces._lattice(rows, made).collect()}
    ranks, ids = {t: r for t, _, r in made.rows}, {t: i for t, i, _ in made.rows}
    assert all(got[k] == pieces.join_pairs(t, ranks, ids, made.byte0) for k, t in enumerate(units))


def test_texts_travel_compressed(spark):
    """A task's rows go to the buckets in turn, some megabytes together, in less than half their bytes; none is lost."""
    rng = random.Random(6)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    rows = [(i if i % 3 else None, " ".join(rng.choice(words) for _ in range(300)) if i % 7 else None) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    packed = docs.mapInArrow(pieces._packed(3), "bucket int, texts binary").toArrow()
    back = pa.Table.from_batches(pieces._unpacked(packed))
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(zip(back["doc_id"].to_pylist(), back["text"].to_pylist()), key=key) == sorted(rows, key=key)
    assert set(packed["bucket"].to_pylist()) == {0, 1, 2} and packed.num_rows < 20
    assert sum(len(x) for x in packed["texts"].to_pylist()) < 0.5 * sum(len(t or "") for _, t in rows)
