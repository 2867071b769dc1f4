"""Corpus operators on small tables, against brute force, the libraries and edge cases."""

import hashlib
import random
import tracemalloc
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxloom.llm import ann, attention_lm, hnsw, html_text, licenses, minhash, packing, pieces, queries, rlz, toxicity
from fluxloom.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, bands int, rep string, spans int, score string, n_words int"


def corpus(seed=1, n=60):
    """Passages that repeat, near copies, exact copies, null, empty and very short texts, repeated ids, a long text."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(1, 150))]
        if i % 3 == 0:
            at, cut = rng.randint(0, len(text)), rng.randint(0, 60)
            text[at:at] = passage[cut : cut + rng.randint(40, 60)]
        if i % 7 == 0 and rows:
            text = WORD.findall(rows[rng.randrange(len(rows))][1] or "a b")
            if i % 2 and len(text) > 4:
                text[rng.randrange(len(text))] = "Changed"
        rows.append((i, " ".join(text)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "one"), (n + 4, "ONE"), (None, rows[0][1]), (3, rows[3][1]), (n + 5, "é ñ ß 漢字 " * 3000)]
    return [(i, t, 1, "x", 2, "y", 3) for i, t in rows]


def as_docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_rlz_against_brute_force(spark):
    rows = corpus()
    first, texts = {}, [(i, WORD.findall(t or "")) for i, t, *_ in rows]
    for i, w in texts:
        for s in range(len(w) - 49 if i is not None else 0):
            key = tuple(w[s : s + 50])
            first[key] = min(i, first.get(key, i))
    want = []
    for i, w in texts:
        gone = set()
        for s in range(len(w) - 49 if i is not None else 0):
            if first[tuple(w[s : s + 50])] < i:
                gone |= set(range(s, s + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(r) for r in rlz.substring_dedup(as_docs(spark, rows)).collect()]
    order = lambda r: (r[0] is None, r)
    assert sorted(got, key=str) == sorted(want, key=str) and any(r[2] for r in want) and order
    cut = rlz.without_duplicates(as_docs(spark, rows))
    assert cut.columns[: len(SCHEMA.split(","))] == [c.split()[0] for c in SCHEMA.split(", ")] and cut.count() == len(rows)


@pytest.mark.parametrize("shingle", [4, 5])
def test_minhash_against_brute_force(spark, shingle):
    rows = corpus(2)
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    sets = []
    for i, t, *_ in rows:
        w = WORD.findall(low(t))
        sets.append((i, {tuple(w[s : s + shingle]) for s in range(len(w) - shingle + 1)} if len(w) >= shingle else ({tuple(w)} if w else set())))
    comp = {i: i for i, _ in sets if i is not None}
    for _ in range(len(comp)):
        for i, x in sets:
            for j, y in sets:
                if None not in (i, j) and x and 100 * len(x & y) >= 80 * len(x | y):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    want = sorted(((i, len(x), comp.get(i), i is None or comp[i] == i) for i, x in sets), key=str)
    got = sorted((tuple(r) for r in minhash.near_duplicates(as_docs(spark, rows), shingle=shingle).collect()), key=str)
    assert got == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path, rows = queries.vocabulary("word_bpe_49k.json"), corpus(3)
    library = Tokenizer.from_file(path)
    out = packing.pack(packing.pieces(as_docs(spark, rows), path, length=64), length=64, bins_per_group=20).collect()
    want = []
    for i, t, *_ in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        want += [(i, p, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())) for p, s in enumerate(range(0, len(ids), 64))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=str) == sorted(want, key=str)
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    assert len(bins) <= 1.05 * sum(r.length for r in out) / 64 + 1


def test_words_with_the_mark_and_specials(spark):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    texts = ["10 0 a0b x", "it's <|endoftext|> 0", "Ünïcode words ​", "0" * 50, "é ́x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: list(np.frombuffer(r.ids, "<u4")) for r in packing.pieces(docs, path, with_ids=True).collect()}
    assert got == {i: Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}


def test_toxicity_learns_pairs_and_edges(spark):
    rng = np.random.default_rng(0)
    pick = rng.integers(0, 2, (400, 2))
    rows = [np.flatnonzero(p) for p in pick]
    labels = (pick.sum(axis=1) == 2).astype(float)
    model = toxicity.fit_machine(np.arange(2), rows, labels)
    text = np.repeat(np.arange(400), [len(r) for r in rows])
    assert ((model.scores(text, np.concatenate(rows), 400) >= 0.5) == (labels == 1)).all()
    docs = as_docs(spark, corpus(4))
    marked = docs.select("doc_id", F.concat_ws(" ", "text", F.when(F.col("doc_id") % 3 == 0, F.lit("Idiot!"))).alias("text"))
    labels = marked.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    out = toxicity.score(marked, toxicity.fit(marked, labels)).collect()
    assert len(out) == docs.count() and all((r.score >= 0.5) == (r.doc_id % 3 == 0) for r in out if r.doc_id is not None and r.text)
    assert toxicity.fit(marked, labels.limit(0)).bias < 0


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16))
    x[200:] = x[:100] + rng.normal(size=(100, 16)) * 0.1
    x[290:] = x[0]
    rows = [(i, v.tolist(), int(i % 2), 9) for i, v in enumerate(x)]
    rows += [(300, None, 1, 9), (301, [0.0] * 16, 1, 9), (302, [float("nan")] * 16, 0, 9), (303, [1.0, None], 0, 9), (304, x[1].tolist(), None, 9), (None, x[2].tolist(), 0, 9)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rep int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (np.arange(300)[:, None] % 2 == np.arange(300) % 2)
    np.fill_diagonal(near, False)
    comp = np.arange(306)
    for _ in range(20):
        for i in range(300):
            comp[i] = min(comp[i], *comp[np.flatnonzero(near[i])], comp[i])
    want = {i: (int(near[i].sum()) if i < 300 else 0, int(comp[i]) if i < 300 else i) for i in range(305)}
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.near_duplicates(table, shard_rows=60).collect()}
    assert got.pop(None) == (0, None) and got == want
    every = np.vstack([x, x[1:2]])
    ids = np.append(np.arange(300), 304)
    found = ann.nearest_neighbours(table, F.col("vec_id") % 50 == 0, lists=4).orderBy("query_id", "rank").collect()
    hit = 0
    for q in range(0, 300, 50):
        d = np.sqrt(((every - x[q]) ** 2).sum(axis=1))
        best = [int(ids[j]) for j in np.lexsort((ids, d)) if ids[j] != q][:10]
        hit += len(set(best) & {r.vec_id for r in found if r.query_id == q})
    assert hit >= 0.9 * 60
    dealt = ann.nearest_neighbours(table, F.col("vec_id") % 50 == 0, lists=4, query_rows=2).orderBy("query_id", "rank").collect()
    assert dealt == found
    assert ann.nearest_neighbours(table.limit(0), F.lit(True)).count() == 0 and hnsw.near_duplicates(table.limit(0)).count() == 0


def test_html(spark):
    page = """<html><head><title>t</title><script>var a="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li>Home</ul></nav>
    <div class="cookie-notice">We use cookies.</div><article><header><h1>Title &amp; more</h1></header><p><b>First   line.<br><p>Second, line &lt;here&gt;.</p>
    <aside>Read on</aside><form><p>Name</p></form><p>Ok.</p><section id="comments"><p>Nice one, really nice, I think so too!</p></section></article>
    <div class="sidebar"><p>Other, texts.</p></div><footer>&copy; x</footer></body></html>"""
    assert html_text.main_text(page) == "Title & more\n\nFirst line.\n\nSecond, line <here>.\n\nOk."
    table = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p"), (None, "u", "<nav>x</nav>")], "page_id long, url string, html string")
    got = {r.page_id: (r.n_chars > 0) for r in html_text.extract(table).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, None: False}


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT"].split()
    texts = ["a b " + " ".join(mit).upper() + " c", "x Licensed under CC BY-NC 4.0. y", " ".join(mit[:20]), None, "", " ".join(w for k, w in enumerate(mit) if k % 9)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.license): (r.coverage, r.start_word) for r in licenses.license_spans(docs).collect()}
    assert set(got) == {(0, "MIT"), (1, "CC-BY-NC-4.0-notice"), (5, "MIT")} and got[0, "MIT"] == (1.0, 2) and got[1, "CC-BY-NC-4.0-notice"] == (1.0, 1)


def test_pieces_equal_the_library(spark):
    from sentencepiece import SentencePieceProcessor

    path, rows = queries.vocabulary("piece_bpe_32k.model"), corpus(5)[:20]
    rows = [(i, t) for i, t, *_ in rows] + [(90, "Hello  world, naïve 漢字 \n\t x" + "y" * 70), (91, None), (92, ""), (None, "a  ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    library = SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r for r in pieces.decode(pieces.encode(docs, path), path).collect()}
    for i, t in rows:
        assert list(got[i].ids) == library.encode(t or "") and got[i].decoded == (t or "")


def test_attention_scores(spark):
    docs = as_docs(spark, corpus(6))
    out = attention_lm.score(docs, F.col("doc_id") % 5 != 1, queries.vocabulary("word_bpe_49k.json")).collect()
    counts, rows = {}, [(r.doc_id, [w.lower() for w in WORD.findall(r.text or "")] + [None]) for r in docs.collect()]
    for i, w in rows:
        if i is not None and i % 5 != 1:
            for x in w:
                counts[x] = counts.get(x, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), len(w), sum(x in counts for x in w), round(sum(np.log10((counts.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w), 5)) for i, w in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 5)) for r in out) == want
    assert all(r.train_tokens == n and np.isfinite(r.score) and r.score < 0 for r in out)


def test_attention_learns_from_texts_outside_the_sample(spark, monkeypatch):
    monkeypatch.setattr(attention_lm, "SAMPLE", 3)
    rng = random.Random(7)
    topics = ["river stone water bridge boat fish".split(), "tax court judge law paper vote".split(), "engine wheel motor brake gear road".split()]
    rows = [(i, " ".join(rng.choice(topics[i % 3]) for _ in range(60))) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sampled = [r.doc_id for r in docs.orderBy(F.xxhash64("doc_id"), "doc_id").limit(3).collect()]
    docs = docs.where((F.col("doc_id") % 3 != 2) | ~F.col("doc_id").isin(sampled))
    path, kept = queries.vocabulary("word_bpe_49k.json"), {}
    averaged = attention_lm._averaged
    monkeypatch.setattr(attention_lm, "_averaged", lambda model, learned: kept.setdefault("after", averaged(kept.setdefault("before", model), learned)))
    counts = docs.select("text").mapInArrow(attention_lm._counted(path), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).cache()
    model = attention_lm.fit(docs, counts, path)
    ids = [packing.WordEncoder.of(path).tokenizer.encode(w).ids[0] for t in topics for w in t]
    assert len(set(model.class_of[ids])) > 1 and attention_lm.CLASSES - 2 not in model.class_of[ids]
    moved = np.abs(kept["after"].embed - kept["before"].embed).sum(axis=1) > 0
    assert moved[ids].all() and np.isfinite(model.embed).all() and 0.5 <= model.mixed <= 0.999


def test_attention_weights_start_in_a_task(spark, monkeypatch):
    """The driver reads no text: it has no tokenizer here."""
    rng = random.Random(9)
    rows = [(rng.randrange(200) if i % 9 else None, " ".join(rng.choice("river stone water bridge boat fish court tax".split()) for _ in range(20))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    path = queries.vocabulary("word_bpe_49k.json")
    hashed = lambda r: (r.h, -1 if r.doc_id is None else r.doc_id)
    want = sorted(docs.withColumn("h", F.xxhash64("doc_id")).collect(), key=hashed)[:50]
    got = [r.text for r in attention_lm._sample(docs, 50).collect()]
    texts = {}
    for i, t in rows:
        texts.setdefault(i, set()).add(t)
    assert len(got) == 50 and all(t in texts[r.doc_id] for t, r in zip(got, want))
    counts = docs.select("text").mapInArrow(attention_lm._counted(path), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).cache()

    def none(_):
        raise AssertionError("a tokenizer on the driver")

    monkeypatch.setattr(attention_lm.WordEncoder, "of", none)
    model = attention_lm.fit(docs, counts, path)
    assert np.isfinite(model.embed).all() and 0.5 <= model.mixed <= 0.999
    assert attention_lm.fit(docs.where("false"), counts.where("false"), path).embed.any()


def test_a_step_makes_no_table_of_the_vocabulary():
    """What a step needs beside the weights grows with its windows alone."""
    rng = np.random.default_rng(3)
    size, none = 200_000, np.zeros(0)
    model = attention_lm.Attention(**attention_lm._drawn(size, np.zeros(attention_lm.CLASSES, np.float32), rng), class_of=none, share=none, lexicon=none, lexicon_count=none, begins=none, mixed=0.9)
    given, target, weight = rng.integers(0, size, (2, attention_lm.WINDOW)), rng.integers(0, attention_lm.CLASSES, (2, attention_lm.WINDOW)), np.ones((2, attention_lm.WINDOW), np.float32)
    squares = {}
    model.step(given, target, weight, squares)
    tracemalloc.start()
    model.step(given, target, weight, squares)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2_000_000


def test_nearest_among_many_exact_copies(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3600, 48))
    x[rng.permutation(3600)[:3000]] = x[0]
    same = np.flatnonzero((x == x[0]).all(axis=1))
    table = spark.createDataFrame([(int(i), x[i].tolist()) for i in rng.permutation(3600)], "vec_id long, embedding array<double>").repartition(5)
    asked = [int(i) for i in (same[0], same[1500], same[-1])]
    found = ann.nearest_neighbours(table, F.col("vec_id").isin(asked), lists=4).collect()
    for q in asked:
        got = [(r.vec_id, r.score) for r in sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])]
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        assert got == [(int(i), 0.0) for i in np.lexsort((np.arange(3600), d)) if i != q][:10]


def test_whole_license_texts(spark):
    whole = licenses.TEMPLATES
    count = lambda t: len(re.findall(r"[A-Za-z0-9]+", t))
    names = ["MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-3.0", "LGPL-2.1", "CC-BY-SA-4.0"]
    owners = lambda t: t.replace("COPYRIGHT HOLDERS", "REGENTS OF THE UNIVERSITY AND MANY OTHERS")
    texts = [f"Copyright (c) 2020 Someone. {whole[n]} The end." for n in names] + [owners(whole["BSD-2-Clause"]), whole["MIT"][: len(whole["MIT"]) // 2], whole["GPL-2.0"] + "\n\n" + whole["MIT"]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.license): r for r in licenses.license_spans(docs).collect() if r.license in licenses.TEXTS}
    assert set(got) == {(i, n) for i, n in enumerate(names)} | {(7, "BSD-2-Clause"), (9, "GPL-2.0"), (9, "MIT")}
    for i, n in enumerate(names):
        r = got[i, n]
        assert (r.coverage, r.start_word, r.end_word - r.start_word) == (1.0, 4, r.n_template) and (r.n_template == count(whole[n]) or not whole[n].isascii())
    assert got[9, "MIT"].coverage == 1.0 and got[9, "MIT"].start_word == got[9, "GPL-2.0"].end_word


@pytest.mark.parametrize("mark", ['div class="container has-sidebar"', 'div class="no-ads"', 'div class="with-banner"', 'div id="legal-news"', "form"])
@pytest.mark.parametrize("inner", ["article", "div"])
def test_html_labels_around_the_article(mark, inner):
    text = ["The first paragraph, which is long enough.", "The second one, with more words, ends here."] * 4
    body = "".join(f"<p>{t}</p>" for t in text)
    aside = '<div class="sidebar"><p>Read this, too.</p></div><form><p>Your name, please.</p></form><section id="comments"><article><p>Nice, really.</p></article></section>'
    page = f'<html><body><nav>Home</nav><{mark}><{inner}>{body}</{inner}>{aside}</{mark.split()[0]}><footer>x</footer></body></html>'
    assert html_text.main_text(page) == "\n\n".join(text)


def test_html_long_comments_beside_the_article():
    comment = "<p>I have read this, and I do not agree, not at all.</p>" * 20
    page = f'<body><article><p>A short text, but it is the article.</p><p>It ends here, after two lines.</p><section id="comments">{comment}</section></article></body>'
    assert html_text.main_text(page) == "A short text, but it is the article.\n\nIt ends here, after two lines."
