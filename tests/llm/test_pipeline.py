"""The pipeline against brute force of every stage, and columns whose names clash."""

import re
import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from fluxloom.llm import packing, queries, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def leaders(texts):
    """Ids that stay of groups of near copies: five words, similarity of 0.8 or more."""
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    home = {i: i for i in sets}

    def root(i):
        while home[i] != i:
            i = home[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                p, q = sorted((root(i), root(j)))
                home[q] = p
    return {i for i in ids if root(i) == i}


def cut(texts):
    """Texts without words in 50-word windows that start in an earlier document; texts of which nothing is left go."""
    first, out = {}, {}
    words = {i: WORD.findall(t) for i, t in texts.items()}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        if not gone:
            out[i] = texts[i]
        elif len(gone) < len(w):
            out[i] = " ".join(x for k, x in enumerate(w) if k not in gone)
    return out


def test_pipeline_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{data}/labels.parquet"))
    clean = toxicity.score(docs, model).where(F.col("score") < corpus_pipeline.TOXIC_AT).select("doc_id", "text").collect()
    texts = {r.doc_id: r.text or "" for r in clean}
    assert 0 < len(texts) < docs.count()
    stay = leaders(texts)
    assert len(stay) < len(texts)
    texts = cut({i: t for i, t in texts.items() if i in stay})
    library = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    want = []
    for i, t in texts.items():
        ids = np.array(library.encode(t, add_special_tokens=False).ids + [0], dtype="<u4")
        want += [(i, p, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for p, s in enumerate(range(0, len(ids), 2048))]
    got = corpus_pipeline.run(spark, data).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048


def test_clashing_columns_survive(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6), (2, None, 7, 8)], "doc_id long, text string, _scored int, _row int")
    model = toxicity.FactorizationMachine(np.zeros(0, np.int64), 0.0, np.zeros(0), np.zeros((0, 8)))
    assert toxicity.score(docs, model).where("score = 0.5 and _scored is not null").count() == 2
    sized = docs.select("_row", F.lit(3).alias("length"))
    assert sorted(r._row for r in packing.pack(sized).collect()) == [6, 8]
