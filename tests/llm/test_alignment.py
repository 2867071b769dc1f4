"""Token alignment against byte-by-byte brute force over both libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fluxloom.llm import alignment, queries

PATHS = [queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")]


def texts():
    rng = random.Random(11)
    words = ["the", "and", "Straße", "日本語", "don't", "x" * 30, "1234", "<|endoftext|>", "<s>", "<0x41>", "🙂", "naïve", "  ", "\n\n", "\t", "été", "...", "ﬁ"]
    out = [None, "", " ", "a", "\x00\x01", "A▁B", "a" * 2000, "\r\n \x0b", "é" * 300, "é"]
    out += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    return out + ["".join(rng.choice(["ab", "the ", "ing ", "漢"]) for _ in range(6000))]


def tokens_of(side_a, side_b, text):
    a = side_a.encode(" " + text, add_special_tokens=False).ids
    b = side_b.encode(text)
    vocabulary = {i: t for t, i in side_a.get_vocab(with_added_tokens=False).items()}
    plain = alignment._byte_level()
    bytes_a = [bytes(plain[c] for c in vocabulary[i]) for i in a]
    bytes_b = [bytes([int(side_b.id_to_piece(i)[3:5], 16)]) if side_b.is_byte(i) else side_b.id_to_piece(i).replace("▁", " ").encode() for i in b]
    raw = b" " + text.encode()
    return (a, b, bytes_a, bytes_b) if b"".join(bytes_a) == raw == b"".join(bytes_b) else ([], [], [], [])


def brute(rows):
    a_coder, b_coder = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a_coder.encode_special_tokens = True
    links, partial = [], []
    for i, text in rows:
        a, b, bytes_a, bytes_b = tokens_of(a_coder, b_coder, text) if text else ([], [], [], [])
        spans = []
        for tokens in (bytes_a, bytes_b):
            at, own = 0, []
            for t in tokens:
                own.append((at, at + len(t)))
                at += len(t)
            spans.append(own)
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, begin = [], 0
        for end in cuts:
            side = ["".join(f"{t}," for t, (s, e) in zip(ids, own) if begin <= s and e <= end)[:-1] for ids, own in ((a, spans[0]), (b, spans[1]))]
            groups.append("|".join(side))
            begin = end
        own, j0 = [], 0
        for (s, e), x in zip(spans[0], a):
            while spans[1][j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(b) and spans[1][j][0] < e:
                own.append((x, b[j]))
                j += 1
        links.append(own)
        partial.append((i, len(a), len(b), len(cuts), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    docs = Counter(p for own in links for p in set(own))
    top = {}
    for (x, _), n in docs.items():
        top[x] = max(n, top.get(x, 0))
    return [(*p[:5], sum(docs[q] == top[q[0]] for q in own), sum(docs[q] for q in own), p[5]) for p, own in zip(partial, links)], docs


@pytest.fixture(scope="module")
def rows():
    given = list(enumerate(texts()))
    return given + [(None, given[20][1]), (5, given[21][1]), (5, given[21][1])]


json_sides = lambda paths=tuple(PATHS): (alignment.byte_side(paths[0]), alignment.piece_side(paths[1]))


@pytest.mark.parametrize("sides,slice_chars", [(queries._tokenizers, 1 << 20), (json_sides, 300)])
def test_against_brute_force(spark, rows, sides, slice_chars):
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, block int, pair string, n_a int").repartition(3)
    found, pairs = alignment.aligned(docs, sides, slice_chars)
    want, counts = brute(rows)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(want, key=str)
    assert {(r.a, r.b): r.docs for r in pairs.collect()} == dict(counts)


def test_lanes_change_nothing(rows, monkeypatch):
    given = [t for _, t in rows]
    one = alignment.align(given, *queries._tokenizers())
    monkeypatch.setattr(alignment, "LANE", 4)
    two = alignment.align(given, *queries._tokenizers())
    assert all(np.array_equal(one[k], two[k]) for k in one)


def test_long_texts_start_several_lanes():
    ends = np.arange(1, 5001) * 3
    first = np.array([0, 5000])
    a, b = alignment._lanes(ends, ends, first, first)
    assert len(a) > 4 and np.array_equal(a, b)
    link_a, link_b, cut = alignment.lockstep(ends, ends, first, first)
    assert np.array_equal(link_a, np.arange(5000)) and np.array_equal(link_b, link_a) and cut.all()


def test_empty_table(spark):
    found, pairs = alignment.aligned(spark.createDataFrame([], "doc_id long, text string"), queries._tokenizers)
    assert found.collect() == [] and pairs.collect() == []
