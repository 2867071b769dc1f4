"""Periodic runs against every period tried at every place."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from fluxloom.llm import queries, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w):
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)  # the smallest period of a stretch comes first
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def texts(seed, n):
    rng = random.Random(seed)
    out = [None, "", " \n\t", "a", "a " * 5, "a " * 6, "b " + "a " * 40 + "c", "é ñ " * 9 + "é", "a b a b a b a b a a b " * 5, "x\x0by\x0cz " * 7]
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 6)):
            unit = [rng.choice("abcd") for _ in range(rng.randint(1, 6))]
            parts += (unit * rng.randint(1, 9))[: rng.randint(1, 40)]
            parts += [rng.choice("abcd") for _ in range(rng.randint(0, 3))]
        out.append(" ".join(parts))
    return out + ["".join(rng.choice("ab ") for _ in range(3000)), "ha " * 3000 + "end " + "ha " * 3000]


def summary(i, w, found):
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    kept = " ".join(x for k, x in enumerate(w) if k not in gone)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    facts = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(found), *facts, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("large", [4096, 4])
def test_runs_against_brute_force(monkeypatch, large):
    monkeypatch.setattr(runs, "LARGE", large)
    given = texts(1, 300)
    got = runs.runs_of_texts(given)
    for t, (found, collapsed) in zip(given, got):
        w = WORD.findall(t or "")
        if len(w) < 4000:
            assert found == brute(w), t
            gone = {k for s, length, q in found for k in range(s + q, s + length)}
            assert collapsed == " ".join(x for k, x in enumerate(w) if k not in gone)
    assert got[-1][0] == [(0, 3000, 1), (3001, 3000, 1)] and got[-1][1] == "ha end ha"


def test_texts_alone_in_a_slice():
    for t in texts(4, 80):
        w = WORD.findall(t or "")
        if len(w) < 4000:
            assert runs.runs_of_texts([t])[0][0] == brute(w), t


def test_depths_are_exact():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 2, 400)
    order, depth = runs.suffix_order(words)
    assert len(set(order.tolist())) == len(order)
    for a, b, d in zip(order[:-1], order[1:], depth[1:]):
        n = 0
        while max(a, b) + n < len(words) and words[a + n] == words[b + n]:
            n += 1
        assert d == (n if n >= 4 else 0)


def test_a_very_long_text_of_one_word_stays_fast():
    found, collapsed = runs.runs_of_texts(["no " * 300_000])[0]
    assert found == [(0, 300_000, 1)] and collapsed == "no"


def test_query_and_edge_cases(spark, tmp_path):
    rows = [(i, t, 9) for i, t in enumerate(texts(2, 60))] + [(None, "a " * 8, 1), (3, "a " * 8, 1), (3, "a " * 8, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs int").repartition(3)
    out = runs.with_runs(docs, slice_chars=500)
    assert out.columns == ["doc_id", "text", "n_runs", "runs", "collapsed"] and out.count() == len(rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, t, _ in rows:
        w, h = WORD.findall(t or ""), None if i is None else zlib.crc32(str(i).encode())
        if w and h is not None and h % 10 == 0:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        want.append(summary(i, w, brute(w) if len(w) < 4000 else [tuple(r) for r in runs.runs_of_texts([" ".join(w)])[0][0]]))
    got = [tuple(r) for r in queries.op12_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(r[1] > 0 for r in got) > 40


def test_empty_table(spark):
    assert runs.with_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
