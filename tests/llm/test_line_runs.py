"""Levelled line runs against brute force, in both join plans, and batch by batch."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fluxloom.llm import line_runs

BLANKS = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, n_lines int, row string, key string"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def corpus():
    rng = random.Random(5)
    shared = [f"Shared line {i} É" for i in range(6)]
    rows = []
    for i in range(80):
        lines = [f"own {i} {k}" for k in range(rng.randint(0, 4))]
        for k, line in enumerate(shared):
            if rng.random() < (k + 1) / 8:
                lines.insert(rng.randint(0, len(lines)), rng.choice([line, " " + line.upper() + "\t\x0b", line + "\r"]))
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n \n\t"), (None, shared[0] + "\nleft"), (7, rows[7][1]), (7, rows[7][1]), (7, "other\n" + shared[5])]
    rows += [(200 + i, "twice\nTWICE\n" + "x" * i) for i in range(5)]
    rows.append((300, "\n".join([shared[5]] * 3000 + ["long " + str(i) for i in range(3000)])))
    return [(i, t, 5, "r", "k") for i, t in rows]


def expected(rows, least):
    docs = Counter(k for _, t, *_ in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t, _, r, k in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if docs[key(x)] < least or not key(x)]
        out.append((i, "\n".join(kept), r, k, len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast_keys,least", [(1000, 10), (0, 10), (1000, 2)])
def test_against_brute_force(spark, broadcast_keys, least):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = line_runs.without_common_lines(docs, least, batches=6, broadcast_keys=broadcast_keys)
    assert out.columns == ["doc_id", "text", "row", "key", "n_lines", "n_dropped"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == expected(rows, least)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert line_runs.without_common_lines(docs).collect() == []


def test_runs_are_levelled_and_merged_without_a_shuffle(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    store = line_runs.LineRuns(spark, buckets=4, min_docs=10, fanout=3)
    try:
        for i in range(10):
            store.add(line_runs.document_counts(docs.where(F.pmod(F.col("doc_id"), F.lit(10)) == i)).select("key", "docs"))
            assert all(len(level) < 3 for level in store.levels)
        assert [len(level) for level in store.levels] == [1, 0, 1]
        with_id = [r for r in rows if r[0] is not None]
        docs_of = Counter(k for _, t, *_ in with_id for k in {key(x) for x in (t or "").split("\n")} if k)
        common = [r.key for r in store.common().collect()]
        want = spark.createDataFrame([(k,) for k, n in docs_of.items() if n >= 10], "k string").select(F.xxhash64("k"))
        assert sorted(common) == sorted(r[0] for r in want.collect())
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        run = store.runs()[0]
        plan = run.join(store.runs()[1].where("common").select("key").hint("merge"), "key", "left_anti")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        store.drop()
