"""Toxicity by a factorization machine over hashed terms.

A document is the set of its lower-cased terms and of the first four and five bytes of longer ones, hashed to ``2**BITS`` buckets. The model is
``bias + sum w_i + 1/2 sum_f ((sum v_if)^2 - sum v_if^2)`` over the buckets present: the factor products give a
weight to pairs of terms, such as an insult with a mention of a group, that additive weights alone cannot have.

Fitting reads a bounded sample of labelled rows (``MAX_LABELLED``, the rows of smallest hashed id): bucket counts by class are made in
Spark, the ``MAX_TERMS`` buckets that tell the classes apart best stay, and numpy fits the machine on them. Scoring is one pass over every
text without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fluxloom.llm.words import PUNCTUATION, mix64, release, sliced_words, span_sums
from fluxloom.session import durable

BITS = 20
PREFIXES = (4, 5)
MAX_LABELLED = 20_000
MAX_TERMS = 4096
LEAST_Z = 4.0
FACTORS = 8
EPOCHS = 60
RATE = 0.2
FACTOR_RATE = 0.01
L2 = 1e-6


def term_buckets(words) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every term and prefix, not yet distinct."""
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    texts, keys = [text], [words.keys]
    for size in PREFIXES:
        long = np.flatnonzero(words.ends - words.starts > size)
        stem = span_sums(words.data.astype(np.uint64) + np.uint64(1), words.starts[long], words.starts[long] + size)
        texts.append(text[long])
        keys.append(mix64(stem + np.uint64(size)))
    key = np.concatenate(keys)
    return np.concatenate(texts), (key >> np.uint64(64 - BITS)).astype(np.int64)


def _features(selected: np.ndarray | None):
    """Distinct buckets of every text; with ``selected``, positions in it of those that are there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for a, b, words in sliced_words(batch.column(1), lower=True, gaps=PUNCTUATION):
                text, term = present(words, selected)
                offsets = np.searchsorted(text, np.arange(b - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(term.astype(np.int32)))], ["toxic", "terms"])

    return run


def present(words, selected: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (text, term) pairs."""
    text, term = term_buckets(words)
    if selected is not None:
        place = np.full(1 << BITS, -1, dtype=np.int32)
        place[selected] = np.arange(len(selected), dtype=np.int32)
        term = place[term]
        text, term = text[term >= 0], term[term >= 0].astype(np.int64)
    pair = np.unique((text << BITS) | term)
    return pair >> BITS, pair & ((1 << BITS) - 1)


@dataclass
class FactorizationMachine:
    """bias, weights and factors of the selected buckets; without two classes to learn from, a constant."""

    selected: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, text: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        out = np.bincount(text, self.weights[term], minlength=n)[:n] + self.bias
        for f in range(self.factors.shape[1]):
            v = self.factors[term, f]
            out += 0.5 * (np.bincount(text, v, minlength=n)[:n] ** 2 - np.bincount(text, v * v, minlength=n)[:n])
        return out

    def scores(self, text: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(text, term, n), -500, 500)))


def fit_machine(selected: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> FactorizationMachine:
    """Adaptive gradient descent on the logistic loss, in mini-batches."""
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0) or not len(selected):
        bias = np.log(share / (1 - share)) if 0 < share < 1 else (500.0 if share else -500.0)
        return FactorizationMachine(selected, float(bias), np.zeros(len(selected)), np.zeros((len(selected), FACTORS)))
    rng = np.random.default_rng(seed)
    model = FactorizationMachine(selected, float(np.log(share / (1 - share))), np.zeros(len(selected)), rng.normal(0, 0.01, (len(selected), FACTORS)))
    gw, gv, gb = np.full(len(selected), 1e-3), np.full(model.factors.shape, 1e-3), 1e-3
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 256):
            pick = order[at : at + 256]
            size = np.array([len(rows[i]) for i in pick])
            text = np.repeat(np.arange(len(pick)), size)
            term = np.concatenate([rows[i] for i in pick]).astype(np.int64)
            error = (model.scores(text, term, len(pick)) - labels[pick]) / len(pick)
            sums = np.stack([np.bincount(text, model.factors[term, f], minlength=len(pick)) for f in range(FACTORS)], axis=1)
            seen, place = np.unique(term, return_inverse=True)
            dw = np.bincount(place, error[text], minlength=len(seen)) + L2 * model.weights[seen]
            slope = error[text][:, None] * (sums[text] - model.factors[term])
            dv = np.stack([np.bincount(place, slope[:, f], minlength=len(seen)) for f in range(FACTORS)], axis=1) + L2 * model.factors[seen]
            gw[seen] += dw * dw
            gv[seen] += dv * dv
            gb += error.sum() ** 2
            model.weights[seen] -= RATE * dw / np.sqrt(gw[seen])
            model.factors[seen] -= FACTOR_RATE * dv / np.sqrt(gv[seen])
            model.bias -= RATE * error.sum() / gb**0.5
    return model


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2):
    """True where crc32 of the id as text falls in the part kept from learning; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> FactorizationMachine:
    """Learns from ``labels`` (id, 0/1), of which the ``max_labelled`` ids of smallest hash are read.

    Rows with a null id or label are left out; an id labelled twice counts as toxic if one label says so.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    sample = durable(known.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "_id").select("toxic", "text")
    seen = durable(rows.mapInArrow(_features(None), "toxic int, terms array<int>"))
    total = seen.agg(F.sum("toxic"), F.count("*")).first()
    yes, no = int(total[0] or 0), int(total[1]) - int(total[0] or 0)
    counts = seen.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("toxic").alias("y"), F.count("*").alias("n"))
    p, q, r = F.col("y") / F.lit(max(yes, 1)), (F.col("n") - F.col("y")) / F.lit(max(no, 1)), F.col("n") / F.lit(max(yes + no, 1))
    z = F.abs(p - q) / F.sqrt(r * (1 - r) * (1 / max(yes, 1) + 1 / max(no, 1)) + 1e-12)
    best = counts.select("term", z.alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "term").limit(MAX_TERMS).collect()
    selected = np.array(sorted(r["term"] for r in best), dtype=np.int64)
    found = rows.mapInArrow(_features(selected), "toxic int, terms array<int>").toArrow()
    terms = found.column("terms").combine_chunks()
    terms = terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms
    flat, offsets = terms.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False))])
    split = [flat[offsets[i] : offsets[i + 1]] for i in range(len(terms))]
    return fit_machine(selected, split, found.column("toxic").to_numpy().astype(np.float64))


def _score(model: FactorizationMachine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for a, b, words in sliced_words(batch.column(0), lower=True, gaps=PUNCTUATION):
                text, term = present(words, model.selected)
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in range(1, batch.num_columns)], pa.array(model.scores(text, term, b - a))], [*batch.schema.names[1:], "score"])

    return run


def score(docs: DataFrame, model: FactorizationMachine, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` in 0..1 (replacing a column of that name); empty and null texts get the bias's score."""
    kept = [c for c in docs.columns if c != "score"]
    given = "_scored"
    while given in kept:
        given += "_"
    rows = docs.select(F.col(text_col).cast("string").alias(given), *kept)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(_score(model), f"{kinds}, score double")
