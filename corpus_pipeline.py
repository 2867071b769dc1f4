"""Documents to packed training sequences: each stage's decisions take effect on all its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fluxloom.llm import minhash, packing, rlz, toxicity
from fluxloom.llm.queries import vocabulary
from fluxloom.session import durable

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


TOXIC_AT = 0.3
BATCH_BYTES = 4 << 20  # texts go to Python in batches of so many bytes, however long they are


def bounded_batches(spark: SparkSession) -> None:
    """The job's session hands texts over in small batches: buffers beside the heap stay small."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine, learnt from the labels, scores at ``TOXIC_AT`` or more go."""
    bounded_batches(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs.withColumn("_all", F.struct(*docs.columns)).select("text", "_all"), model)
    return scored.where(F.col("score") < TOXIC_AT).select("_all.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id. Rows without an id stay."""
    bounded_batches(spark)
    gone = minhash.near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    if gone.count() <= minhash.BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs.doc_id == gone["_gone"], "left_anti")


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out; documents of which nothing is left go. Null texts and rows without an id stay as they are."""
    bounded_batches(spark)
    cut = rlz.without_duplicates(docs)
    length = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    whole = ~((F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_words")))
    return cut.where(whole).withColumn("n_chars", length).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts placed in training sequences of at most ``packing.LENGTH`` ids. A null text is its end id alone; null ids stay null."""
    bounded_batches(spark)
    return packing.pack(packing.pieces(docs, vocabulary("word_bpe_49k.json")))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
