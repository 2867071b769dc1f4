"""Line de-duplication over levelled sorted runs of line hashes, in DataFrame functions only.

A line's key is the line without white space (``0x20``, ``0x09``-``0x0D``) at both ends and with A-Z in lower case; two keys are
compared by their 64-bit hash. A line of a key found in at least ``min_docs`` documents is common, and common lines go from every document.

Runs. A run is a table of (key, docs, common), hashed into buckets by key and sorted in each, so the keys of two runs meet by a merge join
without a shuffle. A batch of documents is reduced to one row per key. Keys that a run already marks as common are anti-joined away: their
verdict stands and costs nothing more. The rest is merge-joined with the runs for the documents counted so far, marked as common where the
threshold is reached, and becomes a new run of level 0. When a level holds ``fanout`` runs they are compacted into one of the
next, so n batches leave about ``fanout`` * log(n) runs. A key is marked in one run only, for a batch never adds a marked key again.

Rows. Each row is a document, also where its id is null or repeated or the whole row is repeated. Null and empty texts are one empty line. A line
without a character but white space has no key and stays. An empty table gives an empty one.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fluxloom.session import drop_table, durable, scratch, staging_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"

BATCHES = 8  # slices that a whole table is taken in
FANOUT = 4
DOCS_PER_BUCKET = 25_000  # a run has a bucket per so many documents, up to the session's shuffle partitions
BROADCAST_KEYS = 500_000  # common keys: up to so many (8 MB) go to every executor, more are joined by salted key
SALTS = 32


def line_key(line: Column) -> Column:
    """The text that makes two lines the same."""
    return F.btrim(F.translate(line, UPPER, LOWER), F.lit(BLANKS))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def document_counts(docs: DataFrame, *by: Column) -> DataFrame:
    """(key, docs): in how many documents each key is found, per ``by``."""
    keys = F.filter(F.transform(_lines(F.col("text")), line_key), lambda k: k != "")
    hashed = docs.select(*by, F.explode(F.array_distinct(F.transform(keys, lambda k: F.xxhash64(k)))).alias("key"))
    return hashed.groupBy(*[c for c in hashed.columns]).agg(F.count(F.lit(1)).alias("docs"))


class LineRuns:
    """Runs of line keys over batches of documents; ``drop`` deletes them."""

    def __init__(self, spark: SparkSession, buckets: int, min_docs: int, fanout: int = FANOUT):
        self.spark, self.buckets, self.min_docs, self.fanout = spark, buckets, min_docs, fanout
        self.levels: list[list[tuple[str, str]]] = []

    def _write(self, rows: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(sorted_table(rows.select("key", "docs", "common"), self.buckets))

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name, _ in level]

    def _plain(self, paths: list[str]) -> DataFrame:
        """Rows of some runs, which may be empty."""
        return self.spark.read.schema("key long, docs long, common boolean").parquet(*paths)

    def add(self, counts: DataFrame) -> None:
        """Takes a batch in, given its (key, docs)."""
        runs, new = self.runs(), counts.select("key", F.col("docs").alias("docs"))
        for run in runs:
            new = new.join(run.where("common").select("key").hint("merge"), "key", "left_anti")
        seen = F.col("docs")
        for i, run in enumerate(runs):
            new = new.join(run.select("key", F.col("docs").alias(f"_{i}")).hint("merge"), "key", "left")
            seen = seen + F.coalesce(F.col(f"_{i}"), F.lit(0))
        self._write(new.withColumn("common", seen >= self.min_docs), 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            self._compact(level)
            level += 1

    def _compact(self, level: int) -> None:
        """All runs of a level become one of the next."""
        old = self.levels[level]
        # Read as plain files: a union of bucketed scans would pass for bucketed and not be summed across runs.
        merged = self._plain([path for _, path in old]).groupBy("key").agg(F.sum("docs").alias("docs"), F.max("common").alias("common"))
        self._write(merged, level + 1)
        self.levels[level] = []
        for made in old:
            drop_sorted_table(self.spark, made)

    def common(self) -> DataFrame:
        """Keys found in at least ``min_docs`` documents of the batches so far."""
        return self._plain([path for level in self.levels for _, path in level]).where("common").select("key")

    def drop(self) -> None:
        for level in self.levels:
            for made in level:
                drop_sorted_table(self.spark, made)
        self.levels = []


def sorted_table(rows: DataFrame, buckets: int, by: str = "key", folders: tuple[str, ...] = ()) -> tuple[str, str]:
    """Writes rows in buckets of ``by``, sorted in each, to the shared folder: (table name, path)."""
    name, path = f"run_{uuid.uuid4().hex}", staging_path(rows.sparkSession, "run")
    writer = rows.repartition(buckets, by).sortWithinPartitions(*folders, by).write.format("parquet").option("path", path)
    if folders:
        writer = writer.partitionBy(*folders)
    writer.bucketBy(buckets, by).sortBy(by).saveAsTable(name)
    return name, path


def drop_sorted_table(spark: SparkSession, made: tuple[str, str]) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {made[0]}")
    drop_table(spark, made[1])


def common_keys(docs: DataFrame, min_docs: int, batches: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Common keys of a whole table, taken in batch by batch. ``keep`` makes the result outlive the runs."""
    spark = docs.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, min(most, math.ceil(docs.count() / DOCS_PER_BUCKET)))
    batch = F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int").alias("batch")
    arrivals = sorted_table(document_counts(docs, batch), buckets, folders=("batch",))
    store = LineRuns(spark, buckets, min_docs)
    try:
        for i in range(batches):
            store.add(spark.table(arrivals[0]).where(F.col("batch") == i))
        return keep(store.common())
    finally:
        store.drop()
        drop_sorted_table(spark, arrivals)


def without_common_lines(docs: DataFrame, min_docs: int = 10, batches: int = BATCHES, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Documents without their common lines: every column as it was, ``text`` with the lines that stay, n_lines and n_dropped (long).

    Needs ``doc_id`` and ``text``; given columns called n_lines or n_dropped are replaced. See the module for null, empty and repeated rows.
    """
    given = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    with scratch() as cuts:
        common = common_keys(docs.select("doc_id", "text"), min_docs, batches, cuts.cut)
        row = F.struct(*[F.col(c) for c in given if c != "text"])
        # Equal rows share (k1, k2): their lines meet in one group, which counts the copies by its first lines.
        lines = docs.select(F.xxhash64(*given).alias("k1"), F.xxhash64(F.lit(1), *given).alias("k2"), row.alias("row"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
        lines = lines.withColumn("row", F.when(F.col("pos") == 0, F.col("row")))
        key = line_key(F.col("line"))
        lines = lines.withColumn("key", F.when(key != "", F.xxhash64(key)))
        if common.count() <= broadcast_keys:
            marked = lines.join(F.broadcast(common.withColumn("common", F.lit(True))), "key", "left")
        else:
            # One line may stand in a third of all documents: its rows are dealt by a second key.
            lines = lines.withColumn("salt", F.pmod(F.xxhash64("k1", "pos"), F.lit(SALTS)))
            salted = common.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))).withColumn("common", F.lit(True))
            marked = lines.join(salted, ["key", "salt"], "left")
        stays = F.col("common").isNull()
        found = marked.groupBy("k1", "k2").agg(
            F.count_if(F.col("pos") == 0).alias("copies"),
            F.count(F.lit(1)).alias("n"),
            F.count_if(~stays).alias("d"),
            F.sort_array(F.collect_list(F.when(stays, F.struct("pos", "line")))).alias("kept"),
            F.first("row", ignorenulls=True).alias("row"),
        )
        once = F.filter(F.col("kept"), lambda x, i: i % F.col("copies") == 0)
        text = F.array_join(F.transform(once, lambda x: x["line"]), "\n").alias("text")
        copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
        out = found.select((F.col("n") / F.col("copies")).cast("long").alias("n_lines"), (F.col("d") / F.col("copies")).cast("long").alias("n_dropped"), text, "row", copy.alias("copy"))
        columns = [F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in given]
        return durable(out.select(*columns, "n_lines", "n_dropped"))
