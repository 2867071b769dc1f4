"""Session helpers: defaults for stand-alone use and durable lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "fluxloom", cores: str = "*", memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for lineage cuts and staged tables.

    Taken from ``spark.checkpoint.dir``. Only a local master may fall back to a
    folder of this machine: on a cluster the executors could not see it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="fluxloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def staging_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through a table in the shared folder, so a lost executor costs one read.

    Range partitioning samples its input; two consumers of one range-partitioned frame may only
    share row positions once these are written down. A columnar table lets each consumer read
    just its columns, and its known size lets the planner pick join sides.
    """
    path = staging_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Cuts:
    """Lineage cuts of one operator; see ``scratch``."""

    def __init__(self):
        self._made: list[tuple[SparkSession, str]] = []

    def cut(self, df: DataFrame) -> DataFrame:
        """``durable``, for as long as the ``scratch`` block runs."""
        path = staging_path(df.sparkSession, "cut")
        self._made.append((df.sparkSession, path))
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        while self._made:
            drop_table(*self._made.pop())


@contextmanager
def scratch() -> Iterator[Cuts]:
    """A block whose cuts are deleted at its end. What leaves the block must be ``durable`` or read no cut."""
    cuts = Cuts()
    try:
        yield cuts
    finally:
        cuts.drop()
