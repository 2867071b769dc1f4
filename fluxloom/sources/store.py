"""Several tables that change together: files first, then one manifest.

A commit is a small table ``commits/<number>`` of (name, day, path): which folders make up each table, by day. New rows are written
to folders of their own, which nobody reads before a manifest names them; the manifest is written last and counts once its success marker is there. So readers see
all changes of a commit or none, and a run that dies in between leaves only folders without a name. Two writers of one number exclude each other: the
second finds the manifest there and fails. Rows of a day are replaced by naming its new folder, or added to by naming one more.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

Folders = list[tuple[str, str]]  # (day, path)
NO_DAY = "none"


class CommittedTables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _listed(self, path: str) -> list[str]:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []

    def version(self) -> int:
        """Number of the newest complete commit, 0 before the first."""
        found = [int(n) for n in self._listed(f"{self.folder}/commits") if n.isdigit()]
        return max([n for n in found if "_SUCCESS" in self._listed(f"{self.folder}/commits/{n}")], default=0)

    def _manifest(self, version: int) -> list[tuple[str, str, str]]:
        if not version:
            return []
        return [tuple(r) for r in self.spark.read.parquet(f"{self.folder}/commits/{version}").select("name", "day", "path").collect()]  # one row per folder

    def read(self, name: str, schema: StructType, days: Iterable[str] | None = None, version: int | None = None) -> DataFrame:
        """The table as of a commit, the newest one without; with ``days`` only their folders."""
        wanted = None if days is None else set(days)
        paths = [path for table, day, path in self._manifest(self.version() if version is None else version) if table == name and (wanted is None or day in wanted)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def stage(self, name: str, rows: DataFrame, ts: str, path: str) -> Folders:
        """Writes rows to ``path``, a folder per day."""
        day = F.coalesce(F.to_date(F.col(ts)).cast("string"), F.lit(NO_DAY))
        rows.withColumn("_day", day).hint("rebalance", "_day").write.partitionBy("_day").parquet(path)
        return [(n.split("=", 1)[1], f"{path}/{n}") for n in self._listed(path) if n.startswith("_day=")]

    def commit(self, replaced: Mapping[str, Folders] | None = None, added: Mapping[str, Folders] | None = None) -> int:
        """Makes staged folders part of their tables, all at once: instead of a day's folders, or besides them."""
        version = self.version()
        gone = {(name, day) for name, folders in (replaced or {}).items() for day, _ in folders}
        rows = [r for r in self._manifest(version) if (r[0], r[1]) not in gone]
        rows += [(name, day, path) for more in (replaced or {}, added or {}) for name, folders in more.items() for day, path in folders]
        target = f"{self.folder}/commits/{version + 1}"
        try:
            self.spark.createDataFrame(rows, "name string, day string, path string").coalesce(1).write.mode("error").parquet(target)
        except AnalysisException as e:
            if "PATH_ALREADY_EXISTS" in str(e):
                raise RuntimeError(f"commit {version + 1} is taken by another writer") from e
            raise
        return version + 1
