"""Keys that were seen before, kept as bucketed runs: a new batch is anti-joined with them without shuffling a run."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyRuns:
    """Runs of keys below ``root``, one for each batch number or range of them: folders ``run-<first>-<last>``.

    Each is a table bucketed and sorted by the key. A batch that runs again sees only runs of earlier batches, and replaces its own.
    ``merge_each`` neighbouring runs of equal span are merged into one, so that n batches leave about log n runs; what was merged is deleted
    only once the merged run is whole. ``buckets`` must stay the same for a root; more suit more keys.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, kind: str, buckets: int = 16, merge_each: int = 8):
        self.spark, self.root, self.key, self.kind, self.buckets, self.merge_each = spark, root.rstrip("/"), key, kind, buckets, merge_each
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.files = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def runs(self) -> list[tuple[int, int]]:
        """(first, last) batch of each whole run, in order; without those that a larger one holds."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        names = [f.getPath().getName() for f in self.files.listStatus(top)] if self.files.exists(top) else []
        found = [tuple(int(x) for x in n.split("-")[1:]) for n in names if n.startswith("run-") and self.files.exists(self._path(f"{n}/_SUCCESS"))]
        return sorted(r for r in found if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in found))

    def _table(self, run: tuple[int, int]) -> DataFrame:
        """The run as a bucketed table; a session that didn't write it enters it into its catalog first."""
        name = f"key_run_{hashlib.md5(self.root.encode()).hexdigest()[:12]}_{run[0]}_{run[1]}"
        where = f"{self.root}/run-{run[0]}-{run[1]}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (`{self.key}` {self.kind}) USING parquet CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{where}'")
        return self.spark.table(name)

    def _write(self, keys: DataFrame, run: tuple[int, int]) -> None:
        name, where = f"key_run_{hashlib.md5(self.root.encode()).hexdigest()[:12]}_{run[0]}_{run[1]}", f"{self.root}/run-{run[0]}-{run[1]}"
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.files.delete(self._path(f"run-{run[0]}-{run[1]}"), True)
        keys.repartition(self.buckets, self.key).write.bucketBy(self.buckets, self.key).sortBy(self.key).option("path", where).mode("overwrite").saveAsTable(name)

    def _drop(self, run: tuple[int, int]) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS key_run_{hashlib.md5(self.root.encode()).hexdigest()[:12]}_{run[0]}_{run[1]}")
        self.files.delete(self._path(f"run-{run[0]}-{run[1]}"), True)

    def unseen(self, batch: DataFrame, number: int) -> DataFrame:
        """Rows of ``batch`` whose key no batch before ``number`` had; rows without a key stay."""
        fresh = batch.repartition(self.buckets, self.key)
        for run in self.runs():
            if run[1] < number:
                fresh = fresh.join(self._table(run).hint("merge"), self.key, "left_anti")
        return fresh

    def add(self, keys: DataFrame, number: int) -> None:
        """Keep the distinct ``keys`` of batch ``number``."""
        self._write(keys.select(self.key).filter(F.col(self.key).isNotNull()), (number, number))

    def compact(self, number: int) -> None:
        """Merge runs of batches before ``number`` and delete those that merged runs hold."""
        while True:
            runs = [r for r in self.runs() if r[1] < number]
            last = runs[-self.merge_each :]
            if len(last) < self.merge_each or len({b - a for a, b in last}) > 1:
                break
            every = self._table(last[0])
            for r in last[1:]:
                every = every.unionByName(self._table(r))
            self._write(every, (last[0][0], last[-1][1]))
            for r in last:
                self._drop(r)
