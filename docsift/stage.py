"""Cutting lineage through tables written to the folder that all executors share.

A written table survives the loss of any executor, unlike localCheckpoint, and
is compressed and columnar, unlike an RDD checkpoint.  The folder is the
session's ``spark.checkpoint.dir``.  Only a session in local mode, as in tests,
may leave it unset; it then gets a temporary folder.  On a cluster an operator
that needs the folder fails at once with a message.

The tables of a run are deleted as soon as no later step reads them, and the
rest when the application ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
#: Lets Spark remove the shuffle files of a query when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share; this operator writes tables there")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="docsift-")
    return _FALLBACK[app]


class Stage:
    """Tables written by one operator run; ``drop`` removes those no longer read, the end of the application the rest."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/docsift/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def _file_system(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def save(self, df: DataFrame, label: str = "t") -> DataFrame:
        """Write ``df`` now and return a scan of what was written; shuffle files of the write are removed with its end."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{label}"
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            # planned anew under the setting, so that a plan executed before is not executed again without its files
            df.select("*").write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before) if before is not None else self.spark.conf.unset(_CLEANUP)
        if self.count == 1:
            files, target = self._file_system(self.root)
            files.deleteOnExit(target)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._docsift_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete the table behind a DataFrame that ``save`` returned."""
        path = getattr(df, "_docsift_path", None)
        if path:
            files, target = self._file_system(path)
            files.delete(target, True)
