"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Folders of operator calls, each with the settings that find it again; they go when the program ends.
_FOLDERS: dict[str, object] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local master (tests) gets
    a temporary folder, which is then kept in the session's settings; a cluster is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("orfweave.shared.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="orfweave-")
        spark.conf.set("orfweave.shared.dir", folder)
        _FOLDERS[folder] = spark.sparkContext._jsc.hadoopConfiguration()
    return folder.rstrip("/")


def delete(path: str, configuration) -> None:
    """Deletes a folder, also after the session was stopped; what is gone already is no error."""
    if SparkContext._gateway is None:
        return
    target = SparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(configuration).delete(target, True)


@atexit.register
def _delete_all() -> None:
    while _FOLDERS:
        delete(*_FOLDERS.popitem())


#: Whether the files of a query's shuffles go when the query ends; else when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables of one operator call, below the shared folder. A written table cuts the lineage: a lost
    executor costs only the tasks that had not been written. What was shuffled for it isn't kept beside it."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/orfweave-{label}-{uuid.uuid4().hex}"
        self._count = 0
        _FOLDERS[self.root] = spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, name: str) -> str:
        self._count += 1
        return f"{self.root}/{self._count:04d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes a table and returns a frame that reads it back."""
        path = self.path(name)
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path, compression="zstd")
        finally:
            self.spark.conf.unset(_CLEANUP) if before is None else self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._orfweave_path = path
        return out

    def drop(self, what: DataFrame) -> None:
        """Deletes a table that write() returned."""
        if path := getattr(what, "_orfweave_path", None):
            delete(path, _FOLDERS[self.root])
