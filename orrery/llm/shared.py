"""Scratch tables in the folder that the cluster shares, and small helpers."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only where it is unset and the session has a single process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = f"file://{tempfile.mkdtemp(prefix='orrery-')}"
    return _OWN[app]


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no recomputation and row ids stay put.

    Every instance has a folder of its own; it goes when the session's interpreter ends, single tables by ``drop``.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/orrery/{purpose}-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(self.path(name))

    def _remove(self, path: str) -> None:
        try:
            sc = self.spark.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may have ended; then the folder is the cluster's to clean
            pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text"):
    """A null text counts as an empty one."""
    return F.coalesce(F.col(column), F.lit(""))
