"""Durable cuts of lineage: tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is made, and only in local mode, where driver and
    executors are one process.
    """
    sc = spark.sparkContext
    if folder := sc.getConf().get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = made = tempfile.mkdtemp(prefix="resonara-")
        atexit.register(shutil.rmtree, made, True)
    return "file://" + _own[sc.applicationId]


#: Folders of the shelves made within ``passing``, innermost last.
_passing: list[list[str]] = []


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def passing(spark: SparkSession):
    """What operators write to the shared folder within this block is deleted at its end: use their results before."""
    _passing.append([])
    try:
        yield
    finally:
        delete(spark, *_passing.pop())


class Shelf:
    """Tables written to the shared folder, so that lineage ends there and a lost executor costs nothing."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        if _passing:
            _passing[-1].append(self.base)

    def put(self, df: DataFrame) -> DataFrame:
        """Write df and return the written table; its path is in ``df.shelf_path``."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out.shelf_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        delete(self.spark, *(t.shelf_path for t in tables))
