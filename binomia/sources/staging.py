"""Tables between the steps of a long plan."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders made in the open scopes, innermost last.
_SCOPES: list[list[str]] = []


@contextmanager
def staging_scope(spark: SparkSession) -> Iterator[None]:
    """Drop the folders that are made inside, at the end: write what was computed before leaving.

    Results are read from these tables when they are used, so nothing is dropped without a scope.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        for p in _SCOPES.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staging_path(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; without that setting a temporary one, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-binomia-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def staged(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back.

    The plan above starts from files that all executors share, so it stays small, is
    computed once however often it is used, and survives lost executors. ``rows_per_file``
    limits a file (0: as large as its task): a reader gets more and more even tasks.
    """
    spark, path = df.sparkSession, staging_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
