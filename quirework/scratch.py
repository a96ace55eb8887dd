"""Tables kept between jobs, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
#: Tables written since the innermost ``cleared`` began, by run.
_runs: list[list[str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local one of our own where it is unset and the
    master is local (tests). On a cluster it must be set."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="quirework-"))
    return _own[0]


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: lineage ends there, and a lost
    executor costs a reread instead of a recomputation."""
    path = f"{scratch_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for run in _runs[-1:]:
        run.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark can reach it; one that is not there is fine."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Tables that are kept inside are deleted at the end, so what was made of them must have been written by then:

    with cleared(spark):
        near_duplicates(docs).write.parquet(path)"""
    _runs.append([])
    try:
        yield
    finally:
        for path in _runs.pop():
            remove(spark, path)
