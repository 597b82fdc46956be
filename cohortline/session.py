"""Where intermediate results go: the shared folder named by the session."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a private one only for local runs without it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    base = tempfile.mkdtemp(prefix="cohortline-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


_written: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table under the shared folder."""
    folder = f"{shared_dir(spark)}/cohortline/{uuid.uuid4().hex}"
    _written.append(folder)
    return f"{folder}/{name}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete on leaving what was written to scratch paths inside; write or collect the results before.

    It covers all threads of the driver, so leave no other query half done.
    """
    mark = len(_written)
    try:
        yield
    finally:
        while len(_written) > mark:
            path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once and cut its lineage, so that loops re-read it and lost executors cost nothing.

    A written table keeps the column statistics and splits of Parquet, which a checkpointed RDD loses.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table.parquet")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
