"""Tables in the shared folder, to cut lineage where a result is read several times."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a written table of numbers that one task may write.
ROWS_A_FILE = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a folder of our own in local mode; on a cluster an error, as executors share no local folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_dir()


@functools.lru_cache(maxsize=1)
def _own_dir() -> str:
    where = tempfile.mkdtemp(prefix="docfacts-")
    atexit.register(shutil.rmtree, where, ignore_errors=True)
    return where


def _folder(spark: SparkSession) -> str:
    """Where the written tables of this application lie."""
    return f"{shared_dir(spark)}/docfacts/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and reread.

    rows: how many rows of a few numbers there may be, where that is known; a small
    table is then written by few tasks."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has written; results that still read them are lost.

    For a long-lived application, between jobs."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
