"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark deletes a query's shuffle files when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_OWNED: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where the session names none, a temporary one, if it runs on this machine alone."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="clauseloom-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/clauseloom/{name}-{uuid.uuid4().hex}"
    _OWNED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str, codec: str | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` once to the shared folder: the written table and its path, for :func:`discard`. ``codec`` compresses its pages, the session's unless given.

    Work goes on from the table, so a lost executor never forces what came before it to run again. Shuffle
    files of the write go when it has ended.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """The table of :func:`written`."""
    return written(df, name, codec)[0]


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete written tables whose last reader has been written itself."""
    own = _OWNED.get(spark.sparkContext.applicationId, [])
    for path in paths:
        if path in own:
            own.remove(path)
    _delete(spark, paths)


def _delete(spark: SparkSession, paths: Iterable[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def release(spark: SparkSession) -> None:
    """Delete every intermediate table of this application. Call it after results are written."""
    _delete(spark, _OWNED.pop(spark.sparkContext.applicationId, []))
