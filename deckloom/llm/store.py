"""Materialised intermediates in the folder that the cluster shares.

Executors can be lost at any time, so results that several jobs read are cut
from their lineage by writing them below ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN_DIRS: dict[str, str] = {}
#: Bytes of a row group.
ROW_GROUP = 16 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir`` of the session, or, where
    that is unset and Spark runs on this machine alone, one temporary folder
    per application.  Clusters must set it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not re.match(r"local(\[|$)", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share (master is {master})")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="deckloom-")
    return "file://" + _OWN_DIRS[app]


@contextmanager
def _while_writing(spark: SparkSession) -> Iterator[None]:
    """Queries run inside leave no shuffle files once they are done: what they
    wrote is read from now on, and never their shuffles."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame, label: str, *, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The table outlives the query that made it (its result is lazy);
    :func:`clean` removes all of an application's tables.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/deckloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    # rows may hold bodies of megabytes: small row groups bound what tasks hold
    writer = df.write.option("compression", compression).option("parquet.block.size", ROW_GROUP)
    with _while_writing(spark):
        writer.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._materialised_at = path
    return table


def reread(table: DataFrame) -> DataFrame:
    """A materialised table once more, for plans that need it on two sides."""
    again = table.sparkSession.read.schema(table.schema).parquet(table._materialised_at)
    again._materialised_at = table._materialised_at
    return again


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(table: DataFrame) -> None:
    """Remove a materialised table that no later query reads."""
    _delete(table.sparkSession, table._materialised_at)


def clean(spark: SparkSession) -> None:
    """Remove the tables that this application materialised."""
    _delete(spark, f"{shared_dir(spark)}/deckloom/{spark.sparkContext.applicationId}")
