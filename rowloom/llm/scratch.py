"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of the blocks of ``dropping`` that are open, the innermost last.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open blocks", default=())


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a temporary one, on a single machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="rowloom-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def store(df: DataFrame, name: str, result: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and survives lost executors.

    Within ``dropping`` the table goes with the block; the block's ``result`` goes with the one around it, if any."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/rowloom-{name}-{uuid.uuid4().hex}"
    if owners := _OPEN.get()[: -1 if result else None]:
        owners[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def dropping(spark: SparkSession):
    """Tables stored within the block are removed at its end, so nothing that outlasts it may read them but its result.

    The JVM is asked to collect, so that Spark removes the shuffle files of jobs that nothing refers to any more."""
    own: list[str] = []
    token = _OPEN.set((*_OPEN.get(), own))
    try:
        yield
    finally:
        _OPEN.reset(token)
        for path in own:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        spark._jvm.System.gc()


def together(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Rows of equal keys in one partition, one after another, by ``order``.

    Dealt by a hash of the keys: an exchange by the keys themselves is left out after a join by them, and when that
    join turns into a broadcast join at run time its inputs are read where they lie, a key in several partitions.
    """
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)
