"""Tables written once and read back, and row positions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Up to so many rows one sort of all of them numbers them; beyond, parts of the sorted table are numbered by themselves.
ONE_SORT = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a temporary one, on a single machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rowloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/rowloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a table that ``materialize`` wrote, and that nothing reads any more."""
    spark = df.sparkSession
    for path in {name.rpartition("/")[0] for name in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def number(df: DataFrame, out: str, order_by: list, rows: int | None = None) -> DataFrame:
    """Add ``out``, the position of each row in the order of ``order_by`` (which must be total), from 0.

    A small table takes one window. A large one is range-partitioned and sorted once and written; each part's rows are
    numbered by themselves and shifted by the sizes of the parts before, of which there is one number each.
    """
    n = df.count() if rows is None else rows
    if n <= ONE_SORT:
        return df.withColumn(out, (F.row_number().over(W.orderBy(*order_by)) - 1).cast("long"))
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-n // 1_000_000))
    ranged = df.repartitionByRange(parts, *order_by).sortWithinPartitions(*order_by)
    ranged = materialize(ranged.withColumn("__m", F.monotonically_increasing_id()), "sorted")
    part, inside = F.shiftright("__m", 33), F.col("__m").bitwiseAND((1 << 33) - 1)
    sizes = ranged.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    return ranged.withColumn("__p", part).join(F.broadcast(before), "__p").withColumn(out, F.col("__b") + inside).drop("__m", "__p", "__b")


def positioned(df: DataFrame, out: str = "_pos") -> DataFrame:
    """Add ``out``: the position of each row as the table is read, from 0. The table is written once, so it stays."""
    kept = materialize(df.withColumn("__m", F.monotonically_increasing_id()), "input")
    part, inside = F.shiftright("__m", 33), F.col("__m").bitwiseAND((1 << 33) - 1)
    sizes = kept.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    return kept.withColumn("__p", part).join(F.broadcast(before), "__p").withColumn(out, F.col("__b") + inside).drop("__m", "__p", "__b")
