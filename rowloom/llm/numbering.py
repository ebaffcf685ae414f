"""Exact running sums without a task that holds a whole key.

Rows are cut into chunks by the leading bits of a hash, chunk totals are summed first (few rows), and only
rows of one chunk are sorted together. The order is that of the hash, so it doesn't depend on the number of chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that one chunk holds on average, at most.
CHUNK_ROWS = 4096
#: Hash values that order rows have so many bits.
ORDER_BITS = 62


def order_hash(text: Column) -> Column:
    """A non-negative number of ORDER_BITS bits, the last two of them zero: the first 15 digits of a text's MD5."""
    return F.shiftleft(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), ORDER_BITS - 60)


def chunk_bits(rows: int, size: int = CHUNK_ROWS) -> int:
    return max(0, (rows // size).bit_length())


def chunk_of(order: Column, bits: int) -> Column:
    return F.shiftright(order, ORDER_BITS - bits).cast("long") if bits else F.lit(0).cast("long")


def running(df: DataFrame, keys: list[str], chunk: str, order: list[str], value: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same keys that come before. Keys hold no nulls.

    ``chunk`` must not decrease along ``order``. ``df`` is read twice, so it should be stored.
    """
    totals = df.groupBy(*keys, chunk).agg(F.sum(value).alias("__rl_total"))
    before = W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    base = totals.select(*keys, chunk, F.coalesce(F.sum("__rl_total").over(before), F.lit(0)).alias("__rl_base"))
    inside = W.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    joined = df.join(base, [*keys, chunk])
    return joined.withColumn(out, F.col("__rl_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("__rl_base")
