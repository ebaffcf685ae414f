"""A bitmap of keys, by which rows that have no partner stay out of a shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys up to which there is a bitmap (of 16 bits or more for each, so of 16 MB at most), which is sent to all executors.
MOST, EACH = 1 << 23, 16


def may_occur(keys: DataFrame, columns: list[str]) -> Column:
    """Whether a row's ``columns`` may occur in ``keys`` (a stored table): true of all that do, and of some sixteenth of the
    others at most; of all rows if there are more than MOST keys."""
    n = keys.count()
    if n > MOST:
        return F.lit(True)
    bits = 1 << max(10, (n * EACH - 1).bit_length())
    place = F.pmod(F.xxhash64(F.lit(bits), *columns), F.lit(bits))
    held = np.zeros(bits // 8, np.uint8)
    found = keys.select(place.cast("int").alias("p")).distinct().toArrow().column("p").to_numpy()
    np.bitwise_or.at(held, found >> 3, np.left_shift(1, found & 7).astype(np.uint8))
    bitmap = keys.sparkSession.createDataFrame(pa.table({"bits": pa.array([held.tobytes()], pa.binary())})).scalar()
    byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (place % 8).cast("int")) == 1


def likely_members(rows: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """The ``rows`` that may occur in ``keys``, for a join to move few rows; the join still has to decide."""
    return rows.where(may_occur(keys, columns))
