"""Packs of consecutive groups, each as few as hold enough rows: a chain over all groups, followed in chunks.

A pack closes with the group that fills it, so all that a chunk of groups needs to know of those before is how many rows the
open pack holds, a number below the size of a pack. Each chunk says where every such number leads; the driver links the
chunks up, and each then packs its own groups. The driver gets a few numbers for each chunk and each number of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .materialize import materialize

#: Groups of a chunk.
CHUNK = 65_536
LINKS = "chunk long, rows long, ends array<long>, closed array<long>, last array<long>, before array<long>"
PACKED = "at long, pack long, turn long, start long"


def closes(sizes: np.ndarray, full: int, held: int) -> np.ndarray:
    """The groups that close a pack, if ``held`` rows are in the open one."""
    sums, found, base = np.cumsum(sizes), [], -held
    while True:
        k = int(np.searchsorted(sums, base + full))
        if k >= len(sums):
            return np.array(found, np.int64)
        found.append(k)
        base = int(sums[k])


def _chunks(batches, size: int):
    """(chunk, positions, sizes, table) of batches sorted by position, whole chunks of ``size`` each."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        at = b.column("at").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(at // size)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                if held and held[0].column("at")[0].as_py() // size != at[lo] // size:
                    yield _whole(held, size)
                    held = []
                held.append(b.slice(lo, hi - lo))
    if held:
        yield _whole(held, size)


def _whole(held, size: int):
    t = pa.Table.from_batches(held)
    at = t.column("at").to_numpy()
    return int(at[0]) // size, at, t.column("n").to_numpy(), t


def links(batches, size: int, full: int):
    """What each number of rows in the open pack becomes by the end of a chunk, the packs closed by then, and where the open
    pack begins: after how many of the chunk's groups, and rows (-1: before the chunk). Numbers that close a pack with the
    same group go on alike, so the chain is followed once for each group that may be the first to close one."""
    for chunk, _, sizes, _ in _chunks(batches, size):
        sums = np.cumsum(sizes)
        first = np.searchsorted(sums, full - np.arange(full))  # the group that closes the open pack, by the rows it holds
        ends, closed, last, before = (np.empty(full, np.int64) for _ in range(4))
        for k in np.unique(first):
            own = first == k
            if k >= len(sums):
                ends[own], closed[own], last[own], before[own] = np.arange(full)[own] + sums[-1], 0, -1, -1
                continue
            more = closes(sizes[k + 1 :], full, 0) + k + 1
            final = int(more[-1]) if len(more) else int(k)
            ends[own], closed[own], last[own], before[own] = sums[-1] - sums[final], 1 + len(more), final + 1, sums[final]
        yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([int(sums[-1])]), *(pa.array([x.tolist()], pa.list_(pa.int64())) for x in (ends, closed, last, before))], ["chunk", "rows", "ends", "closed", "last", "before"])


def packed(batches, size: int, full: int):
    """PACKED of each group: its pack, its place in it, and the rows in all packs before."""
    for chunk, at, sizes, t in _chunks(batches, size):
        held, pack, began, start, rows = (t.column(c)[0].as_py() for c in ("held", "pack", "began", "start", "before"))
        cut = closes(sizes, full, held) + 1
        bounds = np.concatenate(([0], cut))
        which = np.searchsorted(cut, np.arange(len(sizes)), "right")
        sums = np.concatenate(([0], np.cumsum(sizes)))
        first, begin = chunk * size + bounds, rows + sums[bounds]
        first[0], begin[0] = began, start
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(pack + which), pa.array(at - first[which]), pa.array(begin[which])], ["at", "pack", "turn", "start"])


def pack_groups(groups: DataFrame, full: int) -> DataFrame:
    """PACKED of (at, n): groups by position from 0 without gaps, with their rows (one at least). A pack takes groups until it
    has ``full`` rows; the last may have fewer."""
    spark, size = groups.sparkSession, CHUNK
    by_chunk = lambda df: df.repartition(F.floor(F.col("at") / size)).sortWithinPartitions("at")
    found = by_chunk(groups.select("at", F.col("n").cast("long").alias("n"))).mapInArrow(lambda it: links(it, size, full), LINKS)
    held, pack, began, start, before, entries = 0, 0, 0, 0, 0, []
    for r in materialize(found, "links").orderBy("chunk").toLocalIterator():
        entries.append((r["chunk"], held, pack, began, start, before))
        if r["closed"][held]:
            pack += r["closed"][held]
            began, start = r["chunk"] * size + r["last"][held], before + r["before"][held]
        before += r["rows"]
        held = r["ends"][held]
    table = spark.createDataFrame(entries, "chunk long, held long, pack long, began long, start long, before long")
    rows = groups.select("at", F.col("n").cast("long").alias("n"), F.floor(F.col("at") / size).alias("chunk")).join(table, "chunk")
    return by_chunk(rows).mapInArrow(lambda it: packed(it, size, full), PACKED)
