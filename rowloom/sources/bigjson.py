"""One JSON object in a file of any size, read by many tasks: its inner objects as rows, the rest as a skeleton.

Spark reads the file as fragments between quotes, wherever its blocks begin, and these are joined to chunks. Whether a chunk
begins within a string, and how deep, follows from what the chunks before it do to a reader in either state: a few numbers
for each, which the driver strings together. Units are the values three brackets deep (an element of a list, or a value of an
object, that the outermost object holds). They become rows; what is left, with a count in place of units, is parsed as a whole.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.materialize import discard, materialize

#: Bytes of a chunk or so; a longer string is one of its own.
CHUNK = 1 << 20
UNIT = 3
_STEP = np.zeros(256, np.int8)
_STEP[[*b"{["]], _STEP[[*b"}]"]] = 1, -1
_BLANK = np.zeros(256, bool)
_BLANK[[*b" \t\r\n"]] = True
_SCHEMA = "block long, seq int, quoted boolean, open boolean, outside long, inside long, data binary"
_UNITS = "at long, k int, whole boolean, text binary, skeleton binary"


def _strings(data: np.ndarray) -> tuple[np.ndarray, bool]:
    """Whether each byte is within a string, for a reader who begins outside (an opening quote is, a closing one isn't); whether
    a quote that came next would be escaped. Before ``data`` comes a quote or nothing."""
    inside = np.zeros(len(data), np.uint8)
    quotes = np.flatnonzero(data == ord('"'))
    slashes = data == ord("\\")
    escaped = False
    if slashes.any():
        last = np.maximum.accumulate(np.where(slashes, -1, np.arange(len(data))))
        quotes = quotes[(quotes - 1 - np.append(-1, last)[quotes]) % 2 == 0]
        escaped = bool((len(data) - 1 - last[-1]) % 2)
    inside[quotes] = 1
    return np.bitwise_xor.accumulate(inside) == 1, escaped


def _chunks(batches):
    """A row for each chunk: whether it holds an odd number of quotes (``quoted``), would escape a quote (``open``), and the change of depth for a
    reader who begins outside or inside of a string."""
    held, size, block, seq = [], 0, None, 0

    def row() -> pa.RecordBatch:
        data = b'"'.join(held)
        a = np.frombuffer(data, np.uint8)
        inside, escaped = _strings(a)
        step = _STEP[a]
        values = block, seq, bool(len(a) and inside[-1]), escaped, int(step[~inside].sum(dtype=np.int64)), int(step[inside].sum(dtype=np.int64)), data
        kinds = pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["block", "seq", "quoted", "open", "outside", "inside", "data"])

    for b in batches:
        for start, value in zip(b.column("block").to_pylist(), b.column("value").to_pylist(), strict=True):
            if held and (start != block or size >= CHUNK):
                yield row()
                held, size, seq = [], 0, seq + 1
            if start != block:
                block, seq = start, 0
            held.append(value)
            size += len(value) + 1
    if held:
        yield row()


def _units(batches, known: dict[tuple[int, int], tuple[int, bool, int]]):
    """The units of each chunk, k counting from 1 those that begin in it, 0 for the rest of one that began before; and a row with its
    skeleton, k the units that begin. ``known``: a chunk's number, whether it begins within a string, and how deep."""
    for b in batches:
        for block, seq, data in zip(*(b.column(c).to_pylist() for c in ("block", "seq", "data")), strict=True):
            at, begins, depth = known[block, seq]
            a = np.frombuffer(data if at else data.removeprefix(b"\xef\xbb\xbf"), np.uint8)
            inside = _strings(a)[0] ^ begins
            if at:  # the quote before it
                a, inside = np.append(np.uint8(ord('"')), a), np.append(True, inside)
            step = np.where(inside, 0, _STEP[a]).astype(np.int64)
            after = depth + np.cumsum(step)
            within = np.maximum(after, after - step) >= UNIT
            first = np.flatnonzero((step == 1) & (after == UNIT))
            ends = np.flatnonzero((step == -1) & (after == UNIT - 1)) + 1
            marked = np.where(a == 1, 2, a).astype(np.uint8)  # neither may stand in JSON
            marked[first] = 1
            keep = ~within & ~(_BLANK[a] & ~inside)
            keep[first] = True
            skeleton = re.sub(rb"\x01(?:,\x01)*", lambda m: b"[%d]" % ((len(m[0]) + 1) // 2), marked[keep].tobytes())
            late = depth >= UNIT
            starts = np.append(0, first) if late else first
            stops = ends if len(ends) == len(starts) else np.append(ends, len(a))
            raw = a.tobytes()
            texts = [raw[s:e] for s, e in zip(starts.tolist(), stops.tolist(), strict=True)]
            whole = np.ones(len(texts), bool)
            whole[:1] &= not late
            whole[len(ends) :] = False
            n = len(texts)
            ks = np.append(np.arange(n) + (not late), len(first)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n + 1, at)), pa.array(ks), pa.array([*whole.tolist(), None], pa.bool_()), pa.array([*texts, None], pa.binary()), pa.array([*[None] * n, skeleton], pa.binary())],
                ["at", "k", "whole", "text", "skeleton"],
            )


def _states(summaries: list) -> dict[tuple[int, int], tuple[int, bool, int]]:
    """What ``_units`` has to know of each chunk, from the rows of all in the order of the file."""
    known, inside, depth = {}, False, 0
    for at, r in enumerate(summaries):
        known[r["block"], r["seq"]] = at, inside, depth
        depth += r["inside" if inside else "outside"]
        inside ^= r["quoted"]
        if not (inside and r["open"]):  # the quote that follows turns it, unless it is escaped
            inside = not inside
    return known


class _Pairs(list):
    """An object's keys and values in order, keys that come again among them."""


def _members(skeleton: bytes) -> list[tuple[str, str | None, list[tuple[str, int]], int, int]]:
    """Of each member of the outermost object: key, kind (object, list or None), (key, unit) of an object's values (-1: no unit), and
    the units of a list, from one to before another (-1: not all elements are units)."""
    found = json.loads(skeleton, object_pairs_hook=_Pairs)
    if not isinstance(found, _Pairs):
        raise ValueError("the file must hold a JSON object")
    out, u = [], 0
    for key, value in found:
        kind, inner, start = None, [], u
        if isinstance(value, _Pairs):
            kind = "object"
            for k, v in value:
                inner.append((k, u if isinstance(v, list) else -1))
                u += isinstance(v, list)
        elif isinstance(value, list):
            kind = "list"
            u += sum(v[0] for v in value if isinstance(v, list))
            start = start if all(isinstance(v, list) for v in value) else -1
        out.append((key, kind, inner, start, u))
    return out


def read_object(spark: SparkSession, path: str) -> tuple[list[tuple], DataFrame, list[DataFrame]]:
    """The members of the one JSON object in the file at ``path`` (as ``_members``), (unit, text) of its units, and stored tables
    that may go once the units are read. The file must be in UTF-8."""
    lines = spark.read.text(path, lineSep='"')
    if len(lines.inputFiles()) != 1:
        raise ValueError("an object is read from one file")
    lines = lines.select(F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    chunks = materialize(lines.mapInArrow(_chunks, _SCHEMA), "json-chunks")
    summaries = chunks.drop("data").orderBy("block", "seq").collect()
    known = _states(summaries)
    cut = materialize(chunks.select("block", "seq", "data").mapInArrow(lambda it: _units(it, known), _UNITS), "json-units")
    discard(chunks)
    rest = cut.where("skeleton is not null").select("at", "k", "skeleton").orderBy("at").collect()
    try:
        members = _members(b"".join(bytes(r["skeleton"]) for r in rest))
    except (ValueError, RecursionError) as e:
        raise ValueError(f"the file holds no JSON object: {e}") from e
    bases = np.cumsum([0, *(r["k"] for r in rest)])[:-1]
    base = spark.createDataFrame(pa.table({"at": pa.array([r["at"] for r in rest], pa.int64()), "base": pa.array(bases - 1, pa.int64())}))
    placed = cut.where("skeleton is null").join(F.broadcast(base), "at").select((F.col("base") + F.col("k")).alias("unit"), "at", "whole", F.col("text").cast("string").alias("text"))
    parts = placed.where("not whole").groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("x"))
    units = placed.where("whole").select("unit", "text").unionByName(parts.select("unit", F.array_join(F.transform("x", lambda p: p["text"]), "").alias("text")))
    return members, units, [cut]
