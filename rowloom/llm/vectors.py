"""Tables of distinct vectors, and codebooks fitted on a bounded sample of them."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import store
from .substrings import LAST

#: Codebooks are fitted on so many distinct vectors at most, those with the least digests.
SAMPLE = 20_000
#: Centroids of a codebook at most.
CENTROIDS = 4096


def _clean(batches):
    """rank, length, digest and bytes of each vector; null bytes where it is null, zero, or holds null or non-finite components."""
    for b in batches:
        lists = b.column("embedding")
        kind = np.float32 if pa.types.is_float32(lists.type.value_type) else np.float64
        lengths, out, marks = [], [], []
        for x in lists:
            ok = x.is_valid and not x.values.null_count and len(x.values)
            v = x.values.to_numpy(zero_copy_only=False).astype(kind) if ok else None
            ok = ok and np.isfinite(v).all() and v.any()
            out.append((v + 0).tobytes() if ok else None)
            lengths.append(len(v) if ok else 0)
            marks.append(hashlib.blake2b(out[-1], digest_size=16).digest() if ok else None)
        yield pa.RecordBatch.from_arrays([b.column("rank"), pa.array(lengths, pa.int32()), pa.array(marks, pa.binary()), pa.array(out, pa.binary())], ["rank", "length", "digest", "vec"])


def as_matrix(column: pa.Array, width: int) -> np.ndarray:
    """Bytes of vectors as doubles; ``width`` is the bytes of a component."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.float32 if width == 4 else np.float64).reshape(len(column), -1).astype(np.float64)


def distinct_vectors(df: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(rank, digest) of each row of (vec_id, embedding), stored, digest null for those that take no part; (id, digest,
    first, copies, vec) of each distinct vector, stored; bytes of a component.

    Null ids rank last. Vectors of another length than most (the shorter among equals) take no part either.
    """
    kind = df.schema["embedding"].dataType.elementType.simpleString()
    wide = df.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(LAST)).alias("rank"), F.col("embedding").cast("array<float>" if kind == "float" else "array<double>"))
    rows = store(wide.mapInArrow(_clean, "rank long, length int, digest binary, vec binary"), "vector-rows")
    most = rows.where("length > 0").groupBy("length").count().orderBy(F.desc("count"), "length").first()
    fit = F.col("length") == (most[0] if most else 0)
    found = rows.where(fit & F.col("digest").isNotNull()).groupBy("digest").agg(F.min("rank").alias("first"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    distinct = store(found.select(F.monotonically_increasing_id().alias("id"), "*"), "vectors")
    return rows.select("rank", F.when(fit, F.col("digest")).alias("digest")), distinct, 4 if kind == "float" else 8


def sampled(distinct: DataFrame, width: int) -> np.ndarray:
    rows = distinct.orderBy("digest").select("vec").limit(SAMPLE).collect()
    return as_matrix(pa.array([bytes(r[0]) for r in rows], pa.binary()), width) if rows else np.zeros((0, 1))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, by their expansion: near enough to assign and to order cells."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def codebook(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's k-means from k points spread evenly over the sample; the same for the same points."""
    if not len(points):
        return np.zeros((1, points.shape[1]))
    k = max(1, min(k, len(points)))
    centres = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        nearest = squared(points, centres).argmin(1)
        count = np.bincount(nearest, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres
