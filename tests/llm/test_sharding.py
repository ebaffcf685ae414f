import hashlib
import random
import zlib
from collections import defaultdict
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowloom.llm import sharding
from rowloom.llm.sharding import GroupIndex, fits, minimax_cuts, op6_sharding, shard


def brute(sizes, shards):
    """The least largest sum of a cut of ``sizes`` into runs."""
    best = [0, *[float("inf")] * len(sizes)]
    sums = list(accumulate(sizes, initial=0))
    for _ in range(shards):
        best = [min(max(best[j], sums[i] - sums[j]) for j in range(i + 1)) for i in range(len(sizes) + 1)]
    return best[-1]


class Fake(GroupIndex):
    def __init__(self, sizes, chunk):
        parts = [sizes[i : i + chunk] for i in range(0, len(sizes), chunk)]
        self.parts, self.ends = parts, list(accumulate(map(sum, parts)))
        self.total, self.largest = sum(sizes), max(sizes, default=0)
        self.chunk = chunk

    def inside(self, at):
        start = self.ends[at - 1] if at else 0
        return np.array(self.parts[at]).cumsum() + start, pa.array([at * self.chunk + i for i in range(len(self.parts[at]))]), pa.array([b""] * len(self.parts[at]))


def test_capacity_is_the_least():
    rng = random.Random(3)
    for _ in range(60):
        sizes = [rng.choice((1, 2, 5, rng.randrange(1, 60))) for _ in range(rng.randrange(1, 40))]
        shards, index = rng.randrange(1, 9), Fake(sizes, rng.randrange(1, 7))
        capacity, cuts = minimax_cuts(index, shards)
        assert capacity == brute(sizes, shards)
        assert fits(index, capacity, shards) and (capacity == max(sizes) or not fits(index, capacity - 1, shards))
        bounds = [0, *(k + 1 for k, _ in cuts), len(sizes)]
        assert bounds == sorted(bounds) and len(cuts) < shards
        assert max(sum(sizes[a:b]) for a, b in zip(bounds, bounds[1:])) <= capacity


def test_query(spark, documents):
    rng = random.Random(1)
    texts = ["hot " * 20] * 90 + [f"t{i} " * rng.randrange(1, 9) for i in range(160)] + [None, None, "", "", "é北😀", "x" * 5000]
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)] + [(7, texts[7])] * 3
    out = op6_sharding(spark, documents(rows)).collect()
    assert len(out) == len(rows)
    by, group = defaultdict(list), defaultdict(set)
    for r in out:
        by[r["shard"]].append(r)
        group[r["text_crc32"], r["size"]].add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(len(s) == 1 for s in group.values())  # equal texts stay together
    for found in by.values():
        assert sorted(r["slot"] for r in found) == list(range(len(found)))
    expected = sorted(((None if i is None else i), len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode())) for i, t in rows if i is not None)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in out if r["doc_id"] is not None and r["text_crc32"] is not None) == [e for e in expected if e[2] is not None]


def test_many_chunks_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(sharding, "GROUPS", 16)
    monkeypatch.setattr(sharding, "CHUNKS", 2)
    rng = random.Random(6)
    sizes = [rng.choice((1, 3, rng.randrange(1, 200))) for _ in range(400)]
    df = spark.createDataFrame([(i, n, f"g{i % 350}") for i, n in enumerate(sizes)], "i int, size long, g string")
    out = shard(df, 5, F.col("size"), F.substring(F.unhex(F.sha2("g", 256)), 1, 16), {"i": F.col("i"), "size": F.col("size"), "hash": F.col("g"), "__rl_size": F.lit("x")}, ["i"])
    assert out.columns == ["i", "size", "hash", "__rl_size", "shard", "slot"]
    loads, groups = defaultdict(int), defaultdict(int)
    rows = out.collect()
    for r in rows:
        loads[r["shard"]] += r["size"]
        groups[r["hash"]] += r["size"]
    order = sorted(groups, key=lambda g: hashlib.sha256(g.encode()).digest())
    assert len(rows) == 400 and max(loads.values()) == brute([groups[g] for g in order], 5)
    with pytest.raises(ValueError, match="shard and slot"):
        shard(df, 5, F.col("size"), F.unhex("g"), {"slot": F.col("i")}, ["slot"])


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, "")]])
def test_tiny(spark, documents, rows):
    out = op6_sharding(spark, documents(rows)).collect()
    assert [(r["shard"], r["slot"]) for r in out] == [(0, 0)] * len(rows)
