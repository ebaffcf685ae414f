"""Sharding by a minimax contiguous partition of atomic groups; DataFrame functions only."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import chunk_bits, chunk_of, order_hash, running
from .scratch import dropping, store

#: Groups of a chunk, which the driver gets together, and chunks that it keeps: 24 bytes for each of their groups.
GROUPS, CHUNKS = 65_536, 16


class GroupIndex:
    """Group sizes in the order of their keys: chunk totals on the driver, one chunk's groups at a time when asked for.

    There is one total for each 65,536 groups or so, and a chunk holds about as many groups, whatever the input. The table
    is sorted by chunk, so a chunk is read without the others.
    """

    def __init__(self, groups: DataFrame):
        self.groups = groups
        rows = groups.groupBy("chunk").agg(F.sum("bytes"), F.max("bytes")).orderBy("chunk").collect()
        self.chunks = [r[0] for r in rows]
        self.ends = list(accumulate(r[1] for r in rows))
        self.total, self.largest = (self.ends[-1] if rows else 0), max((r[2] for r in rows), default=0)
        self.fetched: dict[int, tuple] = {}

    def inside(self, at: int):
        """Running sums up to each group of a chunk, and the groups' keys: columns of numbers and of 16 bytes each."""
        found = self.fetched.pop(at, None)
        if found is None:
            rows = self.groups.where(F.col("chunk") == self.chunks[at]).select("k", "g", "bytes").toArrow().combine_chunks().sort_by([("k", "ascending"), ("g", "ascending")])
            sums = rows.column("bytes").to_numpy().cumsum() + (self.ends[at - 1] if at else 0)
            found = sums, rows.column("k"), rows.column("g")
        self.fetched[at] = found  # the one asked for last is kept longest
        if len(self.fetched) > CHUNKS:
            self.fetched.pop(next(iter(self.fetched)))
        return found

    def group(self, at: int, n: int) -> tuple[int, tuple]:
        sums, k, g = self.inside(at)
        return int(sums[n]), (k[n].as_py(), g[n].as_py())

    def last_until(self, limit: int) -> tuple[int, tuple | None]:
        """The end and key of the last group that ends at or before ``limit``."""
        at = bisect_right(self.ends, limit)
        if at < len(self.ends) and (n := int(self.inside(at)[0].searchsorted(limit, "right"))):
            return self.group(at, n - 1)
        return self.group(at - 1, -1) if at else (0, None)

    def end_until(self, limit: int) -> int:
        """The end of the last group that ends at or before ``limit``; a chunk is read only if the limit lies within it."""
        at = bisect_right(self.ends, limit)
        before = self.ends[at - 1] if at else 0
        if at == len(self.ends) or before == limit:
            return before
        n = int(self.inside(at)[0].searchsorted(limit, "right"))
        return int(self.inside(at)[0][n - 1]) if n else before

    def first_beyond(self, start: int) -> tuple[int, tuple]:
        """The end and key of the first group that ends after ``start``."""
        at = bisect_right(self.ends, start)
        return self.group(at, int(self.inside(at)[0].searchsorted(start, "right")))


def fits(index: GroupIndex, capacity: int, shards: int, start: int = 0) -> bool:
    """Whether greedy filling from ``start`` needs no more than ``shards`` shards."""
    for _ in range(shards):
        if start >= index.total:
            return True
        start = index.end_until(start + capacity)
    return start >= index.total


def minimax_cuts(index: GroupIndex, shards: int) -> tuple[int, list[tuple]]:
    """The smallest feasible capacity, and the key of the last group of each shard but the last non-empty one.

    Shards are cut at the group end nearest to an equal share of what is left, if the rest still fits.
    """
    low = max(-(-index.total // shards), index.largest)
    high = low + index.largest
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(index, middle, shards) else (middle + 1, high)
    cuts, start = [], 0
    for left in range(shards - 1, 0, -1):
        if start >= index.total:
            break
        target = start + min(low, -(-(index.total - start) // (left + 1)))
        under = index.last_until(target)
        over = index.first_beyond(max(under[0], start)) if under[0] < index.total else under
        options = [o for o in (under, over) if start < o[0] <= start + low and fits(index, low, left, o[0])]
        start, key = min(options, key=lambda o: abs(o[0] - target)) if options else index.last_until(start + low)
        cuts.append(key)
    return low, cuts


def shard(df: DataFrame, shards: int, size: Column, group: Column, carry: dict[str, Column], identity: list[str]) -> DataFrame:
    """Put rows into ``shards`` contiguous runs of atomic groups, the largest run as small as can be.

    ``size``: a positive long. ``group``: binary, a well-spread hash; rows that share it stay together. ``carry``:
    columns to return, none of them named shard or slot; ``identity``: those of them that order rows within a shard.
    Adds shard and slot (gapless from 0 in each shard). Equal rows get different slots in either order; an empty table gives an empty result.
    """
    if {"shard", "slot"} & set(carry):
        raise ValueError("shard and slot are added, so no carried column may have these names")
    names = {n: f"__rl_{i}" for i, n in enumerate(carry)}
    with dropping(df.sparkSession):
        rows = store(df.select(*(c.alias(names[n]) for n, c in carry.items()), size.alias("__rl_size"), group.alias("__rl_g")), "shard-rows", result=True)
        rows = rows.withColumn("__rl_k", F.conv(F.substring(F.hex("__rl_g"), 1, 15), 16, 10).cast("long"))
        groups = rows.groupBy(F.col("__rl_k").alias("k"), F.col("__rl_g").alias("g")).agg(F.sum("__rl_size").alias("bytes"))
        n = rows.count()
        bits = chunk_bits(n, GROUPS)
        groups = groups.withColumn("chunk", F.shiftright("k", 60 - bits) if bits else F.lit(0))
        groups = store(groups.repartitionByRange("chunk").sortWithinPartitions("chunk"), "shard-groups")
        _, cuts = minimax_cuts(GroupIndex(groups), shards)
    number = F.lit(0)
    for k, g in cuts:
        beyond = (F.col("__rl_k") > k) | ((F.col("__rl_k") == k) & (F.col("__rl_g") > F.lit(bytes(g))))
        number = number + F.when(beyond, 1).otherwise(0)
    identity = [names[n] for n in identity]
    rows = rows.withColumn("__rl_shard", number).withColumn("__rl_o", order_hash(F.concat_ws(":", *identity))).withColumn("__rl_c", chunk_of(F.col("__rl_o"), chunk_bits(n)))
    out = running(rows, ["__rl_shard"], "__rl_c", ["__rl_o", *identity], F.lit(1), "__rl_slot")
    return out.select(*(F.col(names[n]).alias(n) for n in carry), F.col("__rl_shard").alias("shard"), F.col("__rl_slot").cast("long").alias("slot"))


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` in 8 shards under the law ``bytes``; equal texts (null among themselves) stay together."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.col("text")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    marked = F.when(text.isNull(), F.lit("n")).otherwise(F.concat(F.lit("t"), text))
    group = F.substring(F.unhex(F.sha2(marked.cast("binary"), 256)), 1, 16)
    carry = {"doc_id": F.col("doc_id"), "size": size, "text_crc32": F.crc32(text.cast("binary"))}
    out = shard(docs, 8, size, group, carry, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _sql(shards: int = 8) -> str:
    def jumps(name: str, n: int, first: str, capacity: str) -> str:
        """The ends that greedy filling reaches in n steps."""
        found = [first, *(f"{name}j{i}.{name}{i}" for i in range(1, n + 1))]
        return "".join(f", LATERAL (SELECT coalesce(max(e), 0) AS {name}{i + 1} FROM ends WHERE e <= {found[i]} + {capacity}) AS {name}j{i + 1}" for i in range(n))

    reached = lambda name: "[" + ", ".join(f"{name}j{i}.{name}{i}" for i in range(1, shards)) + "][lft]"
    least = f"greatest((n + {shards - 1}) // {shards}, m)"
    return f"""
WITH RECURSIVE crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, {0xEDB88320}) ELSE a >> 1 END) AS v FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS rid, doc_id, text, CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS size, substr(sha256(coalesce('t' || text, 'n')), 1, 32) AS g, hex(encode(text)) AS x FROM documents),
crc AS (SELECT rid, xor(list_reduce(list_prepend({0xFFFFFFFF}, list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), {0xFFFFFFFF}) AS c FROM d, crc_table WHERE text IS NOT NULL),
groups AS (SELECT g, sum(size) AS b FROM d GROUP BY g),
ends AS MATERIALIZED (SELECT g, CAST(sum(b) OVER (ORDER BY g) AS BIGINT) AS e FROM groups),
total AS MATERIALIZED (SELECT CAST(sum(b) AS BIGINT) AS n, CAST(max(b) AS BIGINT) AS m FROM groups),
search(low, high) AS (SELECT {least}, {least} + m FROM total
  UNION ALL SELECT CASE WHEN xj{shards}.x{shards} >= n THEN low ELSE mid + 1 END, CASE WHEN xj{shards}.x{shards} >= n THEN mid ELSE high END
  FROM (SELECT low, high, (low + high) // 2 AS mid, n FROM search, total WHERE low < high) p{jumps("x", shards, "0", "mid")}),
cap AS MATERIALIZED (SELECT low AS c, n FROM search, total WHERE low = high),
cuts(lft, start) AS (SELECT {shards - 1}, CAST(0 AS BIGINT) UNION ALL
  SELECT lft - 1, CASE WHEN u_ok AND (NOT o_ok OR abs(u - goal) <= abs(o - goal)) THEN u WHEN o_ok THEN o ELSE most END FROM (
    SELECT lft, goal, u, o, most, u > start AND u <= start + c AND {reached("a")} >= n AS u_ok, o > start AND o <= start + c AND {reached("b")} >= n AS o_ok
    FROM (SELECT lft, start, c, n, start + least(c, (n - start + lft) // (lft + 1)) AS goal FROM cuts, cap WHERE lft > 0 AND start < n) q,
    LATERAL (SELECT coalesce(max(e), 0) AS u FROM ends WHERE e <= goal) AS uu, LATERAL (SELECT coalesce(min(e), uu.u) AS o FROM ends WHERE e > greatest(uu.u, start)) AS oo,
    LATERAL (SELECT coalesce(max(e), 0) AS most FROM ends WHERE e <= start + c) AS mm{jumps("a", shards - 1, "uu.u", "c")}{jumps("b", shards - 1, "oo.o", "c")})),
placed AS (SELECT doc_id, d.size, crc.c AS text_crc32, (SELECT count(*) FROM cuts WHERE lft < {shards - 1} AND start < e) AS shard FROM d JOIN ends USING (g) LEFT JOIN crc USING (rid))
SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY substr(md5(concat_ws(':', doc_id, text_crc32, size)), 1, 15), doc_id NULLS FIRST, text_crc32 NULLS FIRST, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM placed
"""


SQL = _sql()
