"""Embedding near-dedup by an inverted multi-index.

Unit vectors are cut in halves, each half is assigned to the nearest centroid of its own codebook, and the pair of
centroids is the vector's cell. A vector visits cells in the order of the sum of its two distances, as the
multi-sequence algorithm does: among halves sorted by distance, the t nearest pairs (i, j) have (i + 1) * (j + 1) <= t.
How many it visits is measured: QUERIES vectors that (in larger tables) didn't fit the codebooks are compared with all
rows, and of their true links all but MISSED share a visited cell, on one side or the other, both of all links together
and on average over vectors, so that neither large groups nor small ones decide alone. Neighbours made at just the
similarity asked for, in random directions, are a lower bound, for tables whose queries have few links. What meets in a
cell is verified exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .minhash import grouped
from .scratch import dropping, store, together
from .substrings import LAST
from .vectors import CENTROIDS, as_matrix, codebook, distinct_vectors, sampled, squared

#: Vectors of a cell on average, and the most of a cell that one task holds against the most that visit it.
OCCUPANCY, BLOCK, VISITORS = 512, 4096, 16_384
MISSED = 0.0005
#: Sampled vectors for which a neighbour is made, those compared with all rows, and the links of one with 1024 rows that
#: are ranked (evenly chosen, they stand for the others).
TRIALS, QUERIES, RANKED = 4000, 2000, 16
#: Sums of distances held at once in ranking.
HELD = 1 << 22


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


class Grid:
    def __init__(self, sample: np.ndarray, rows: int, least: float):
        self.half = sample.shape[1] // 2
        k = max(1, min(CENTROIDS, round((rows / OCCUPANCY) ** 0.5)))
        self.one = codebook(sample[:, : self.half], k) if self.half else np.zeros((1, 0))
        self.two = codebook(sample[:, self.half :], k)
        self.visits, self.places = 1, None
        some = sample[:: max(1, len(sample) // TRIALS)]
        rng = np.random.default_rng(5)
        off = rng.standard_normal(some.shape)
        off -= (off * some).sum(1, keepdims=True) * some
        off /= np.maximum(np.sqrt((off * off).sum(1, keepdims=True)), 1e-300)
        near = least * some + (1 - least * least) ** 0.5 * off
        ranks = np.sort(np.minimum(self.rank(some, self.cells(near)), self.rank(near, self.cells(some))))
        self.visits = int(ranks[min(len(ranks) - 1, int(len(ranks) * (1 - MISSED)))]) + 1

    def distances(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return squared(m[:, : self.half], self.one), squared(m[:, self.half :], self.two)

    def cells(self, m: np.ndarray) -> np.ndarray:
        a, b = self.distances(m)
        return a.argmin(1) * len(self.two) + b.argmin(1)

    def rank(self, m: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How many cells each row visits before the one given: for each half of the first kind, the halves of the second that
        are near enough are counted in their sorted distances."""
        out = np.zeros(len(m), np.int64)
        for at in range(0, len(m), 256):
            a, b = self.distances(m[at : at + 256])
            i, j = np.divmod(cells[at : at + 256], len(self.two))
            rows = np.arange(len(a))
            limit = a[rows, i] + b[rows, j]
            b.sort(axis=1)
            for r in rows:
                out[at + r] = np.searchsorted(b[r], limit[r] - a[r][a[r] < limit[r]]).sum()
        return out

    def visited(self, m: np.ndarray) -> np.ndarray:
        """The cells each row visits, its own among them."""
        t = min(self.visits, len(self.one) * len(self.two))
        if self.places is None or self.places[0] != t:
            width = [min(t // (i + 1), len(self.two)) for i in range(min(t, len(self.one)))]
            self.places = t, np.repeat(np.arange(len(width)), width), np.concatenate([np.arange(w) for w in width])
        _, i, j = self.places
        out = np.empty((len(m), t), np.int64)
        step = max(1, HELD // len(i))
        for at in range(0, len(m), step):
            a, b = self.distances(m[at : at + step])
            oa, ob = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
            sums = np.take_along_axis(a, oa, 1)[:, i] + np.take_along_axis(b, ob, 1)[:, j]
            best = np.argsort(sums, axis=1, kind="stable")[:, :t]
            out[at : at + step] = np.take_along_axis(oa, i[best], 1) * len(self.two) + np.take_along_axis(ob, j[best], 1)
        return out


def rounded(ranks: np.ndarray) -> np.ndarray:
    """Ranks beyond 64 rounded up to steps of 2 %, so that a table of them is short."""
    steps = np.ceil(64 * 1.02 ** np.ceil(np.log(np.maximum(ranks, 64) / 64) / np.log(1.02) - 1e-9))
    return np.where(ranks <= 64, ranks, np.maximum(ranks, steps)).astype(np.int64)


def ranked(batches, grid: Grid, width: int, queries: np.ndarray, ids: np.ndarray, least: float):
    """(query, rank, links): links of the queries with these rows, by the cells that either side visits before they meet."""
    own = grid.cells(queries)
    for b in batches:
        for at in range(0, b.num_rows, 1024):
            p = b.slice(at, 1024)
            m = unit(as_matrix(p.column("vec"), width))
            hits = queries @ m.T >= least
            hits &= ids[:, None] != p.column("id").to_numpy()[None]
            q, x, n = [], [], []
            for k in np.flatnonzero(hits.any(1)):
                every = np.flatnonzero(hits[k])
                some = every[np.unique(np.linspace(0, len(every) - 1, RANKED).astype(int))]
                q.append(np.full(len(some), k)), x.append(some), n.append(np.full(len(some), len(every) / len(some)))
            if q:
                q, x = np.concatenate(q), np.concatenate(x)
                ranks = np.minimum(grid.rank(queries[q], grid.cells(m)[x]), grid.rank(m[x], own[q]))
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(rounded(ranks)), pa.array(np.concatenate(n))], ["query", "rank", "links"])


def needed_visits(distinct: DataFrame, grid: Grid, width: int, least: float) -> int:
    """Visits by which all but MISSED of the true links of QUERIES vectors meet."""
    rows = distinct.orderBy(F.desc("digest")).select("id", "vec").limit(QUERIES).collect()
    ids, queries = np.array([r[0] for r in rows]), unit(as_matrix(pa.array([bytes(r[1]) for r in rows], pa.binary()), width))
    found = distinct.select("id", "vec").mapInArrow(lambda it: ranked(it, grid, width, queries, ids, least), "query long, rank long, links double")
    found = store(found.groupBy("query", "rank").agg(F.sum("links").alias("links")), "grid-ranks")
    share = F.col("links") / F.col("all")
    table = found.join(found.groupBy("query").agg(F.sum("links").alias("all")), "query").groupBy("rank").agg(F.sum("links"), F.sum(share)).orderBy("rank").collect()
    if not table:
        return 1
    ranks, sums = np.array([r[0] for r in table]), np.cumsum([r[1:] for r in table], axis=0)
    return 1 + max(int(ranks[np.flatnonzero(s >= (1 - MISSED) * s[-1] - 1e-9)[0]]) for s in sums.T)


def place(batches, grid: Grid, width: int):
    for b in batches:
        for at in range(0, b.num_rows, 1024):
            p = b.slice(at, 1024)
            m = unit(as_matrix(p.column("vec"), width))
            v = grid.visited(m)
            visits = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([p.column("id"), p.column("copies"), p.column("vec"), pa.array(grid.cells(m)), visits], ["id", "copies", "vec", "cell", "visits"])


def met(batches, least: float, width: int):
    """Links of those in a cell with those that visit it: (a, null, links) to count, (a, b, 0) to join components.

    A link is counted for the visitor, and for the other too unless that one visits the visitor's cell and counts itself.
    """
    for g in grouped(batches, ["cell", "block", "turn"]):
        visitor = g.column("visits").is_null().to_numpy(zero_copy_only=False)
        here, there = g.filter(pa.array(~visitor)), g.filter(pa.array(visitor))
        if not here.num_rows or not there.num_rows:
            continue
        m, ids, copies = unit(as_matrix(here.column("vec"), width)), here.column("id").to_numpy(), here.column("copies").to_numpy()
        back = np.zeros(len(ids), np.int64)
        other, times, own = there.column("id").to_numpy(), there.column("copies").to_numpy(), there.column("own").to_numpy()
        visits = np.asarray(here.column("visits").flatten()).reshape(len(ids), -1)  # all rows visit as many cells
        root = np.arange(len(ids))
        a, b, n = [], [], []
        for at in range(0, len(other), 512):
            q = slice(at, at + 512)
            hits = unit(as_matrix(there.column("vec").slice(at, 512), width)) @ m.T >= least
            hits &= other[q][:, None] != ids[None]
            for x in np.flatnonzero(hits.any(1)):
                own_hits = np.flatnonzero(hits[x])
                a.append(other[at + x]), b.append(None), n.append(int(copies[own_hits].sum()))
                if (roots := np.unique(root[own_hits])).size > 1:
                    root[np.isin(root, roots)] = roots[0]
                    for r in roots[1:]:
                        a.append(int(ids[r])), b.append(int(ids[roots[0]])), n.append(0)
                a.append(other[at + x]), b.append(int(ids[roots[0]])), n.append(0)
                back[own_hits[(visits[own_hits] != own[at + x]).all(axis=1)]] += times[at + x]
        for y in np.flatnonzero(back):
            a.append(ids[y]), b.append(None), n.append(int(back[y]))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])


def near_vectors(df: DataFrame, least: float) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding); links have cosine >= ``least``.

    Rows with equal vectors are one point that stands for all. Null, zero and non-finite vectors link with nothing and
    are their own component. Rows that share an id are told apart by their vectors alone.
    """
    with dropping(df.sparkSession):
        return store(_near_vectors(df, least), "grid-classes", result=True)


def _near_vectors(df: DataFrame, least: float) -> DataFrame:
    rows, distinct, width = distinct_vectors(df)
    n = distinct.count()
    known = lambda c: F.when(F.col(c) < LAST, F.col(c))
    if not n:
        return rows.select(known("rank").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), known("rank").alias("component_id"), F.lit(True).alias("kept"))
    grid = Grid(unit(sampled(distinct, width)), n, least)
    grid.visits = max(grid.visits, needed_visits(distinct, grid, width, least))
    points = store(distinct.select("id", "copies", "vec").mapInArrow(lambda it: place(it, grid, width), "id long, copies long, vec binary, cell long, visits array<long>"), "grid-points")
    arrive = points.select("id", "copies", "vec", F.col("cell").alias("own"), F.explode("visits").alias("cell"))
    full = points.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    come = points.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("turns"))
    split = store(full.join(come, "cell"), "grid-cells")
    part = lambda of: F.pmod(F.xxhash64("id"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    here = points.join(split, "cell").withColumn("block", part("blocks")).withColumn("turn", every("turns")).withColumn("own", F.col("cell"))
    there = arrive.join(split, "cell").withColumn("turn", part("turns")).withColumn("block", every("blocks")).withColumn("visits", F.lit(None).cast("array<long>"))
    columns = ["cell", "block", "turn", "id", "copies", "vec", "own", "visits"]
    dealt = together(here.select(columns).unionByName(there.select(columns)), ["cell", "block", "turn"])
    found = store(dealt.mapInArrow(lambda it: met(it, least, width), "a long, b long, n long"), "grid-links")
    count = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    parts = components(found.where("b is not null").select("a", "b").distinct()).withColumnRenamed("node", "id")
    each = distinct.select("id", "digest", "first", "copies").join(count, "id", "left").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least_of = each.groupBy("component").agg(F.min("first").alias("component_id"))
    each = each.join(least_of, "component").select("digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.join(each, "digest", "left").select("rank", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "rank").alias("component_id"))
    return out.select(known("rank").alias("vec_id"), F.col("n_links").cast("long").alias("n_links"), known("component_id").alias("component_id"), (F.col("rank") == F.col("component_id")).alias("kept"))


def op1_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Links of cosine 0.9 and more among all ``embeddings``."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), 0.9)


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT v.vec_id, CAST((SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS BIGINT) AS n_links, comp.c AS component_id, v.vec_id = comp.c AS kept
FROM v JOIN comp ON comp.a = v.vec_id
"""
