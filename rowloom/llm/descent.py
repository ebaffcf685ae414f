"""Approximate nearest neighbours: NN-descent builds a graph, queries search it greedily.

Each vector starts with the nearest of small blocks as neighbours: (parts of) its CELLS nearest coarse cells, and, for the
first round, a block dealt at random, so that the graph hangs together. In a round of NN-descent the neighbours of each vector, in both directions, are compared with each other, pairs of which neither is new
left out, and each is offered whatever is nearer than its farthest neighbour so far. Rounds go on until few offers are
taken. A round is done by blocks: vectors of a block have many neighbours in common, so a block fetches each vector that
its lists name once. So is a hop of the search, by shelves (a few blocks beside each other, so that a query travels to few): queries go to the shelves of the vectors that they meet. A query keeps its nearest WIDTH vectors found, from itself and a few entry points on (so that no
part of the graph is out of reach), looks up the neighbours of those it hasn't looked up yet, and goes on until none is
left. Rows with equal vectors are one point of the graph. Distances in the graph are in single precision, as they only
guide the search; those of the result are exact.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .minhash import grouped
from .scratch import dropping, store, together
from .vectors import CENTROIDS, as_matrix, codebook, distinct_vectors, sampled, squared

#: Neighbours kept of each vector, those that have it as one and are compared in a round, and rounds at most.
DEGREE, REVERSE, ROUNDS = 24, 16, 6
#: Offers taken, as a part of all neighbours, below which rounds end.
FEW = 0.05
#: Vectors of a coarse cell on average, of a block at most (on average, too), cells that each is put in, and neighbours
#: kept of a block dealt at random.
OCCUPANCY, BLOCK, CELLS, RANDOM = 128, 256, 2, 4
#: Vectors of a shelf of the search on average, and at most (on average, too). A query meets thousands of points in a hop, spread
#: over most shelves of a small table, and its vector travels to each: many more points on a shelf than in a block.
SHELF, FULL = 1024, 2048
#: Vectors a query keeps (all not yet looked up are looked up in one hop), and the points it begins from besides itself.
WIDTH, ENTRIES = 320, 32
#: Points beyond those asked for that are measured exactly, as the search adds up components in another order.
MORE = 8
#: Pairs compared at a time.
PAIRS = 1 << 21


def far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of ``a`` to those of ``b``, components added in their order; scaled where squares overflow or vanish."""
    d = b - a
    out = np.zeros(len(d))
    with np.errstate(over="ignore"):
        for x in d.T:
            out += x * x
    out = np.sqrt(out)
    top = np.abs(d).max(axis=1)
    for i in np.flatnonzero((top > 1e150) | (top < 1e-150) & (top > 0)):
        out[i] = np.sqrt(((d[i] / top[i]) ** 2).sum()) * top[i]
    return out


def near_enough(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As ``far``, but for the last digits."""
    d = b - a
    with np.errstate(over="ignore"):
        out = np.einsum("ij,ij->i", d, d)
    out = np.sqrt(out)
    if len(odd := np.flatnonzero((out > 1e150) | (out < 1e-140))):
        out[odd] = far(a[odd], b[odd])
    return out


def exact(batches, width: int):
    """(query, id, score) of rows with both vectors."""
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([b.column("query"), b.column("id"), pa.array(far(as_matrix(b.column("own"), width), as_matrix(b.column("vec"), width)))], ["query", "id", "score"])


def put(batches, centres: np.ndarray, shelves: np.ndarray, width: int):
    """(id, cell, turn, shelf): the CELLS nearest coarse cells of each vector, nearest first, and their shelves."""
    for b in batches:
        for at in range(0, b.num_rows, 1024):
            p = b.slice(at, 1024)
            d = squared(as_matrix(p.column("vec"), width), centres)
            k = min(CELLS, d.shape[1])
            near = np.argpartition(d, k - 1, axis=1)[:, :k]
            near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)
            yield pa.RecordBatch.from_arrays([p.column("id").take(pa.array(np.repeat(np.arange(p.num_rows), k))), pa.array(near.ravel().astype(np.int64)), pa.array(np.tile(np.arange(k), p.num_rows).astype(np.int32)), pa.array(shelves[near.ravel()].astype(np.int64))], ["id", "cell", "turn", "shelf"])


def single(column: pa.Array, width: int, centre: np.ndarray | None = None) -> np.ndarray:
    """Vectors in single precision, around ``centre`` (their mean, if not given), so that differences of near ones keep digits."""
    m = as_matrix(column, width)
    top = np.abs(m).max(initial=0)
    m = m / top if top > 1e15 or 0 < top < 1e-15 else m  # squares must fit
    return (m - (m.mean(0) if centre is None else centre)).astype(np.float32)


def best(u: np.ndarray, v: np.ndarray, d: np.ndarray, new: np.ndarray, k: int):
    """The k nearest (u, v, d, new) of each u, each v once (as not new if it is both)."""
    order = np.lexsort((d, new, v, u))
    u, v, d, new = u[order], v[order], d[order], new[order]
    once = np.ones(len(u), bool)
    once[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    u, v, d, new = u[once], v[once], d[once], new[once]
    order = np.lexsort((v, d, u))
    u, v, d, new = u[order], v[order], d[order], new[order]
    first = np.flatnonzero(np.append(True, u[1:] != u[:-1])) if len(u) else np.zeros(0, np.int64)
    rank = np.arange(len(u)) - np.repeat(first, np.diff(np.append(first, len(u))))
    return u[rank < k], v[rank < k], d[rank < k], new[rank < k]


EDGES = "u long, v long, d float, new boolean"


def edges(u, v, d, new) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(d, pa.float32()), pa.array(new, pa.bool_())], ["u", "v", "d", "new"])


def nearest_inside(batches, width: int):
    """The nearest of each vector within its block: DEGREE, or RANDOM in one dealt at random (turn -1)."""
    for g in grouped(batches, ["block"]):
        ids, m = g.column("id").to_numpy(), single(g.column("vec"), width)
        dealt = g.column("turn")[0].as_py() < 0
        k = min(RANDOM if dealt else DEGREE, len(ids) - 1)
        for at in range(0, len(ids) if k > 0 else 0, 512):
            d = squared(m[at : at + 512], m)
            d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
            near = np.argpartition(d, k - 1, axis=1)[:, :k]
            yield edges(np.repeat(ids[at : at + 512], k), ids[near].ravel(), np.take_along_axis(d, near, 1).ravel(), np.full(near.size, not dealt))


def join_around(batches, width: int):
    """Offers (u, v, d): pairs among the neighbours of each centre of a block, one of them new, where v is nearer to u than u's
    farthest neighbour so far. Rows of a block: vectors with their limits, and centres with their lists."""
    for g in grouped(batches, ["block"]):
        listed = g.column("near").is_valid()
        points, near = g.filter(pc.invert(listed)), g.filter(listed).column("near")
        ids, limit, m = points.column("id").to_numpy(), points.column("limit").to_numpy(), single(points.column("vec"), width)
        order = np.argsort(ids)
        size = np.diff(np.asarray(near.offsets))
        flat = near.flatten()
        at = order[np.searchsorted(ids[order], flat.field("id").to_numpy())]
        place = np.full((len(size), max(size, default=0)), -1)
        fresh = np.zeros(place.shape, bool)
        spot = np.arange(place.shape[1])[None] < size[:, None]
        place[spot], fresh[spot] = at, flat.field("new").to_numpy(zero_copy_only=False)
        square = (m * m).sum(1)
        found = []
        for start in range(0, len(place), max(1, PAIRS // max(1, place.shape[1] ** 2))):
            p, f = (x[start : start + max(1, PAIRS // max(1, place.shape[1] ** 2))] for x in (place, fresh))
            d = square[p][:, :, None] + square[p][:, None, :] - 2 * (m[p] @ m[p].transpose(0, 2, 1))
            ok = (p[:, :, None] != p[:, None, :]) & (p >= 0)[:, :, None] & (p >= 0)[:, None, :] & (f[:, :, None] | f[:, None, :]) & (d < limit[p][:, :, None])
            c, i, j = np.nonzero(ok)
            found.append((p[c, i], p[c, j], np.maximum(d[c, i, j], 0)))
        if found:
            u, v, d = (np.concatenate(x) for x in zip(*found, strict=True))
            yield edges(*best(ids[u], ids[v], d, np.ones(len(u), bool), DEGREE))


def merge(batches):
    """The DEGREE nearest of each u among its neighbours so far and what it is offered."""
    held = None

    def kept(t: pa.Table) -> pa.RecordBatch:
        return edges(*best(*(t.column(c).to_numpy() for c in ("u", "v", "d", "new")), DEGREE))

    for b in batches:
        if b.num_rows:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])]).combine_chunks()
            u = t.column("u").to_numpy()
            cut = int(np.searchsorted(u, u[-1]))  # the last u may go on in the next batch
            if cut:
                yield kept(t.slice(0, cut))
            held = t.slice(cut)
    if held is not None:
        yield kept(held)


def nearest(edges: DataFrame, of: str, k: int) -> DataFrame:
    """The k nearest edges of each ``of``; Spark drops those beyond the k-th before it deals rows out too."""
    other = "v" if of == "u" else "u"
    return edges.withColumn("__rl_r", F.row_number().over(W.partitionBy(of).orderBy("d", other))).where(F.col("__rl_r") <= k).drop("__rl_r")


def build_graph(points: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """EDGES: near neighbours v of each point u of (id, digest, vec); and (id, vec, block, shelf), block its part of its nearest cell, shelf its part
    of the neighbouring cells that the search takes together."""
    n = points.count()
    centres = codebook(sampled(points, width), min(CENTROIDS, max(1, n // OCCUPANCY)))
    shelves = squared(centres, codebook(centres, max(1, n // SHELF))).argmin(1)
    cells = store(points.select("id", "vec").mapInArrow(lambda it: put(it, centres, shelves, width), "id long, cell long, turn int, shelf long"), "graph-cells")
    parts = cells.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    blocks = cells.join(parts, "cell").select("id", F.xxhash64("cell", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block"), "turn")
    nearby = cells.where("turn = 0")
    boards = nearby.groupBy("shelf").agg(F.ceil(F.count("*") / FULL).alias("boards"))
    shelved = nearby.join(boards, "shelf").select("id", F.xxhash64("shelf", F.pmod(F.xxhash64(F.lit(11), "id"), F.col("boards"))).alias("shelf"))
    home = store(points.select("id", "vec").join(blocks.where("turn = 0").drop("turn"), "id").join(shelved, "id"), "graph-blocks")
    dealt = points.select("id", F.xxhash64(F.lit(-1), F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(-(-n // BLOCK) or 1))).alias("block"), F.lit(-1).alias("turn"))
    rows = blocks.unionByName(dealt).join(points.select("id", "vec"), "id")
    first = store(together(rows, ["block"]).mapInArrow(lambda it: nearest_inside(it, width), EDGES), "graph-first")
    graph = store(together(first.where("new"), ["u"]).mapInArrow(merge, EDGES), "graph")
    beside = first.where("not new").withColumn("new", F.lit(True))
    for k in range(ROUNDS):
        graph = descend(graph, home, width, beside if k == 0 else None)
        if graph.where("new").count() <= FEW * DEGREE * n:
            break
    return graph, home


def descend(graph: DataFrame, home: DataFrame, width: int, beside: DataFrame | None) -> DataFrame:
    """One round; ``beside`` has more edges for it."""
    with dropping(graph.sparkSession):
        there = graph.select(F.col("u").alias("id"), F.col("v").alias("of"), "new")
        back = nearest(graph, "v", REVERSE).select(F.col("v").alias("id"), F.col("u").alias("of"), "new")
        more = [] if beside is None else [beside.select(F.col(a).alias("id"), F.col(b).alias("of"), "new") for a, b in ("uv", "vu")]
        lists = reduce(DataFrame.unionByName, [there, back, *more]).groupBy("id").agg(F.collect_list(F.struct(F.col("of").alias("id"), "new")).alias("near"))
        lists = store(lists.join(home.select("id", "block"), "id").select("block", "near"), "graph-lists")
        wanted = lists.select("block", F.explode("near.id").alias("id")).distinct()
        limits = graph.groupBy(F.col("u").alias("id")).agg(F.when(F.count("*") == DEGREE, F.max("d")).alias("limit"))
        known = home.select("id", "vec").join(limits, "id", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf")).cast("float")))
        rows = wanted.join(known, "id").select("block", "id", "vec", "limit", F.lit(None).cast(lists.schema["near"].dataType).alias("near"))
        none = lambda c: F.lit(None).cast(rows.schema[c].dataType).alias(c)
        dealt = together(rows.unionByName(lists.select("block", none("id"), none("vec"), none("limit"), "near")), ["block"])
        offers = dealt.mapInArrow(lambda it: join_around(it, width), EDGES)
        both = graph.withColumn("new", F.lit(False)).unionByName(offers)
        return store(together(both, ["u"]).mapInArrow(merge, EDGES), "graph", result=True)


def scored(batches, width: int):
    """(query, node, d): how far each query is from the points that it meets on a shelf, the WIDTH nearest of them. Rows of a
    shelf: vectors of its points (node), vectors of queries, and which meet."""
    for g in grouped(batches, ["shelf"]):
        has = {c: g.column(c).is_valid().to_numpy(zero_copy_only=False) for c in ("query", "node")}
        part = lambda query, node: g.filter(pa.array((has["query"] == query) & (has["node"] == node)))  # noqa: B023, E731
        points, queries, met = part(False, True), part(True, False), part(True, True)
        sides = []
        for t, c in ((queries, "query"), (points, "node")):
            ids = t.column(c).to_numpy()
            order = np.argsort(ids)
            sides.append((as_matrix(t.column("vec"), width), order[np.searchsorted(ids[order], met.column(c).to_numpy())]))
        (q, qi), (p, pi) = sides
        d = np.concatenate([near_enough(q[qi[at : at + 4096]], p[pi[at : at + 4096]]) for at in range(0, len(qi), 4096)]) if len(qi) else np.zeros(0)
        u, v = met.column("query").to_numpy(), met.column("node").to_numpy()
        order = np.lexsort((v, d, u))
        u, v, d = u[order], v[order], d[order]
        first = np.flatnonzero(np.append(True, u[1:] != u[:-1])) if len(u) else np.zeros(0, np.int64)
        keep = np.arange(len(u)) - np.repeat(first, np.diff(np.append(first, len(u)))) < WIDTH
        u, v, d = u[keep], v[keep], d[keep]
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(d, pa.float64())], ["query", "node", "d"])


def step(batches):
    """One hop of each query: its state (found) and the points it met, the nearest first; those not looked up yet are the front."""
    for g in grouped(batches, ["query"]):
        state = g.column("ids").is_valid().to_numpy(zero_copy_only=False)
        old, met = g.filter(pa.array(state)).to_pylist()[0], g.filter(pa.array(~state))
        node, far_off = met.column("node").to_numpy(), met.column("d").to_numpy()
        fresh = np.flatnonzero(~np.isin(node, np.array(old["ids"], np.int64)))
        fresh = fresh[np.unique(node[fresh], return_index=True)[1]]
        ids, d = np.concatenate([np.array(old["ids"], np.int64), node[fresh]]), np.concatenate([np.array(old["ds"], float), far_off[fresh]])
        done = np.concatenate([np.array(old["done"], bool), np.zeros(len(fresh), bool)])
        order = np.lexsort((ids, d))[:WIDTH]
        ids, d, done = ids[order], d[order], done[order]
        front = np.flatnonzero(~done)
        done[front] = True
        one = lambda x, t: pa.array([x.tolist()], pa.list_(t))
        yield pa.RecordBatch.from_arrays([g.column("query").slice(0, 1), one(ids, pa.int64()), one(d, pa.float64()), one(done, pa.bool_()), one(ids[front], pa.int64())], ["query", "ids", "ds", "done", "front"])


STATE = "query long, ids array<long>, ds array<double>, done array<boolean>, front array<long>"


def search_graph(graph: DataFrame, home: DataFrame, queries: DataFrame, entries: list[int], width: int) -> DataFrame:
    """(query, ids, ds): the nearest points found of each point in ``queries`` (id), itself left out; nearest first."""
    both = graph.select("u", "v").unionByName(nearest(graph, "v", DEGREE).select(F.col("v").alias("u"), F.col("u").alias("v")))
    placed = home.select(F.col("id").alias("node"), "shelf")
    around = both.join(placed.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.collect_set(F.struct(F.col("v").alias("node"), "shelf")).alias("around"))
    around = store(around, "graph-around")
    asked = store(home.join(queries, "id").select(F.col("id").alias("query"), F.col("vec").alias("vec")), "search-queries")
    state = asked.select("query", *(F.array().cast(f"array<{t}>").alias(c) for c, t in (("ids", "long"), ("ds", "double"), ("done", "boolean"))), F.array("query").alias("front"))
    first = asked.select("query", F.explode(F.array(*map(F.lit, entries)).cast("array<long>")).alias("node")).join(placed, "node").select("query", "node", "shelf")
    while True:
        # a point met before is in the state, or farther than all that is
        met = state.select("query", F.explode("front").alias("u")).join(around, "u").select("query", F.inline("around"))
        if first is not None:
            met, first = met.unionByName(first), None
        met = store(met.where("node <> query").distinct().select("shelf", "query", "node"), "search-met")
        none = F.lit(None)
        points = home.join(met.select(F.col("node").alias("id")).distinct(), "id", "left_semi").select("shelf", none.cast("long").alias("query"), F.col("id").alias("node"), "vec")
        coming = met.select("shelf", "query").distinct().join(asked, "query").select("shelf", "query", none.cast("long").alias("node"), "vec")
        rows = met.withColumn("vec", none.cast("binary")).unionByName(points).unionByName(coming)
        found = together(rows, ["shelf"]).mapInArrow(lambda it: scored(it, width), "query long, node long, d double")
        found = found.select("query", "node", "d", *(none.cast(f"array<{t}>").alias(c) for c, t in (("ids", "long"), ("ds", "double"), ("done", "boolean"))))
        before = state.select("query", none.cast("long").alias("node"), none.cast("double").alias("d"), "ids", "ds", "done")
        state = store(together(found.unionByName(before), ["query"]).mapInArrow(step, STATE), "search")
        if state.where(F.size("front") > 0).isEmpty():
            return state.select("query", "ids", "ds")


def neighbours(df: DataFrame, queries, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found (all, if there are fewer) of each row of (vec_id, embedding) for
    which the condition ``queries`` holds, other than rows of its own id; ties go to the smaller id. k is at most ENTRIES - 1,
    so that the entry points alone are enough.

    Null, zero and non-finite vectors and rows without an id take no part. Equal rows count as one.
    """
    if k >= ENTRIES:
        raise ValueError("k must be less than the number of entry points")
    with dropping(df.sparkSession):
        return store(_neighbours(df, queries, k), "neighbours", result=True)


def _neighbours(df: DataFrame, queries, k: int) -> DataFrame:
    rows, points, width = distinct_vectors(df.where("vec_id is not null"))
    rows = rows.where("digest is not null").select(F.col("rank").alias("vec_id"), "digest").distinct()
    ids = points.select("digest", "id")
    asked = store(rows.where(queries).join(ids, "digest").select("vec_id", "id"), "asked")
    graph, home = build_graph(points, width)
    entries = [r[0] for r in points.orderBy("digest").select("id").limit(ENTRIES).collect()]
    found = search_graph(graph, home, asked.select("id").distinct(), entries, width)
    found = found.select("query", F.explode(F.slice("ids", 1, k + MORE)).alias("id"))
    vectors = home.select("id", "vec")
    found = found.join(vectors.withColumnsRenamed({"id": "query", "vec": "own"}), "query").join(vectors, "id").select("query", "id", "own", "vec")
    found = found.mapInArrow(lambda it: exact(it, width), "query long, id long, score double")
    found = found.unionByName(asked.select(F.col("id").alias("query"), "id", F.lit(0.0).alias("score")).distinct())
    # of rows with equal vectors, the k + 1 with the least ids are enough; few of them stay in each part of the table
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(64))
    some = rows.withColumn("s", salt).withColumn("r", F.row_number().over(W.partitionBy("digest", "s").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    some = some.withColumn("r", F.row_number().over(W.partitionBy("digest").orderBy("vec_id"))).where(F.col("r") <= k + 1).join(ids, "digest").select("id", "vec_id")
    near = found.join(some, "id").join(asked.select(F.col("vec_id").alias("query_id"), F.col("id").alias("query")), "query").where("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest of each of ``embeddings`` whose vec_id is divisible by 100."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return neighbours(df, "vec_id % 100 = 0", 10)


SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL),
ok AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda a, b: a + b)) AS score FROM ok q JOIN ok c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM d)
SELECT * FROM r WHERE rank <= 10
"""
