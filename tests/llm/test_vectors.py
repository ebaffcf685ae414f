import math

import numpy as np
import pytest

from rowloom.llm import descent, multiindex
from rowloom.llm.descent import neighbours, op7_nearest_neighbours
from rowloom.llm.multiindex import Grid, near_vectors, op1_embedding_near_dedup, unit


def table(spark, tmp_path, rows, extra="'clash' as id, 7 as copies, 'x' as cell, 1 as n_links"):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", extra.split(",")[0], *[x.strip() for x in extra.split(",")[1:]])
    df.repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def vectors(seed=2, n=260, dim=16):
    rng = np.random.default_rng(seed)
    m = rng.standard_normal((n, dim)).astype(np.float32)
    for i in range(20, 60):  # near copies of one, around the limit
        m[i] = m[0] * 3 + rng.standard_normal(dim).astype(np.float32) * (0.2 + 0.05 * (i - 20))
    for i in range(60, 90):  # exact copies of another
        m[i] = m[7]
    rows = [(i, m[i].tolist(), i % 3) for i in range(n)]
    rows += [(None, m[0].tolist(), 1), (500, None, 1), (501, [0.0] * dim, 1), (502, [math.nan, *[1.0] * (dim - 1)], None), (503, [math.inf, *[1.0] * (dim - 1)], 1), (504, [None, *[1.0] * (dim - 1)], 1), (505, [], 1), (506, [1.0, 2.0], 1), (600, m[5].tolist(), 1), (600, m[5].tolist(), 1)]
    return rows


def good(rows):
    dim = 16
    return [(i, np.array(v, float)) for i, v, _ in rows if v is not None and len(v) == dim and None not in v and np.isfinite(v).all() and np.any(v)]


def brute_links(rows, least=0.9):
    ok = good(rows)
    m = np.array([v / np.linalg.norm(v) for _, v in ok])
    hit = m @ m.T >= least
    np.fill_diagonal(hit, False)
    label = np.arange(len(ok))
    while True:
        new = np.array([min(label[hit[i]].min(initial=label[i]), label[i]) for i in range(len(ok))])
        if (new == label).all():
            break
        label = new
    least_id = {k: min((i for (i, _), x in zip(ok, label) if x == k and i is not None), default=None) for k in set(label)}
    out = [(i, int(hit[k].sum()), least_id[label[k]]) for k, (i, _) in enumerate(ok)]
    rest = list(rows)
    for i, v in ok:
        rest.remove(next(r for r in rest if r[0] == i and r[1] is not None and len(r[1]) == 16 and np.array_equal(np.array(r[1], float), v)))
    return out + [(i, 0, i) for i, *_ in rest]


@pytest.mark.parametrize("block", [4096, 8])
def test_links(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(multiindex, "BLOCK", block)
    monkeypatch.setattr(multiindex, "VISITORS", block)
    rows = vectors()
    out = op1_embedding_near_dedup(spark, table(spark, tmp_path, rows)).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in out), key=key) == sorted(brute_links(rows), key=key)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)


def test_links_in_a_grid_of_many_cells(spark, monkeypatch):
    monkeypatch.setattr(multiindex, "OCCUPANCY", 20)
    rng = np.random.default_rng(4)
    m = rng.standard_normal((1500, 32)).astype(np.float32)
    near = m[:500] / np.linalg.norm(m[:500], axis=1)[:, None] + rng.standard_normal((500, 32)).astype(np.float32) * 0.07
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([m, near]))]
    out = {r["vec_id"]: r["n_links"] for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 0.9).collect()}
    u = np.vstack([m, near]).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    hit = (u @ u.T >= 0.9).sum(1) - 1
    found = sum(out.values()) / hit.sum()
    assert hit.sum() > 500 and found >= 0.99 and all(out[i] <= hit[i] for i in out)


def test_links_of_vectors_near_a_subspace(spark, monkeypatch):
    """Neighbours differ within the subspace, as those of trained embeddings do, so they lie across cell borders."""
    monkeypatch.setattr(multiindex, "OCCUPANCY", 20)
    rng = np.random.default_rng(9)
    m = (rng.standard_normal((4000, 8)) @ rng.standard_normal((8, 128)) + 0.05 * rng.standard_normal((4000, 128))).astype(np.float32)
    out = {r["vec_id"]: r["n_links"] for r in near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>"), 0.9).collect()}
    u = m.astype(float) / np.linalg.norm(m.astype(float), axis=1)[:, None]
    hit = (u @ u.T >= 0.9).sum(1) - 1
    assert hit.sum() > 5000 and sum(out.values()) >= 0.998 * hit.sum() and all(out[i] <= hit[i] for i in out)


def test_visits_are_the_nearest_cells():
    rng = np.random.default_rng(1)
    sample = unit(rng.standard_normal((900, 12)))
    grid = Grid(sample, 40_000, 0.9)
    some = unit(rng.standard_normal((50, 12)))
    a, b = grid.distances(some)
    for v, x, y in zip(grid.visited(some), a, b, strict=True):
        sums = (x[:, None] + y[None]).ravel()
        assert len(set(v)) == len(v) and np.allclose(np.sort(sums[v]), np.sort(sums)[: len(v)])


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(3, [1.0, 0.0], 1), (2, [2.0, 0.0], 1)]])
def test_tiny_links(spark, tmp_path, rows):
    out = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in op1_embedding_near_dedup(spark, table(spark, tmp_path, rows)).collect()}
    assert out == {1: (0, 1, True)} if len(rows) == 1 else out == ({} if not rows else {3: (1, 2, False), 2: (1, 2, True)})


def test_neighbours(spark, tmp_path):
    rows = vectors()
    out = op7_nearest_neighbours(spark, table(spark, tmp_path, rows)).collect()
    ok = list({(i, v.tobytes()): (i, v) for i, v in good(rows) if i is not None}.values())
    by = {}
    for r in out:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == {i for i, _ in ok if i % 100 == 0}
    hits = total = 0
    for q, found in by.items():
        own = next(v for i, v in ok if i == q)
        exact = sorted((math.dist(own, v), i) for i, v in ok if i != q)
        found.sort()
        assert [r for r, *_ in found] == list(range(1, 11))
        assert [(s, i) for _, i, s in found] == sorted((s, i) for _, i, s in found)
        assert all(s == pytest.approx(dict((i, d) for d, i in exact)[i], rel=1e-12) for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for _, i in exact[:10]})
        total += 10
    assert hits / total >= 0.9


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_few_vectors(spark, n):
    rows = [(i * 100, [float(i), 1.0]) for i in range(n)]
    out = neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 100 = 0", 10).collect()
    assert len(out) == n * max(0, n - 1)
    for r in out:
        assert r["score"] == abs(r["query_id"] - r["vec_id"]) / 100


def test_recall_on_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(descent, "OCCUPANCY", 60)
    monkeypatch.setattr(descent, "BLOCK", 100)
    rng = np.random.default_rng(3)
    m = rng.standard_normal((1500, 24)).astype(np.float32)
    out = neighbours(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>"), "vec_id % 100 = 0", 10).collect()
    hits = 0
    for q in range(0, 1500, 100):
        d = np.linalg.norm(m.astype(float) - m[q], axis=1)
        d[q] = np.inf
        hits += len({r["vec_id"] for r in out if r["query_id"] == q} & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.9 * 150


def test_a_query_travels_to_few_shelves(spark, monkeypatch):
    """Shelves of the search grow with the table as its blocks do, but there are far fewer of them."""
    monkeypatch.setattr(descent, "OCCUPANCY", 20)
    monkeypatch.setattr(descent, "SHELF", 300)
    monkeypatch.setattr(descent, "FULL", 600)
    monkeypatch.setattr(descent, "ROUNDS", 1)
    m = np.random.default_rng(6).standard_normal((1500, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>")
    _, points, width = descent.distinct_vectors(df)
    _, home = descent.build_graph(points, width)
    blocks, shelves = (home.select(c).distinct().count() for c in ("block", "shelf"))
    assert home.count() == 1500 and blocks >= 50 and 2 <= shelves <= 10
