import hashlib
import json
import os
import random

import numpy as np
import pandas as pd
import pytest

from rowloom.operators import layout
from rowloom.operators.explain import prefix_group_counts
from rowloom.operators.layout import LAYOUTS, LayoutOptimizer, code_bytes, dense_codes, encode_cells, plan_by_group
from rowloom.plans import materialize
from rowloom.sources.cells import as_cells


def oracle(rows):
    left, order = list(range(len(rows[0]) if rows else 0)), []
    while left:
        best = min(left, key=lambda c: len({tuple(r[k] for k in [*order, c]) for r in rows}))
        order.append(best)
        left.remove(best)
    return order


def places(plan):
    return [r["_pos"] for r in plan.order.orderBy("_exec_pos").collect()]


def sorted_rows(rows, order):
    return sorted(range(len(rows)), key=lambda i: ([rows[i][c] for c in order], i))


@pytest.mark.parametrize("shape", [(1, 1), (40, 6), (300, 12), (20, 0)])
@pytest.mark.parametrize("limit", [10**9, 0])
def test_greedy_equals_an_independent_oracle(spark, monkeypatch, shape, limit):
    monkeypatch.setattr(layout, "DRIVER_CELLS", limit)
    rows = [list(map(str, r)) for r in np.random.default_rng(41).integers(0, 8, shape).tolist()]
    plan = LayoutOptimizer(spark).plan(rows)
    order = oracle(rows)
    assert list(plan.column_order) == order and places(plan) == sorted_rows(rows, order)
    if shape[1]:
        assert list(plan.group_counts) == [len({tuple(r[c] for c in order[:k]) for r in rows}) for k in range(1, shape[1] + 1)]


def test_correlated_columns_of_equal_cardinality(spark):
    rows = [list(map(str, (a, b, c, (a + 1) % 4, (a + 2) % 4))) for a in range(4) for b in range(4) for c in range(4)]
    random.Random(0).shuffle(rows)
    greedy = LayoutOptimizer(spark).plan(rows)
    assert greedy.column_order == (0, 3, 4, 1, 2) and greedy.group_counts == (4, 4, 4, 16, 64)
    assert LayoutOptimizer(spark, "cardinality").plan(rows).column_order == (0, 1, 2, 3, 4)


def test_baselines(spark):
    rows = [["z", "1", "b"], ["a", "2", "b"], ["a", "1", "b"], ["z", "0", "b"]]
    assert places(LayoutOptimizer(spark, "lexicographic").plan(rows)) == [2, 1, 3, 0]
    assert LayoutOptimizer(spark, "cardinality").plan(rows).column_order == (2, 0, 1)
    assert places(LayoutOptimizer(spark, "original").plan(rows)) == [0, 1, 2, 3]


def test_random_follows_the_seed(spark, monkeypatch):
    rows = [[str(i), str(i % 3), "x"] for i in range(50)]
    rng = random.Random(11)
    columns = list(range(3))
    rng.shuffle(columns)
    order = sorted(range(50), key=lambda i: hashlib.md5(f"11:{i}".encode()).hexdigest())
    plan = LayoutOptimizer(spark, "random", seed=11).plan(rows)
    assert list(plan.column_order) == columns and places(plan) == order
    assert places(LayoutOptimizer(spark, "random", seed=12).plan(rows)) != order
    monkeypatch.setattr(materialize, "ONE_SORT", 10)  # large tables are numbered in parts: the order is the same
    assert places(LayoutOptimizer(spark, "random", seed=11).plan(rows)) == order
    monkeypatch.undo()
    rng = random.Random(11)
    columns = list(range(3))
    rng.shuffle(columns)
    plan = LayoutOptimizer(spark, "random_columns", seed=11).plan(rows)
    assert list(plan.column_order) == columns and places(plan) == sorted_rows(rows, columns)


def test_sample_chooses_columns_and_all_rows_are_sorted(spark):
    rows = [list(map(str, r)) for r in np.random.default_rng(31).integers(0, 9, (400, 5)).tolist()]
    some = [rows[i] for i in random.Random(11).sample(range(400), 17)]
    plan = LayoutOptimizer(spark, seed=11, sample_size=17).plan(rows)
    assert list(plan.column_order) == oracle(some) and places(plan) == sorted_rows(rows, oracle(some)) and plan.plan_rows == 17


def test_apply_and_restore(spark):
    frame = pd.DataFrame({"id": [2, 1, 1, 3], "text": ["北京", "a", "a", ""]}, index=list("xxza"))
    for method in LAYOUTS:
        plan = LayoutOptimizer(spark, method, seed=3).plan(frame)
        shown = plan.apply().collect()
        order = places(plan)
        assert [(r["id"], r["text"]) for r in shown] == [(str(frame["id"].iloc[i]), frame["text"].iloc[i]) for i in order]
        outputs = spark.createDataFrame([(e, f"out{p}") for e, p in enumerate(order)], "_exec_pos long, o string")
        assert [r["o"] for r in plan.restore(outputs).collect()] == ["out0", "out1", "out2", "out3"]
    with pytest.raises(ValueError):
        plan.restore(outputs.limit(2))
    with pytest.raises(ValueError):
        plan.apply(plan.table.frame)


def test_large_tables_are_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(materialize, "ONE_SORT", 10)
    rows = [[str(i * 7919 % 1000), str(i % 3)] for i in range(2000)]
    plan = LayoutOptimizer(spark, "lexicographic").plan(rows)
    assert places(plan) == sorted_rows(rows, [0, 1])


def test_explain(spark):
    rows = [[str(a), str(b), str(a)] for a in range(4) for b in range(4)]
    found = LayoutOptimizer(spark).explain(rows, columns=["a", "b", "copy_a"], methods=("original", "cardinality", "greedy"))
    assert [r["prefix_group_counts"] for r in found.layouts] == [[4, 16, 16], [4, 16, 16], [4, 4, 16]] and found.column_ndv == (4, 4, 4)
    assert found.to_dict()["column_ndv"] == {"a": 4, "b": 4, "copy_a": 4} and list(found.to_pandas().index) == ["original", "cardinality", "greedy"]
    with pytest.raises(ValueError):
        LayoutOptimizer(spark).explain(rows, methods=())
    assert [r["method"] for r in LayoutOptimizer(spark).explain(rows).layouts] == ["original", "greedy"]


def test_explain_counts_bytes(spark):
    records = [{"id": i % 3, "name": n, "nested": {"x": [i % 2, "é"]}} for i, n in enumerate(["北京", "北海", "", 'q"', "北京", "é"])]
    text = json.dumps(records, ensure_ascii=False)
    for method in ("original", "greedy", "lexicographic"):
        plan = LayoutOptimizer(spark, method).plan(text)
        report = LayoutOptimizer(spark).explain(text, methods=(method,)).layouts[0]
        rows = []
        for p in places(plan):
            r = records[p]
            rows.append(("{" + ",".join(f"{json.dumps(plan.columns[c])}:{json.dumps(r[plan.columns[c]], ensure_ascii=False, sort_keys=True, separators=(',', ':'))}" for c in plan.column_order) + "}").encode())
        assert report["serialized_bytes"] == sum(map(len, rows))
        assert report["adjacent_prefix_bytes"] == sum(len(os.path.commonprefix(p)) for p in zip(rows, rows[1:]))


@pytest.mark.parametrize("data", [[], [[], []], "[{},{}]"])
def test_empties(spark, data):
    found = LayoutOptimizer(spark).explain(data, methods=LAYOUTS)
    assert found.column_ndv == () and all(0 <= r["adjacent_prefix_fraction"] < 1 for r in found.layouts)


def test_bad_arguments(spark):
    for bad in ({"method": "best"}, {"sample_size": 0}, {"sample_size": True}, {"sample_size": 1.5}):
        with pytest.raises(ValueError):
            LayoutOptimizer(spark, **bad)


def test_curve_of_any_order(spark):
    rows = [list(map(str, r)) for r in np.random.default_rng(2).integers(0, 4, (200, 4)).tolist()]
    for order in ([3, 1, 0, 2], [0]):
        assert prefix_group_counts(as_cells(spark, rows), order) == [len({tuple(r[c] for c in order[:k]) for r in rows}) for k in range(1, len(order) + 1)]


def test_plans_of_groups_differ(spark):
    rows = [(g, i, str(i % 2 if g else i), str(i if g else i % 2)) for g in (0, 1) for i in range(8)]
    df = spark.createDataFrame(rows, "g int, i int, a string, b string")
    out = plan_by_group(spark, df, "g", ["i"], ["a", "b"]).orderBy("g", "_exec_pos").collect()
    assert out[0]["state"].startswith('{"b":"0"') and out[8]["state"].startswith('{"a":"0"') and len(out) == 16


def test_codes(spark):
    """Ranks of texts among those of their column; sparse and negative numbers without gaps; bytes at the width the widest needs."""
    df = spark.createDataFrame([(0, -5, "b"), (1, 900, "a"), (2, -5, None), (3, 0, "ab"), (4, None, "b")], "p int, n long, t string")
    assert [tuple(r) for r in dense_codes(df, ["n", "t"]).orderBy("p").select("p", "n", "t").collect()] == [(0, 0, 2), (1, 2, 0), (2, 0, None), (3, 1, 1), (4, None, 2)]
    rows = [[str(i), "x", str(i % 3)] for i in range(300)]
    coded, size = encode_cells(as_cells(spark, rows))
    found = [tuple(r) for r in coded.orderBy("_pos").select("_c0", "_c1", "_c2").collect()]
    names = sorted({r[0] for r in rows})
    assert size == 300 * 3 * 2 and found == [(names.index(r[0]), 0, int(r[2])) for r in rows]
    assert [code_bytes(n) for n in (0, 256, 257, 65536, 65537, 1 << 33)] == [1, 1, 2, 2, 4, 8]
    plan = LayoutOptimizer(spark).plan(rows)
    assert plan.encoded_bytes == 300 * 3 * 8 and plan.workspace_bytes == 300 * 8


def test_prefix_groups_of_no_rows_and_no_columns(spark):
    assert prefix_group_counts(as_cells(spark, [], columns=["a", "b"]), [0, 1]) == [0, 0]
    assert prefix_group_counts(as_cells(spark, [["x", "y"], ["x", "z"], ["x", "z"]]), [1, 0]) == [2, 2] and prefix_group_counts(as_cells(spark, [[], []]), []) == []
