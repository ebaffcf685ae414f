import datetime as dt
import json
import math
import random
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rowloom.functions.text import canonical_cell, float_text, json_string, shared_prefix
from rowloom.sources.cells import as_cells, of_dataframe
from rowloom.sources.jsonio import read_json


def cells(table):
    return [tuple(r)[1:] for r in table.frame.orderBy("_pos").collect()]


def test_floats_print_as_python_does(spark):
    rng = random.Random(1)
    xs = [0.0, -0.0, 1.0, 1e-5, 1e16, 1e15, 9.999e15, 123456.789, 1e-4, 1.5e300, math.nan, math.inf, -math.inf, 100.0, 1e22, 0.1, -2.5e-7, 1e7, 12345678.9, 0.001, 0.0012]
    xs += [round(rng.uniform(-1e9, 1e9), rng.randrange(6)) for _ in range(2000)] + [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-30, 30) for _ in range(500)]
    out = spark.createDataFrame([(x,) for x in xs], "x double").select("x", float_text(F.col("x")).alias("t")).collect()
    wrong = [(r["x"], r["t"]) for r in out if repr(r["x"]) != r["t"]]
    assert len(wrong) <= 2 and all(float(t) == x and abs(x) > 1e17 for x, t in wrong)


def test_json_strings(spark):
    texts = ['a"b\\c\n\t\r\b\f\x00\x1f\x7fé北😀', "", "plain", "\\u001F", "\\", '"']
    out = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(json_string(F.col("t"))).collect()
    assert [r[0] for r in out] == [json.dumps(t, ensure_ascii=False) for t in texts]


def test_shared_prefix_counts_bytes(spark):
    pairs = [("abc", "abd"), ("", "x"), ("é", "è"), ("北京", "北海"), ("same", "same"), ("a", "ab"), ("x" * 5000 + "a", "x" * 5000 + "b")]
    out = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").orderBy("i").select(shared_prefix(F.col("a"), F.col("b"))).collect()
    for (a, b), r in zip(pairs, out, strict=True):
        x, y = a.encode(), b.encode()
        assert r[0] == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))


def test_text_and_json_modes(spark):
    record = {"amount": 2, "optional": None, "flag": True}
    assert cells(as_cells(spark, [record])) == [("2", "None", "True")]
    assert cells(as_cells(spark, json.dumps(record))) == [("2", "null", "true")]
    mixed = as_cells(spark, [{"amount": 2, "items": [1, "a"], "details": {"b": 1, "a": None}}])
    assert mixed.json_values and cells(mixed) == [('"2"', '[1,"a"]', '{"a":null,"b":1}')]
    assert cells(as_cells(spark, [{"cell": {"z": 1, "a": [1, 2]}}, {"cell": {"a": [1, 2], "z": 1}}, {"cell": {"a": [2, 1], "z": 1}}]))[0:2] == [('{"a":[1,2],"z":1}',)] * 2


def test_containers(spark):
    assert cells(as_cells(spark, pd.DataFrame({"v": [None, math.nan, pd.NA, ""]}, dtype=object))) == [("None",), ("nan",), ("<NA>",), ("",)]
    structured = np.array([(2, "北京"), (1, "a")], dtype=[("id", "i4"), ("text", "U8")])
    assert cells(as_cells(spark, structured)) == [("2", "北京"), ("1", "a")]
    table = as_cells(spark, np.array([[1, 2], [3, 4]]))
    assert table.columns == ("c0", "c1") and cells(table) == [("1", "2"), ("3", "4")]
    assert as_cells(spark, [], columns=["a", "b"]).columns == ("a", "b") and as_cells(spark, [[], []]).count() == 2
    assert as_cells(spark, [{1: "a", 2: "b"}]).columns == ("1", "2")
    assert as_cells(spark, [("a", (1, 2))]).json_values is False
    assert as_cells(spark, table) is table


@pytest.mark.parametrize("data", [[1, 2], [[1], [2, 3]], [{"a": 1}, {"b": 1}], [{"a": 1}, 3], pd.Series([1])])
def test_bad_shapes(spark, data):
    with pytest.raises((ValueError, TypeError)):
        as_cells(spark, data)


def test_bad_names(spark):
    for columns in (["a"], ["a", "a"]):
        with pytest.raises(ValueError):
            as_cells(spark, [[1, 2]], columns=columns)
    with pytest.raises(ValueError):
        as_cells(spark, [{"a": 1}], columns=["b"])


def test_dataframe(spark):
    rows = [(2, "x", True, 1.5, dt.datetime(2024, 1, 2, 3, 4, 5), [1, None], None), (1, None, False, 1e-5, dt.datetime(2024, 1, 2, 3, 4, 5, 60), None, {"k": 0.1})]
    df = spark.createDataFrame(rows, "Id long, s string, b boolean, d double, t timestamp, `l.x` array<int>, m map<string,double>")
    table = of_dataframe(df, order_by=["Id"])
    assert table.columns == ("Id", "s", "b", "d", "t", "l.x", "m") and table.json_values
    assert cells(table)[0] == ('"1"', '"None"', '"False"', '"1e-05"', '"2024-01-02 03:04:05.000060"', "null", '{"k":0.1}')
    assert cells(table)[1][4:6] == ('"2024-01-02 03:04:05"', "[1,null]")
    plain = of_dataframe(df.select("Id", "d"))
    assert not plain.json_values and cells(plain) == [("2", "1.5"), ("1", "1e-05")]
    one = spark.createDataFrame([(1, {"z": 1.0, "a": 1e-7})], "i int, m map<string,double>").select(canonical_cell(F.col("m"))).first()[0]
    assert one == '{"a":1e-07,"z":1.0}'


def test_read_json(spark, tmp_path):
    assert read_json('{"a":1}').records == ({"a": 1},) and len(read_json("[]")) == 0
    lines = tmp_path / "x.jsonl"
    lines.write_text('﻿{"a": 1}\n\n{"a": {"b": [1, "x y"]}}\r\n', encoding="utf-8")
    assert read_json(lines).records == ({"a": 1}, {"a": {"b": [1, "x y"]}})
    plain = tmp_path / "x.json"
    plain.write_text('[{"n": 12345678901234567890123}]')
    assert read_json(plain)[0]["n"] == 12345678901234567890123
    source = [{"a": [1]}]
    copied = read_json(source)
    source[0]["a"].append(2)
    assert copied[0] == {"a": [1]} and read_json(copied) is copied
    with pytest.raises(ValueError, match="line 2"):
        read_json('{"a":1}\n[1]', lines=True)
    with pytest.raises(TypeError):
        read_json([{"a": 1}], lines=True)
    whole = tmp_path / "many.ndjson"
    whole.write_text("\n".join(json.dumps({"z": i, "a": {"k": [i, None], "b": "é\u2028"}}, ensure_ascii=False) for i in range(3000)))
    many = read_json(whole)
    assert len(many) == 3000 and many.fields == ("z", "a") and many[-1] == {"z": 2999, "a": {"k": [2999, None], "b": "é\u2028"}} and [r["z"] for r in many[5:8]] == [5, 6, 7]
    assert cells(as_cells(spark, whole))[7] == ("7", '{"b":"é\u2028","k":[7,null]}')
    whole.write_text('{"a": 1}\n\n{"a": 1, "a": 2}\n{"a": NaN}')
    with pytest.raises(ValueError, match="line 3.*again"):
        read_json(whole)
    assert read_json('[{"a":1.50,"b":[]},{"b":{},"a":1e2}]')[1] == {"b": {}, "a": 100.0}


@pytest.mark.parametrize("bad", ['{"a":1,"a":2}', '{"x":{"a":1,"a":2}}', '{"a":NaN}', '{"a":Infinity}', '{"a":1e999}', "[1,2]", "[[1,2]]", '"text"', "null", '[{"a":1},{"b":1}]', '[{"a":1,"b":2},{"a":1}]'])
def test_rejects(spark, bad):
    with pytest.raises(ValueError):
        read_json(bad)


def test_rejected_values(spark):
    for bad in ([{"a": float("inf")}], [{1: 2}], 5, [5]):
        with pytest.raises(ValueError):
            read_json(bad)
    with pytest.raises(TypeError):
        read_json([{"a": (1, 2)}])
