import pytest

from rowloom.llm import members
from rowloom.llm.members import likely_members, may_occur


@pytest.mark.parametrize("most", [1 << 23, 10])
def test_all_members_and_few_others(spark, monkeypatch, most):
    monkeypatch.setattr(members, "MOST", most)
    rows = spark.range(5000).selectExpr("id", "if(id % 7 = 0, null, cast(id as string)) as t")
    keys = rows.where("id % 10 = 0").drop("extra")
    out = {r["id"] for r in likely_members(rows.withColumnRenamed("x", "y"), keys, ["id", "t"]).collect()}
    assert {i for i in range(0, 5000, 10)} <= out and (len(out) == 5000 if most == 10 else len(out) < 500 + 4500 / 10)


def test_no_keys(spark):
    rows = spark.range(100)
    assert rows.where(may_occur(rows.where("id < 0"), ["id"])).count() <= 1
