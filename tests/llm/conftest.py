import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def documents(spark, tmp_path):
    """Writes (doc_id, text[, lang[, source]]) rows as a documents table, with more columns of clashing names; gives its folder."""

    def write(rows, extra=("size", "rank", "key", "slot", "shard", "taken", "class", "ids")):
        full = [(*r, *(None,) * (4 - len(r))) for r in rows]
        full = [(*r, None if r[1] is None else len(r[1])) for r in full]
        df = spark.createDataFrame(full, DOCS)
        for c in extra:
            df = df.selectExpr("*", f"'clash' as `{c}`")
        df.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        return str(tmp_path)

    return write


def words(n, start=0, stem="w"):
    return " ".join(f"{stem}{i}" for i in range(start, start + n))
