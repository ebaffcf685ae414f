"""The corpus pipeline: documents through language ID, near-dedup, substring dedup, mixing, and encoding and decoding.

Each stage takes (spark, docs, sf_dir) and works on all rows it gets; all but the last return the columns they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.languages import fit, identify
from rowloom.llm.minhash import one_of_each
from rowloom.llm.mixing import mixed
from rowloom.llm.pieces import encode_checked, model_path
from rowloom.llm.scratch import store
from rowloom.llm.substrings import remove_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language. Null, empty and letterless texts go; sources stand for hosts."""
    model = fit(docs.select(F.col("doc_id").alias("id"), "text", "lang"))
    return identify(docs, model, F.col("source")).where("__rl_accepted").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; those without words all stay."""
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that one with a smaller id has; those that have none stay as they are."""
    cut = remove_repeats(docs)
    gone = F.col("__rl_removed") > 0
    changed = {"text": F.col("__rl_out"), "n_chars": F.when(gone, F.length("__rl_out")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)}
    return cut.select(*(changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_ids, ids, lossless): the ids of each text and whether they decode to it."""
    return encode_checked(docs.select("doc_id", "lang", "source", "text"), model_path())


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mix_sources", mix_sources), ("encode", encode)]
#: SQL can't express the language model, the signatures or the merges; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each one's result written before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
