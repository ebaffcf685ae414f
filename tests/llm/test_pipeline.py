import random

import pyarrow as pa
import pytest

pytest.importorskip("sentencepiece")
pytest.importorskip("public_tokenizers")

import corpus_pipeline
from rowloom.llm.pieces import Pieces, model_path
from rowloom.llm.scratch import shared_folder, store, together

from .conftest import words
from .test_languages import made
from .test_minhash import brute as near_classes
from .test_substrings import brute as without_repeats


def corpus():
    rng = random.Random(12)
    passage = made("en", 70, rng)
    rows = [(i, made(k, rng.choice((8, 60, 200)), rng) + (" " + passage + " end" if i % 5 == 0 else ""), k, f"src{i % 3}") for i, k in enumerate(["en", "de", "fr", "es"] * 15)]
    rows += [(100 + i, rows[8][1], "en", "src1") for i in range(6)]
    rows += [(110, None, "en", "src0"), (111, "", "en", None), (112, "12 34", None, "src0"), (None, made("en", 30, rng), "en", None), (8, rows[8][1], "en", "src2")]
    return rows


def test_stages_against_brute_force(spark, documents):
    rows = corpus()
    docs = spark.read.parquet(documents(rows) + "/documents.parquet")
    results = []
    for name, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, ""), name)
        results.append(docs)
    languages, near, cut, mix, ids = results
    key = lambda r: (str(r[0]), r[1])
    pairs = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=key)
    clean = sorted(((i, t) for i, t, *_ in rows if t and any(c.isalpha() for c in t)), key=key)
    assert pairs(languages) == clean
    kept = pairs(near)
    assert sorted(str(i) for i, _ in kept) == sorted(map(str, set(near_classes(clean))))
    expected = sorted(((i, t if not gone else left) for (i, t), (_, _, gone, left) in zip(kept, without_repeats(kept), strict=True)), key=key)
    assert pairs(cut) == expected
    assert all(set(df.columns) == set(docs0) for docs0 in [languages.columns] for df in (near, cut, mix))
    size = lambda df: sum(len((r["text"] or "").split()) for r in df.collect())
    assert abs(size(mix) - size(cut)) <= 3 and all(r["n_chars"] == len(r["text"] or "") for r in mix.collect())
    model = Pieces(model_path())
    out = ids.collect()
    assert sorted(model.decode(pa.array([r["ids"] for r in out], pa.list_(pa.int32())))) == sorted(r["text"] for r in mix.collect()) and all(r["lossless"] and r["n_ids"] == len(r["ids"]) for r in out)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "no label at all")]])
def test_tiny(spark, documents, rows):
    out = corpus_pipeline.run(spark, documents(rows)).collect()
    assert [r["doc_id"] for r in out] == [i for i, t in rows if t]


def test_long_text(spark, documents):
    out = corpus_pipeline.run(spark, documents([(1, words(30_000), "en", "a"), (2, words(30_000) + " x", "en", "a")])).collect()
    assert [r["doc_id"] for r in out] == [1]


def test_rows_of_a_key_stay_together_after_a_join(spark):
    """A plain repartition by the keys of a join is left out and undone at run time."""
    left = store(spark.range(2000).selectExpr("id % 50 as k", "id"), "left")
    right = store(spark.range(50).selectExpr("id as k").groupBy("k").count().drop("count"), "right")

    def keys(batches):
        seen = set()
        for b in batches:
            seen |= set(b.column("k").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.int64())], ["k"])

    found = together(left.join(right, "k"), ["k"], "id").mapInArrow(keys, "k long").collect()
    assert len(found) == len({r["k"] for r in found}) == 50
    assert shared_folder(spark).startswith("file:")
