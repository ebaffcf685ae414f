import hashlib
import random
import re

import pyarrow as pa
import pytest

from rowloom.llm.substrings import op4_substring_dedup, remove_repeats
from rowloom.llm.words import Words, sliding_min, windows

from .conftest import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """(doc_id, words, removed, kept text) by comparing all windows."""
    rank = lambda i: float("inf") if i is None else i
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in split:
        for k in range(len(w) - 49):
            x = tuple(w[k : k + 50])
            first[x] = min(first.get(x, float("inf")), rank(i))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < rank(i):
                gone |= set(range(k, k + 50))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def corpus():
    rng = random.Random(5)
    passage, line = words(80, stem="p"), words(55, stem="l")
    rows = [(i, " ".join([words(rng.randrange(0, 90), 1000 * i), *rng.sample([passage, line, passage[:200], "x y z"], rng.randrange(0, 3)), words(rng.randrange(0, 60), 1000 * i + 500)])) for i in range(60)]
    rows += [(70 + i, rows[3][1]) for i in range(8)]  # exact copies
    rows += [(90 + i, " ".join(w if k % 97 else f"n{i}" for k, w in enumerate(rows[7][1].split()))) for i in range(8)]
    rows += [(20, rows[20][1]), (None, passage), (None, None), (110, ""), (111, " \t\n"), (112, passage + " \x0b" + passage), (113, " ".join(["a"] * 70) + " é北😀"), (114, words(49, stem="p"))]
    return rows


def test_query(spark, documents):
    rows = corpus()
    out = op4_substring_dedup(spark, documents(rows)).collect()
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out)
    assert got == sorted((str(i), n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute(rows))


def test_texts_are_kept_as_they_are_where_nothing_goes(spark, documents):
    rows = corpus()
    docs = spark.read.parquet(documents(rows) + "/documents.parquet")
    out = remove_repeats(docs).collect()
    expected = {(i, t): kept for (i, t), (_, _, gone, kept) in zip(rows, brute(rows), strict=True) if gone}
    for r in out:
        assert r["__rl_out"] == expected.get((r["doc_id"], r["text"]), r["text"])
    assert set(docs.columns) <= set(out[0].asDict())


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, words(50)), (1, words(50))]])
def test_tiny(spark, documents, rows):
    assert [r["n_removed"] for r in op4_substring_dedup(spark, documents(rows)).collect()] == [0] * len(rows)


def test_long_text(spark, documents):
    long = words(60_000, stem="v")
    out = op4_substring_dedup(spark, documents([(1, long), (2, "head " + long + " tail")])).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_removed"]) for r in out] == [(60_000, 0), (60_002, 60_000)]


def test_words_match_the_pattern():
    rng = random.Random(1)
    texts = ["".join(rng.choice(" \t\n\x0b\x0c\rab é北😀\x1c") for _ in range(rng.randrange(0, 30))) for _ in range(400)] + [None, "", " "]
    w = Words(pa.array(texts))
    assert [[bytes(w.data[s:e]).decode() for s, e in zip(w.starts[a:b], w.ends[a:b], strict=True)] for a, b in zip(w.first, w.first[1:])] == [WORD.findall(t or "") for t in texts]
    h = w.hashes(3)
    table = {}
    for s, e, x in zip(w.starts, w.ends, h, strict=True):
        assert table.setdefault(bytes(w.data[s:e]), x) == x
    assert len(set(table.values())) == len(table)


def test_windows_and_minima():
    import numpy as np

    h = np.array([3, 1, 4, 1, 5, 9, 2, 6, 1, 4, 1, 5], np.uint64)
    x = windows(h, 3, 8)
    assert x[1] == x[8] and x[2] == x[9] and len({*x.tolist()}) == len(x) - 2
    for k in range(1, 8):
        assert sliding_min(h, k).tolist() == [min(h[i : i + k]) for i in range(len(h) - k + 1)]
