import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from rowloom.llm import minhash
from rowloom.llm.components import components
from rowloom.llm.minhash import SIZE, counted, grouped, one_of_each, op8_minhash_near_dedup, shingles, signatures
from rowloom.llm.words import Words

from .conftest import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(t):
    w = WORD.findall(t or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """The class of each row: least id among rows joined by similarities of 0.8 and more."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), float("inf")), float("inf") if d is None else d)
    return [None if least[find(i)] == float("inf") else least[find(i)] for i in range(len(rows))]


def edited(text, every, mark):
    return " ".join(f"{mark}{k}" if k % every == every - 1 else w for k, w in enumerate(text.split()))


def corpus():
    rng = random.Random(6)
    rows = [(i, words(rng.choice((1, 3, 5, 6, 30, 200, 400)), 1000 * i)) for i in range(40)]
    base = words(300, 90_000)
    rows += [(100 + i, edited(base, e, f"e{i}_")) for i, e in enumerate((60, 70, 80, 90, 100, 30, 20, 300, 45, 50))]
    rows += [(150 + i, rows[3][1]) for i in range(30)]  # exact copies
    rows += [(200 + i, words(60, 80_000) + " " + words(40, 70_000 + 50 * i)) for i in range(12)]  # a passage in common, not near
    rows += [(None, base), (None, None), (5, rows[5][1]), (300, None), (301, ""), (302, " \n"), (303, "same"), (304, "same"), (305, "a a a a a a a a"), (306, "a a a a a a")]
    return rows


def test_query(spark, documents):
    rows = corpus()
    out = op8_minhash_near_dedup(spark, documents(rows)).collect()
    expected = brute(rows)
    key = lambda x: (str(x[0]), str(x[1]))
    assert sorted(((r["doc_id"], r["class_id"]) for r in out), key=key) == sorted(((d, c) for (d, _), c in zip(rows, expected, strict=True)), key=key)


def test_blocks_and_the_second_pass_lose_nothing(spark, documents, monkeypatch):
    """Chains of near copies, whose ends aren't near, in buckets that are cut into blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    base = words(120, 5)
    rows = [(i, base) for i in range(3)]
    text = base.split()
    for i in range(3, 40):
        text = [*text[2:], f"n{i}a", f"n{i}b"]
        rows.append((i, " ".join(text)))
    out = op8_minhash_near_dedup(spark, documents(rows)).collect()
    assert {r["class_id"] for r in out} == {0} and brute(rows) == [0] * len(rows)


def test_copies_that_repeat_a_passage(spark, documents):
    """One text of each pair has a passage 30 times; the sets of shingles are similar nevertheless."""
    rows = []
    for k in range(12):
        text = edited(words(400, 1000 * k), 100, f"e{k}_").split()
        rows += [(2 * k, words(400, 1000 * k)), (2 * k + 1, " ".join(text[:120] * 30 + text[120:]))]
    out = op8_minhash_near_dedup(spark, documents(rows)).collect()
    assert {r["doc_id"]: r["class_id"] for r in out} == dict(zip(range(24), brute(rows), strict=True)) == {d: d - d % 2 for d in range(24)}


def test_one_of_each(spark, documents):
    rows = corpus()
    docs = spark.read.parquet(documents(rows) + "/documents.parquet")
    kept = one_of_each(docs).collect()
    assert set(kept[0].asDict()) == set(docs.columns)
    full = [(d, t) for d, t in rows if shingle_set(t)]
    classes = set(brute(full))
    assert sorted(r["doc_id"] for r in kept if shingle_set(r["text"])) == sorted(classes)
    assert sum(not shingle_set(r["text"]) for r in kept) == sum(not shingle_set(t) for _, t in rows)


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, ""), (2, "")], [(4, "x"), (4, "x")]])
def test_tiny(spark, documents, rows):
    out = op8_minhash_near_dedup(spark, documents(rows)).collect()
    assert sorted(str(r["class_id"]) for r in out) == sorted(str(d) for d, _ in rows)


def test_signatures_estimate_probability_jaccard():
    """Weights count: components agree as often as the exact similarity says, scaled weights change nothing."""
    rng = np.random.default_rng(3)
    ids = rng.integers(1, 1 << 62, 60).astype(np.uint64)
    a, b = rng.integers(0, 4, 60).astype(float), rng.integers(0, 4, 60).astype(float)
    exact = sum(1 / max_sum for x, y, max_sum in ((x, y, np.maximum(a / x, b / y).sum()) for x, y in zip(a, b) if x and y))
    hits = []
    for seed in range(30):
        own = ids + np.uint64(seed * 7919)
        keep = np.concatenate([np.flatnonzero(a), np.flatnonzero(b)])
        text = np.repeat([0, 1], [np.count_nonzero(a), np.count_nonzero(b)])
        s = signatures(own[keep], text, np.concatenate([a[a > 0], 5 * b[b > 0]]), 2)
        hits.append((s[0] == s[1]).mean())
    assert abs(np.mean(hits) - exact) < 4 * (exact * (1 - exact) / (30 * SIZE)) ** 0.5


def test_shingles_count():
    h, t, n = counted(*shingles(Words(pa.array(["a b c d e a b c d e a", "a b", None, "a b"]))))
    assert [int((t == i).sum()) for i in range(4)] == [5, 1, 0, 1] and n[t == 0].sum() == 7 and h[t == 1] == h[t == 3]


def test_grouped_spans_batches():
    t = pa.table({"k": [1, 1, 2, 2, 2, 3, 4, 4], "v": list(range(8))})
    for size in range(1, 9):
        out = [(g.column("k").to_pylist(), g.column("v").to_pylist()) for g in grouped(t.to_batches(max_chunksize=size), ["k"])]
        assert out == [([1, 1], [0, 1]), ([2, 2, 2], [2, 3, 4]), ([3], [5]), ([4, 4], [6, 7])]


def test_components(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 60)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(7, 7)]
    parent = {x: x for e in links if e[0] != e[1] for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    out = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {x: find(x) for x in parent}
