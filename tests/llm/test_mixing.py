import random
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from rowloom.llm import mixing
from rowloom.llm.mixing import mixed, op5_mixing, sized_rows, targets


def water(sizes, weights=(5, 2, 1), most=3):
    """Targets by passing the excess on until no source is above its limit."""
    names = sorted(sizes)
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left = [n for n in names if n not in fixed]
        rest, all_w = total - sum(fixed.values()), sum(w[n] for n in left)
        share = {n: w[n] * rest / all_w for n in left}
        over = [n for n in left if share[n] > most * sizes[n]]
        if not over:
            return fixed | share
        fixed |= {n: most * sizes[n] for n in over}


def test_targets_equal_passing_on(spark):
    rng = random.Random(2)
    for _ in range(8):
        sizes = {f"s{i}": rng.choice((1, 10, 100, 1000, rng.randrange(1, 5000))) for i in range(rng.randrange(1, 12))}
        out = targets(spark.createDataFrame(list(sizes.items()), "skey string, size long")).collect()
        expected = water(sizes)
        assert {r["skey"] for r in out} == set(sizes)
        for r in out:
            assert r["target"] == pytest.approx(expected[r["skey"]], rel=1e-12) and r["source_size"] == sizes[r["skey"]]


def corpus(seed=4):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randrange(1, 9) for _ in range(rng.choice((0, 1, 20, 300, 2000)))), "en", rng.choice(["hot"] * 6 + ["a", "b", "é", None])) for i in range(300)]
    return rows + [rows[5], rows[5], (None, "null id here", "en", "a"), (900, None, None, "a"), (901, "   ", "en", "lonely")]


def test_query(spark, documents):
    rows = corpus()
    folder = documents(rows)
    out = op5_mixing(spark, folder).collect()
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((i, len((t or "").split())) for i, t, *_ in rows)
    source = {(i, len((t or "").split())): s for i, t, _, s in rows}
    taken, goal = defaultdict(int), {}
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"]
        s = source[r["doc_id"], r["size"]]
        taken[s] += r["taken"]
        goal[s] = r["target"]
    for s in goal:
        assert taken[s] == int(goal[s] + 0.5)
    again = op5_mixing(spark, folder).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_rows_of_the_mix(spark, documents):
    rows = corpus(9)
    docs = spark.read.parquet(documents(rows) + "/documents.parquet")
    out = mixed(docs).collect()
    assert set(out[0].asDict()) == set(docs.columns)
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes["z" if s is None else f"s{s}"] += len((t or "").split())
    expected, got = water(sizes), defaultdict(int)
    whole = defaultdict(set)
    for i, t, *_ in rows:
        whole[i].add(t)
    for r in out:
        got["z" if r["source"] is None else f"s{r['source']}"] += len(r["text"].split())
        assert any(t and t.startswith(r["text"]) for t in whole[r["doc_id"]]) and r["n_chars"] == len(r["text"])
    for k, v in expected.items():
        assert got[k] == int(v + 0.5)


def played(rows, golden, block=256):
    """The mix by brute force: rows of (key, source, size), in stream order within their source, and (slot, source, row,
    words) of all that plays, word by word."""
    by = defaultdict(list)
    for key, source, size in rows:
        by[source] += [key] * size
    sizes = {s: len(w) for s, w in by.items()}
    goals = {s: int(x + 0.5) for s, x in water({s: sum(z for _, o, z in rows if o == s) for s in {o for _, o, _ in rows}}).items()}
    total = sum(goals.values())
    n = -(-total // block)
    need = {s: g // sizes[s] * -(-sizes[s] // block) + -(-(g % sizes[s]) // block) for s, g in goals.items() if g}
    slots, upto, edges = [], 0, []
    for s in sorted(need):
        edges.append((upto * (1 << 31) // total, (upto + goals[s]) * (1 << 31) // total, s))
        upto += goals[s]
    turn = Counter()
    for slot in range(n):
        u = slot * golden % (1 << 31)
        for s in [s for low, high, s in edges if low <= u < high]:
            slots.append((slot, s, turn[s]))
            turn[s] += 1
    slots += [(n + t, s, t) for s in need for t in range(turn[s], need[s])]
    out = []
    for slot, s, t in sorted(slots):
        blocks = -(-sizes[s] // block)
        if t < need[s]:
            words = by[s][t % blocks * block :][:block]
            left = goals[s] - sum(1 for x in out if x[1] == s)
            out += [(slot, s, key) for key in words[:left]]
    return out


@pytest.mark.parametrize("golden", [mixing.GOLDEN, 1])
def test_the_schedule_by_brute_force(spark, documents, monkeypatch, golden):
    monkeypatch.setattr(mixing, "GOLDEN", golden)
    docs = spark.read.parquet(documents([r for r in corpus(5) if r[0] is not None][:300]) + "/documents.parquet")
    rows = sorted(sized_rows(docs, doc_id=F.col("doc_id")).select("hash", "doc_id", "skey", "size").collect())
    expected = played([(r["doc_id"], r["skey"], r["size"]) for r in rows], golden)
    taken, first = Counter(k for _, _, k in expected), {}
    for slot, _, k in expected:
        first.setdefault(k, slot)
    out = mixing.mix(sized_rows(docs, doc_id=F.col("doc_id"))).collect()
    assert {r["doc_id"]: r["taken"] for r in out} == {r["doc_id"]: taken[r["doc_id"]] for r in rows}
    assert {r["doc_id"]: r["first_slot"] for r in out if r["taken"]} == first and all(r["first_slot"] is None for r in out if not r["taken"])
    # the rows of the mix come in the order of their slots
    order, seen = [], set()
    for r in mixed(docs).collect():
        if r["doc_id"] not in seen:
            seen.add(r["doc_id"])
            order.append(r["doc_id"])
    assert [first[k] for k in order] == sorted(first.values())


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(1, "one", "en", None)]])
def test_tiny(spark, documents, rows):
    out = op5_mixing(spark, documents(rows)).collect()
    assert [(r["doc_id"], r["taken"]) for r in out] == [(i, len((t or "").split())) for i, t, *_ in rows]
