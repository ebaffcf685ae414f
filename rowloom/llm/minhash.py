"""Near-duplicate documents by ProbMinHash.

A shingle sends arrivals of a Poisson process, whose rate is its weight, each to one of the signature's components; a
component keeps the shingle that arrives first, so two texts agree there with their probability Jaccard similarity. Texts
are near by the Jaccard similarity of their sets of shingles, so each shingle weighs one, however often it occurs: then the
two similarities are the same, and what holds for bands and components at SIMILAR holds for every pair (weights that grow
with counts would part a text from a copy that repeats a passage). A text's processes stop once they pass its latest first
arrival. Bands of the signature make buckets; in each, sketches of the signatures give the links worth a look, and these
are verified by the exact similarity.

Exact copies are one text throughout. A bucket's texts are compared in blocks of at most BLOCK, each pair of blocks by
itself, and yield a spanning forest of likely links instead of all pairs; once these are verified and joined, a second
pass verifies, in the bucket, every likely link between texts that are still apart. Nothing is capped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .members import likely_members
from .scratch import dropping, store, together
from .substrings import LAST, keys
from .words import Words, lists, mix64, numbers, pieces, windows

SHINGLE, SIMILAR = 5, 0.8
#: A pair at 0.8 shares none of the bands once in 300,000 times.
BANDS, ROWS = 24, 4
SIZE = BANDS * ROWS
#: Equal components of 96 from which a pair is verified; a pair at 0.8 has fewer once in a million times.
LIKELY = 56
#: Texts of a block.
BLOCK = 4096
SEED = 801


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each shingle; a text of one to four words has one shingle, of all its words."""
    n = words.lengths()
    hashes = words.hashes(SEED)
    count = np.maximum(n - SHINGLE + 1, (n > 0).astype(np.int64))
    text = np.repeat(np.arange(len(n)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(words.first[:-1], count)
    out = np.empty(len(at), np.uint64)
    length = np.minimum(n, SHINGLE)[text]
    for k in range(1, SHINGLE + 1):
        if (own := length == k).any():
            out[own] = windows(hashes, k, SEED)[at[own]]
    return out, text


def counted(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, text) in the order of text and hash, and how often each occurs."""
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return hashes[at], text[at], np.diff(np.append(at, len(hashes)))


def signatures(hashes: np.ndarray, text: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """The shingle that each of SIZE components keeps, for each of n texts; 0 where a text has no shingle."""
    first, kept = np.full(n * SIZE, np.inf), np.zeros(n * SIZE, np.uint64)
    latest = np.full(n, np.inf)
    when, turn = np.zeros(len(hashes)), 0
    while len(hashes):
        turn += 1
        draw = mix64(hashes + np.uint64(turn * 0x9E3779B97F4A7C15 % (1 << 64)))
        when = when - np.log(((draw >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52) / weights
        alive = when < latest[text]
        if not alive.all():
            hashes, text, weights, when, draw = hashes[alive], text[alive], weights[alive], when[alive], draw[alive]
            if not len(hashes):
                break
        slot = text * SIZE + (mix64(draw) % np.uint64(SIZE)).astype(np.int64)
        np.minimum.at(first, slot, when)
        won = first[slot] == when
        kept[slot[won]] = hashes[won]
        own = np.unique(text) if len(text) < n else np.arange(n)
        latest[own] = first.reshape(n, SIZE)[own].max(axis=1)
    return kept.reshape(n, SIZE)


def sketch(batches):
    """A row for each text: rank, key, digest, number of shingles, hashes of bands, a byte of each component."""
    marks = numbers(SEED + 1, BANDS)
    for b in pieces(batches, 1 << 20):
        words = Words(b.column("text"))
        hashes, text, _ = counted(*shingles(words))
        n = np.bincount(text, minlength=b.num_rows)
        kept = signatures(hashes, text, np.ones(len(hashes)), b.num_rows)
        bands = np.repeat(marks[None, :], b.num_rows, 0)
        for k in range(ROWS):
            bands = mix64(bands * np.uint64(0xD6E8FEB86659FD93) + kept[:, k::ROWS])
        has = n > 0
        offsets = np.concatenate(([0], np.cumsum(has * BANDS)))
        raw, o = words.data, words.offsets
        digest = [hashlib.blake2b(raw[o[i] : o[i + 1]], digest_size=16).digest() for i in range(b.num_rows)]
        marked = [x.tobytes() for x in (kept & np.uint64(255)).astype(np.uint8)]
        yield pa.RecordBatch.from_arrays([b.column("rank"), b.column("key"), pa.array(digest, pa.binary()), pa.array(n.astype(np.int64)), lists(pa.array(bands[has].ravel().view(np.int64)), offsets), pa.array(marked, pa.binary())], ["rank", "key", "digest", "n", "bands", "sketch"])


def shingle_sets(batches):
    """(id, set): the sorted hashes of a text's shingles, eight bytes each."""
    for b in pieces(batches, 1 << 20):
        hashes, text, _ = counted(*shingles(Words(b.column("text"))))
        o = np.searchsorted(text, np.arange(b.num_rows + 1))
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([hashes[o[i] : o[i + 1]].tobytes() for i in range(b.num_rows)], pa.binary())], ["id", "set"])


def grouped(batches, names: list[str]):
    """Runs of rows with equal values of ``names`` in sorted batches, each as one record batch; a run may span batches."""
    held: list[pa.RecordBatch] = []
    whole = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
    for b in batches:
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows, bool)
        new[0] = True
        for v in (b.column(c).to_numpy(zero_copy_only=False) for c in names):
            new[1:] |= v[1:] != v[:-1]
        cuts = [*np.flatnonzero(new).tolist(), b.num_rows]
        for at, until in zip(cuts, cuts[1:]):
            part = b.slice(at, until - at)
            if held and (at or any(held[-1].column(c)[0] != part.column(c)[0] for c in names)):
                yield whole()
                held = []
            held.append(part)
    if held:
        yield whole()


def likely(marks: np.ndarray, block: np.ndarray, split: bool, x: int, rest: np.ndarray) -> np.ndarray:
    """Which of ``rest`` may be similar to x; where two blocks meet, links within one are left to that block alone."""
    hit = (marks[rest] == marks[x]).sum(axis=1, dtype=np.int64) >= LIKELY
    return hit & (block[rest] != block[x]) if split else hit


def _bucket(b: pa.RecordBatch):
    marks = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint8).reshape(-1, SIZE)
    return b.column("id").to_numpy(), marks, b.column("block").to_numpy(), b.column("i")[0] != b.column("j")[0]


def _bands(b: pa.RecordBatch) -> tuple[np.ndarray, int]:
    """The bands of a bucket's texts, and which of them is the bucket's."""
    bands = np.asarray(b.column("bands").flatten()).reshape(b.num_rows, BANDS)
    return bands, int(np.flatnonzero(bands[0] == b.column("band")[0].as_py())[0])


def forest(batches):
    """(a, b): a spanning forest of the likely links of each bucket, as found from the least id on."""
    out_a, out_b, size = [], [], 0
    for b in grouped(batches, ["band", "i", "j"]):
        ids, marks, block, split = _bucket(b)
        left, queue = np.arange(len(ids)), []
        while len(left):
            if not queue:
                queue, left = [int(left[0])], left[1:]
            x = queue.pop()
            hit = likely(marks, block, split, x, left)
            found, left = left[hit], left[~hit]
            queue += found.tolist()
            out_a.append(np.full(len(found), ids[x]))
            out_b.append(ids[found])
            size += len(found)
        if size > 20_000:
            yield _pairs(out_a, out_b)
            out_a, out_b, size = [], [], 0
    if size:
        yield _pairs(out_a, out_b)


def apart(batches):
    """(band, i, j, id) of texts with a likely link to another component in their bucket, which no band before has too."""
    for b in grouped(batches, ["band", "i", "j"]):
        ids, marks, block, split = _bucket(b)
        own = b.column("component").to_numpy()
        bands, turn = _bands(b)
        keep = np.zeros(len(ids), bool)
        for x in range(len(ids) - 1):
            rest = x + 1 + np.flatnonzero(own[x + 1 :] != own[x])
            if len(rest) and len(hit := rest[likely(marks, block, split, x, rest)]):
                hit = hit[~(bands[hit, :turn] == bands[x, :turn]).any(axis=1)]
                keep[x] |= len(hit) > 0
                keep[hit] = True
        if keep.any():
            yield b.filter(pa.array(keep)).select(["band", "i", "j", "id"])


def verified_links(batches):
    """(a, b): links between different components, verified by sets, as many as join them. A pair is looked at in the
    first band it shares."""
    for b in grouped(batches, ["band", "i", "j"]):
        ids, marks, block, split = _bucket(b)
        root = b.column("component").to_numpy().copy()
        bands, turn = _bands(b)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column("set")]
        out_a, out_b = [], []
        for x in range(len(ids) - 1):
            rest = x + 1 + np.flatnonzero(root[x + 1 :] != root[x])
            rest = rest[likely(marks, block, split, x, rest)]
            rest = rest[~(bands[rest, :turn] == bands[x, :turn]).any(axis=1)]
            if not len(rest):
                continue
            size = np.array([len(sets[r]) for r in rest])
            every = np.concatenate([sets[r] for r in rest])
            own = sets[x]
            same = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
            both = np.add.reduceat(same.astype(np.int64), np.cumsum(size) - size)
            for r in rest[both >= SIMILAR * (len(own) + size - both) - 1e-9]:
                if root[r] != root[x]:
                    out_a.append(np.array([ids[x]]))
                    out_b.append(np.array([ids[r]]))
                    root[root == root[r]] = root[x]
        if out_a:
            yield _pairs(out_a, out_b)


def _pairs(a, b) -> pa.RecordBatch:
    a, b = np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def similar(batches):
    """Keeps links whose sets of shingles are similar enough."""
    for b in batches:
        keep = []
        for x, y in zip(b.column("set_a"), b.column("set_b"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= SIMILAR * max(len(x), len(y)) else 0
            keep.append(both >= SIMILAR * (len(x) + len(y) - both) - 1e-9)
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def classes(docs: DataFrame) -> DataFrame:
    """(rank, key, n, class, component) for each row of ``docs`` (doc_id, text), stored: class is the least rank of the row's
    class, component a number that its texts share (null without words).

    Texts without words (null, empty, blank) link with nothing and are their own class. A null id ranks last.
    """
    with dropping(docs.sparkSession):
        return store(_classes(docs), "minhash-classes", result=True)


def _classes(docs: DataFrame) -> DataFrame:
    seen = store(keys(docs).mapInArrow(sketch, "rank long, key long, digest binary, n long, bands array<long>, sketch binary"), "minhash-sketches")
    found = seen.where("n > 0").groupBy("digest").agg(F.min(F.struct("rank", "key")).alias("at"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    texts = store(found.select(F.monotonically_increasing_id().alias("id"), "digest", "at.rank", "at.key", "bands", "sketch"), "minhash-texts")
    rows = texts.select("id", F.explode("bands").alias("band"))
    shared = store(rows.groupBy("band").agg(F.count("*").alias("members")).where("members > 1"), "minhash-bands")
    members = rows.join(shared, "band").join(texts.select("id", "sketch"), "id")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("id"), blocks).cast("int")
    members = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    members = store(members.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "sketch"), "minhash-members")
    needed = members.select("id").distinct().join(texts, "id").select("id", "rank", "key")
    needed = store(needed, "minhash-needed")
    found = likely_members(keys(docs), needed, ["rank", "key"]).join(needed, ["rank", "key"]).dropDuplicates(["rank", "key"])
    sets = store(found.select("id", "text").mapInArrow(shingle_sets, "id long, set binary"), "minhash-sets")

    def verified(pairs: DataFrame) -> DataFrame:
        one, two = (sets.select(F.col("id").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
        return pairs.join(one, "a").join(two, "b").mapInArrow(similar, "a long, b long")

    def dealt(rows: DataFrame) -> DataFrame:
        return together(rows, ["band", "i", "j"], "id")

    links = store(verified(dealt(members).mapInArrow(forest, "a long, b long").distinct()), "minhash-links")
    parts = store(components(links), "minhash-parts").withColumnRenamed("node", "id")
    labelled = members.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = labelled.groupBy("band", "i", "j").agg((F.min("component") < F.max("component")).alias("mixed")).where("mixed").drop("mixed")
    labelled = labelled.join(mixed, ["band", "i", "j"])
    labelled = labelled.join(texts.select("id", "bands"), "id")
    some = store(dealt(labelled).mapInArrow(apart, "band long, i int, j int, id long"), "minhash-apart")
    close = some.join(labelled, ["band", "i", "j", "id"]).join(sets, "id")
    more = store(dealt(close).mapInArrow(verified_links, "a long, b long").distinct(), "minhash-links")
    parts = components(links.unionByName(more))
    member = texts.join(parts.withColumnRenamed("node", "id"), "id", "left").select("digest", "rank", F.coalesce("component", "id").alias("component"))
    least = member.groupBy("component").agg(F.min("rank").alias("class"))
    of = member.join(least, "component").select("digest", "class", "component")
    blank = seen.where("n = 0").select("rank", "key", "n", F.col("rank").alias("class"), F.lit(None).cast("long").alias("component"))
    return seen.where("n > 0").join(of, "digest").select("rank", "key", "n", "class", "component").unionByName(blank)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class the row with the least id, of equals the one whose text
    hashes least, of rows equal in both any one. Rows without words all stay."""
    with dropping(docs.sparkSession):
        found = classes(docs.select("doc_id", "text"))
        best = found.where("n > 0").groupBy("component").agg(F.min(F.struct("rank", "key")).alias("at")).select("at.rank", "at.key")
        best = store(best, "minhash-kept", result=True)
    best = best.select(F.col("rank").alias("__rl_rank"), F.col("key").alias("__rl_key"))
    told = docs.withColumns({"__rl_rank": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "__rl_key": F.xxhash64("text")})
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = told.where(words).join(best, ["__rl_rank", "__rl_key"], "left_semi").dropDuplicates(["__rl_rank", "__rl_key"])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return kept.select(columns).unionByName(told.where(~words).select(columns))


def op8_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The class of each of ``documents`` (its least doc_id), and whether the row has that id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = lambda c: F.when(F.col(c) < LAST, F.col(c))
    out = classes(docs.select("doc_id", "text"))
    return out.select(known("rank").alias("doc_id"), known("class").alias("class_id"), F.col("n").alias("n_shingles"), (F.col("rank") == F.col("class")).alias("kept"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(words) - 4, 1) + 1), lambda i: array_to_string(words[i:i + 4], ' ')))) AS x FROM w WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.8 * (x.n + y.n - k)),
reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT w.doc_id, c AS class_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, w.doc_id = c AS kept FROM w JOIN least ON a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""
