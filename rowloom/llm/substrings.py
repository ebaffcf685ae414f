"""Substring dedup: words covered by a window of WINDOW words that also starts in a document with a smaller id go.

Windows that may repeat get Rabin-Karp hashes of all their words, and these are counted in Spark. Which may: each window
holds WINDOW - GRAM + 1 runs of GRAM words, whose rolling hashes are made for every text, and equal windows have the same
least run hash, so a window whose least run occurs in one document only (as most do) is not repeated and is not hashed
as a whole. That loses nothing and costs a row for about each fourteenth word instead of one for each. Exact copies of a
text with a smaller id are settled by the hash of the whole text: all their windows start in that document too.

Windows are told apart by two independent hashes, of 64 and 32 bits. Repeated windows merge into maximal intervals of words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .members import likely_members
from .scratch import dropping, store
from .words import Words, lists, pieces, sliding_min, windows

WINDOW, GRAM = 50, 25
SEEDS = 401, 402
#: The rank of a null id: after all others.
LAST = (1 << 63) - 1


def _runs(words: Words, hashes: np.ndarray):
    """Runs of windows with the same least run of words: (start, least hash, document) of each, and the windows' documents.

    ``at`` holds the first word of each whole window, in order; a run ends where the next begins."""
    n = words.lengths()
    count = np.maximum(n - WINDOW + 1, 0)
    doc = np.repeat(np.arange(len(n)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(words.first[:-1], count)
    if not len(at):
        return at, doc, at, np.zeros(0, np.uint64)
    least = sliding_min(windows(hashes, GRAM, SEEDS[0]), WINDOW - GRAM + 1)[at]
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    runs = np.flatnonzero(new)
    return at, doc, runs, least[runs]


def scan(batches):
    """A row for each text: rank, key, digest of the whole text, words, least run hashes in order of the runs."""
    for b in pieces(batches, 1 << 20):
        words = Words(b.column("text"))
        _, doc, runs, least = _runs(words, words.hashes(SEEDS[0]))
        offsets = np.searchsorted(doc[runs], np.arange(b.num_rows + 1)) if len(runs) else np.zeros(b.num_rows + 1, np.int64)
        raw, o = words.data, words.offsets
        digest = [hashlib.blake2b(raw[o[i] : o[i + 1]], digest_size=16).digest() for i in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([b.column("rank"), b.column("key"), pa.array(digest, pa.binary()), pa.array(words.lengths().astype(np.int64)), lists(pa.array(least.view(np.int64)), offsets)], ["rank", "key", "digest", "n_words", "runs"])


def hash_windows(batches):
    """The windows of the runs that may repeat: two hashes, of 96 bits together, and where they start."""
    for b in pieces(batches, 1 << 20):
        words = Words(b.column("text"))
        hashes = words.hashes(SEEDS[0])
        at, doc, runs, _ = _runs(words, hashes)
        if not len(at):
            continue
        marked = b.column("marked")
        first = np.searchsorted(doc[runs], np.arange(b.num_rows))
        chosen = np.asarray(marked.flatten()) + np.repeat(first, np.diff(np.asarray(marked.offsets)))
        keep = np.zeros(len(runs), bool)
        keep[chosen] = True
        keep = np.repeat(keep, np.diff(np.append(runs, len(at))))
        at, doc = at[keep], doc[keep]
        one = windows(hashes, WINDOW, SEEDS[0])[at]
        two = (windows(words.hashes(SEEDS[1]), WINDOW, SEEDS[1])[at] >> np.uint64(32)).astype(np.uint32)
        take = pa.array(doc)
        yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int32)), b.column("rank").take(take), b.column("nth").take(take), pa.array((at - words.first[doc]).astype(np.int32))], ["one", "two", "rank", "nth", "start"])


def keys(docs: DataFrame) -> DataFrame:
    """rank, key and text: rows that share rank and key are equal for all that follows."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("rank"), F.xxhash64("text").alias("key"), "text")


def candidates(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rank, key, n_words, whole) once for each, ``whole``: all words go, as in a copy; (rank, key, marked, nth): the runs of those
    that are no copies and share a run with another document, and a number of each."""
    with dropping(texts.sparkSession):
        seen = store(texts.mapInArrow(scan, "rank long, key long, digest binary, n_words long, runs array<long>"), "windows-scan")
        # what rows with frequent keys are joined with is written first: Spark then cuts the frequent keys' partitions
        smallest = store(seen.groupBy("digest").agg(F.min("rank").alias("smallest")), "windows-digests")
        runs = seen.join(smallest, "digest").where("rank = smallest").select("rank", "key", F.posexplode("runs").alias("run", "least"))
        shared = store(runs.groupBy("least").agg(F.min("rank").alias("a"), F.max("rank").alias("b")).where("a < b").select("least"), "windows-shared")
        marked = runs.join(shared, "least").groupBy("rank", "key").agg(F.sort_array(F.collect_set("run")).alias("marked"))
        marked = marked.withColumn("nth", F.monotonically_increasing_id())
        whole = (F.col("rank") > F.col("smallest")) & (F.col("n_words") >= WINDOW)
        by_key = seen.drop("runs").join(smallest, "digest").groupBy("rank", "key").agg(F.first("n_words").alias("n_words"), F.first(whole).alias("whole"))
        return store(by_key, "windows-texts", result=True), store(marked, "windows-marked", result=True)


def repeats(texts: DataFrame, marked: DataFrame) -> DataFrame:
    """(rank, key, starts): where windows start that a document with a smaller id has too."""
    with dropping(texts.sparkSession):
        hashed = likely_members(texts, marked, ["rank", "key"]).join(marked, ["rank", "key"]).select("rank", "nth", "text", "marked")
        found = store(hashed.mapInArrow(hash_windows, "one long, two int, rank long, nth long, start int"), "windows-hashes")
        first = store(found.groupBy("one", "two").agg(F.min("rank").alias("a"), F.max("rank").alias("b")).where("a < b").select("one", "two", "a"), "windows-first")
        starts = found.join(first, ["one", "two"]).where("rank > a").groupBy("nth").agg(F.collect_set(F.col("start").cast("long")).alias("starts"))
        return store(starts.join(marked.select("rank", "key", "nth"), "nth").select("rank", "key", "starts"), "windows-starts", result=True)


def removals(docs: DataFrame) -> DataFrame:
    """(rank, key, n_words, whole, starts) once for each, stored: whether all words go, or where repeated windows start (null: nowhere)."""
    texts = keys(docs)
    with dropping(docs.sparkSession):
        by_key, marked = candidates(texts)
        return store(by_key.join(repeats(texts, marked), ["rank", "key"], "left"), "windows-removals", result=True)


def covered(n: int, starts) -> np.ndarray:
    """Which of n words a window starting at one of ``starts`` covers."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.asarray(starts) + WINDOW, -1)
    return np.cumsum(steps[:-1]) > 0


def cut(batches, carried: list[str], digests: bool):
    """Texts without the words to remove: kept words joined by one space; with ``digests`` their SHA-256 instead.

    Where nothing is removed and no digest is asked for, the text stays as it is."""
    for b in pieces(batches, 1 << 20):
        words = Words(b.column("text"))
        whole, starts = b.column("whole").to_pylist(), b.column("starts")
        offsets = np.asarray(starts.offsets) - starts.offsets[0].as_py()
        flat = np.asarray(starts.flatten())
        texts = None if digests else b.column("text").to_pylist()
        removed, out = np.zeros(b.num_rows, np.int64), []
        raw = words.data.tobytes()
        for i in range(b.num_rows):
            lo, hi = words.first[i], words.first[i + 1]
            own = starts[i].is_valid and flat[offsets[i] : offsets[i + 1]]
            gone = np.ones(hi - lo, bool) if whole[i] else covered(hi - lo, own) if own is not False and len(own) else None
            removed[i] = gone.sum() if gone is not None else 0
            if not digests and not removed[i]:
                out.append(texts[i])
                continue
            kept = raw[words.offsets[i] : words.offsets[i + 1]].split() if gone is None else [raw[s:e] for s, e in zip(words.starts[lo:hi][~gone].tolist(), words.ends[lo:hi][~gone].tolist(), strict=True)]
            kept = b" ".join(kept)
            out.append(hashlib.sha256(kept).hexdigest() if digests else kept.decode())
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), pa.array(words.lengths().astype(np.int64)), pa.array(removed), pa.array(out, pa.string())], [*carried, "__rl_words", "__rl_removed", "__rl_out"])


def remove_repeats(docs: DataFrame, carry: dict[str, Column] | None = None, digests: bool = False) -> DataFrame:
    """The columns ``carry`` names (all of ``docs`` if none), with __rl_words, __rl_removed and __rl_out (kept text or digest).

    Null text: no words, stays null (its digest is that of nothing). Null ids come after all others. Rows with the
    same id are one document: none of its windows is removed for the others. Texts shorter than a window stay.
    """
    carry = carry or {c: F.col(c) for c in docs.columns}
    names = [f"__rl_{i}" for i in range(len(carry))]
    told = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("rank"), F.xxhash64("text").alias("key"), F.col("text"), *(c.alias(n) for c, n in zip(carry.values(), names, strict=True)))
    joined = told.join(removals(docs).drop("n_words"), ["rank", "key"]).select("text", F.coalesce("whole", F.lit(False)).alias("whole"), "starts", *names)
    schema = ", ".join([*(f"{n} {told.schema[n].dataType.simpleString()}" for n in names), "__rl_words long, __rl_removed long, __rl_out string"])
    out = joined.mapInArrow(lambda it: cut(it, names, digests), schema)
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, carry, strict=True)), "__rl_words", "__rl_removed", "__rl_out")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """What goes of each of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = remove_repeats(docs.select("doc_id", "text"), {"doc_id": F.col("doc_id")}, digests=True)
    return out.select("doc_id", F.col("__rl_words").alias("n_words"), F.col("__rl_removed").alias("n_removed"), F.col("__rl_out").alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50),
wins AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h FROM starts),
least AS (SELECT h, min(doc_id) AS d FROM wins GROUP BY h),
hit AS (SELECT doc_id, list(DISTINCT i) AS spots FROM wins JOIN least USING (h) WHERE d < doc_id GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM (SELECT doc_id, unnest(spots) AS s FROM hit)),
each_word AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w),
kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.p) AS text, count(*) AS n FROM each_word e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
