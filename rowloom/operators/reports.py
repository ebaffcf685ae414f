"""Reports of profiling runs: requests, batches, qualities and phases, as DataFrames.

A request is a row with workload, phase, cache_mode, method, batch_id, batch_size, batch_index, repeat, row_id and its
trace; a run is a row with its keys and its metrics.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import json_string
from .scan import percentiles

#: Bins of prompt lengths: above the first, up to the second.
BINS = ((0, 512, "≤512"), (512, 2048, "513–2K"), (2048, 4096, "2–4K"), (4096, 8192, "4–8K"), (8192, float("inf"), ">8K"))
PAIR = ("batch_id", "batch_size", "batch_index", "repeat")
PHASES = ("client", "queue", "prefill_and_first_token", "decode_after_first_token", "client_and_other")


def request_rows(single: DataFrame, batches: DataFrame, quality: DataFrame) -> DataFrame:
    """One table of three kinds of requests, named by ``phase``."""
    named = [df.select(F.lit(n).alias("phase"), "*") for n, df in (("single", single), ("batch", batches), ("quality", quality))]
    return named[0].unionByName(named[1], allowMissingColumns=True).unionByName(named[2], allowMissingColumns=True)


def write_requests(requests: DataFrame, path: str) -> None:
    requests.write.mode("overwrite").json(path)


def quality_by_method(requests: DataFrame) -> DataFrame:
    """(method, rows, correct, accuracy)."""
    right = F.sum(F.col("correct").cast("long"))
    return requests.groupBy("method").agg(F.count("*").alias("rows"), right.alias("correct"), (right / F.count("*")).alias("accuracy"))


def paired_outcomes(requests: DataFrame, baseline: str = "original", candidate: str = "greedy") -> DataFrame:
    """What a layout changes, on the same rows: shares and counts of agreements, fixes and breaks, in one row.

    Runs over different rows are an error.
    """
    side = lambda m, p: requests.where(F.col("method") == m).select("row_id", F.col("decision").alias(f"{p}_d"), F.col("correct").alias(f"{p}_c"))
    both = side(baseline, "a").join(side(candidate, "b"), "row_id", "full_outer")
    same, a, b = F.col("a_d") == F.col("b_d"), F.col("a_c"), F.col("b_c")
    checked = F.when(a.isNull() | b.isNull(), F.raise_error(F.lit("the layouts hold different rows")).cast("long")).otherwise(1)
    n = F.sum(checked)
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    return both.agg(
        F.coalesce(n, F.lit(0)).alias("rows"), F.coalesce(count(same) / n, F.lit(0.0)).alias("agreement"), count(same & a).alias("same_correct"), count(same & ~a).alias("same_wrong"),
        count(~same & b & ~a).alias("fixes"), count(~same & a & ~b).alias("breaks"), count(~same & (a == b)).alias("both_wrong_different"),
        (count(b) / n - count(a) / n).alias("accuracy_delta"),
    )


def roll_up(batches: DataFrame) -> DataFrame:
    """Batches of each method as one run: sums first, then ratios of the sums."""
    s = lambda c: F.sum(c)
    return batches.groupBy("method").agg(s("rows").alias("rows"), s("wall_seconds").alias("wall_seconds"), (s("rows") / s("wall_seconds")).alias("rows_per_second"), s("prompt_tokens").alias("prompt_tokens"), s("cached_tokens").alias("cached_tokens"), F.when(s("prompt_tokens") > 0, s("cached_tokens") / s("prompt_tokens")).alias("cached_fraction"), (s("correct") / s("rows")).alias("accuracy"))


def batch_medians(runs: DataFrame) -> DataFrame:
    """Medians of each batch size and method."""
    names = ("wall_seconds", "rows_per_second", "cached_fraction", "prompt_tokens", "accuracy", "agreement_with_original")
    return runs.groupBy("batch_size", "method").agg(F.count("*").alias("runs"), *(F.median(c).alias(f"{c}_median") for c in names))


def paired_speedups(runs: DataFrame, baseline: str = "original", candidate: str = "greedy") -> DataFrame:
    """Median, least and largest of the ratios of times within pairs, for each batch size."""
    side = lambda m, n: runs.where(F.col("method") == m).select(*PAIR, F.col("wall_seconds").alias(n))
    x = F.col("a") / F.col("b")
    return side(baseline, "a").join(side(candidate, "b"), list(PAIR)).groupBy("batch_size").agg(F.lit(baseline).alias("baseline"), F.lit(candidate).alias("candidate"), F.count("*").alias("pairs"), F.median(x).alias("speedup_median"), F.min(x).alias("speedup_min"), F.max(x).alias("speedup_max"))


def latency_bins(requests: DataFrame) -> DataFrame:
    """Medians of single requests by length of the prompt; bins without requests are left out."""
    label = F.lit(None).cast("string")
    for low, high, name in BINS:
        label = F.when((F.col("local_prompt_tokens") > low) & (F.col("local_prompt_tokens") <= high), name).otherwise(label)
    binned = requests.withColumn("label", label).where("label is not null")
    values = {"tokens": F.col("local_prompt_tokens"), "client_seconds": F.col("client_request_seconds"), "prefill_seconds": F.col("engine_prefill_interval_ms") / 1000, "queue_seconds": F.col("queue_time_ms") / 1000}
    long = binned.select("label", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), v.cast("double").alias("x")) for n, v in values.items()))).alias("v")).select("label", "v.*")
    medians = percentiles(long, ["label", "name"], "x", {"median": 0.5})
    wide = medians.groupBy("label").agg(*(F.max(F.when(F.col("name") == n, F.col("median"))).alias(n) for n in values))
    return wide.join(binned.groupBy("label").agg(F.count("*").alias("samples")), "label")


def cache_causality(enabled: DataFrame, disabled: DataFrame) -> DataFrame:
    """Medians of each method with the cache on and off, at the largest batch size that both have."""
    sizes = enabled.select("batch_size").intersect(disabled.select("batch_size")).agg(F.max("batch_size").alias("batch_size"))
    medians = lambda df, p: df.join(F.broadcast(sizes), "batch_size").groupBy("batch_size", "method").agg(F.median("wall_seconds").alias(f"cache_{p}_wall_seconds"), F.median("cached_fraction").alias(f"cache_{p}_cached_fraction"))
    return medians(disabled, "off").join(medians(enabled, "on"), ["batch_size", "method"])


def microbatches(runs: DataFrame) -> DataFrame:
    return runs.groupBy("method", "batch_size").agg(F.median("wall_seconds").alias("wall_seconds"), F.median("batch_sojourn_p95_seconds").alias("batch_sojourn_p95_seconds"), F.median("accuracy").alias("accuracy"))


def phase_profile(requests: DataFrame) -> DataFrame:
    """(method, phase, requests, mean_ms, median_ms, p95_ms, min_ms, max_ms) of five intervals.

    What the client waits beyond the server's intervals is the fifth; a negative one, and a missing interval, is an error.
    """
    client = F.col("client_request_seconds") * 1000
    queue, first, decode = F.col("queue_time_ms"), F.col("engine_prefill_interval_ms"), F.col("generation_time_ms")
    other = client - queue - first - decode
    whole = client.isNotNull() & queue.isNotNull() & first.isNotNull() & decode.isNotNull() & F.col("completion_tokens").isNotNull()
    fault = lambda t: F.raise_error(F.lit(t)).cast("double")
    rest = F.when(~whole, fault("a request lacks an interval")).when(other < -1e-6, fault("a client's time is less than the server's")).otherwise(F.greatest(other, F.lit(0.0)))
    kinds = F.explode(F.array(*(F.struct(F.lit(n).alias("phase"), v.cast("double").alias("ms")) for n, v in zip(PHASES, (client, queue, first, decode, rest), strict=True))))
    rows = requests.select("method", kinds.alias("x")).select("method", "x.phase", "x.ms")
    ranks = percentiles(rows, ["method", "phase"], "ms", {"median_ms": 0.5, "p95_ms": 0.95}).drop("rows")
    return rows.groupBy("method", "phase").agg(F.count("*").alias("requests"), F.avg("ms").alias("mean_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms")).join(ranks, ["method", "phase"])


def phase_comparison(profile: DataFrame, baseline: str = "original", candidate: str = "greedy") -> DataFrame:
    """Speedups of the first token (median, mean) and of the client (mean), and whether no request decodes; one row.

    Profiles over different numbers of requests are an error.
    """
    of = lambda m, p, c: F.max(F.when((F.col("method") == m) & (F.col("phase") == p), F.col(c)))
    ratio = lambda p, c: of(baseline, p, c) / of(candidate, p, c)
    n = F.when(of(baseline, "client", "requests") != of(candidate, "client", "requests"), F.raise_error(F.lit("the layouts hold different numbers of requests")).cast("long")).otherwise(of(baseline, "client", "requests"))
    return profile.agg(n.alias("requests"), ratio(PHASES[2], "median_ms").alias("first_token_median_speedup"), ratio(PHASES[2], "mean_ms").alias("first_token_mean_speedup"), ratio("client", "mean_ms").alias("client_mean_speedup"), (F.max(F.when(F.col("phase") == PHASES[3], F.col("max_ms"))) == 0).alias("no_decode_time"))


def select_quantiles(items: DataFrame, count: int, length: str = "length", row_id: str = "row_id") -> DataFrame:
    """``count`` rows evenly spaced in the order of (length, row_id), the ends among them; all rows if there are no more."""
    from ..plans.materialize import number

    n = items.count()
    if n <= count:
        return items
    ranks = [n // 2] if count == 1 else [round(i * (n - 1) / (count - 1)) for i in range(count)]
    return number(items, "_rank", [length, row_id], n).where(F.col("_rank").isin(ranks)).drop("_rank")


def same_batches(a: DataFrame, b: DataFrame) -> bool:
    """Whether two reports hold the same batches."""
    keys = ["batch_id", "batch_size", "batch_index"]
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def require_metrics(traces: DataFrame, cache_mode: str, allow_missing: bool = False) -> None:
    """Refuses cached tokens where the cache is off, and requests without the server's times."""
    found = traces.agg(F.sum("cached_tokens"), F.sum(F.when(F.col("queue_time_ms").isNull() | F.col("engine_prefill_interval_ms").isNull(), 1).otherwise(0))).first()
    if cache_mode == "disabled" and found[0]:
        raise RuntimeError("the server is said not to cache, but reports cached tokens")
    if found[1] and not allow_missing:
        raise RuntimeError(f"{found[1]} requests lack the server's times")


def measured(result_frame: DataFrame, labelled: DataFrame) -> DataFrame:
    """Traces with the row's id, group, gold label and whether the decision is right; by position."""
    return result_frame.join(labelled, "_pos").withColumn("correct", F.col("decision") == F.col("gold"))


#: Rows whose digests are hashed together.
HASHED = 65_536


def tree_digest(df: DataFrame, text: str, order_by: str) -> DataFrame:
    """(sha256): a digest of rows of text in order, as a tree: of the digests of runs of HASHED rows, each of its rows' digests.
    For tables of any size; not the digest of the joined text, which only one task can make (``joined_digest``)."""
    from ..plans.materialize import number

    placed = number(df.select(order_by, F.sha2(F.col(text), 256).alias("d")), "at", [order_by])
    joined = lambda at, d: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(at, d))), lambda x: x[d]), "\n"), 256)
    runs = placed.groupBy(F.floor(F.col("at") / HASHED).alias("run")).agg(joined("at", "d").alias("d"))
    return runs.agg(joined("run", "d").alias("sha256"))


def joined_digest(df: DataFrame, keys: list[str], text: str, order_by: str, separator: str = "\n") -> DataFrame:
    """(keys, sha256): the digest of each group's texts in order, joined by ``separator``. A group is text for one task."""
    texts = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order_by).alias("o"), F.col(text).alias("t")))), lambda x: x["t"])
    return df.groupBy(*keys).agg(F.sha2(F.array_join(texts, separator).cast("binary"), 256).alias("sha256"))


def batch_table(rows: DataFrame, batch: str = "batch", row_id: str = "row_id", group: str = "group_id", place: str = "place") -> DataFrame:
    """(batch, batch_id, rows, group_count) of ready batches: the id is the first 16 digits of the digest of the row ids in order."""
    ids = joined_digest(rows, [batch], row_id, place).select(batch, F.substring("sha256", 1, 16).alias("batch_id"))
    return ids.join(rows.groupBy(batch).agg(F.count("*").alias("rows"), F.count_distinct(group).alias("group_count")), batch)


def records_digest(df: DataFrame, columns: list[str], order_by: str) -> DataFrame:
    """(sha256): the digest of a table of texts as one JSON array of records, as a dataset is known by; for tables that are
    one task's text. Slashes are escaped, as pandas writes them."""
    quoted = lambda c: F.replace(json_string(c), F.lit("/"), F.lit("\\/"))
    parts = [x for i, c in enumerate(columns) for x in (F.lit(("," if i else "{") + json.dumps(c) + ":"), quoted(F.col(f"`{c}`")))]
    whole = F.transform(F.sort_array(F.collect_list(F.struct("o", "t"))), lambda x: x["t"])
    return df.select(F.col(order_by).alias("o"), F.concat(*parts, F.lit("}")).alias("t")).agg(F.sha2(F.concat(F.lit("["), F.array_join(whole, ","), F.lit("]")).cast("binary"), 256).alias("sha256"))


def describe(df: DataFrame, columns: list[str], tokens) -> DataFrame:
    """(column, ndv, least, most, tokens, reusable): token counts of fields; a field is reusable if it has fewer values than rows."""
    cells = df.select(F.explode(F.create_map(*(x for c in columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))))).alias("column", "value"))
    counted = cells.groupBy("column", "value").agg(F.count("*").alias("n")).withColumn("t", tokens(F.col("value")))
    by = counted.groupBy("column").agg(F.count("*").alias("ndv"), F.min("t").alias("least"), F.max("t").alias("most"), F.sum(F.col("t") * F.col("n")).alias("tokens"), F.sum("n").alias("rows"))
    return by.withColumn("reusable", F.col("ndv") < F.col("rows")).withColumn("share", F.sum(F.when(F.col("reusable"), F.col("tokens")).otherwise(0)).over(W.partitionBy()) / F.sum("tokens").over(W.partitionBy()))
