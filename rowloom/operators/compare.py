"""Comparisons of layouts: medians over trials, agreement, accuracy, speedups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEDIANS = ("wall_seconds", "planning_seconds", "prompt_tokens", "cached_tokens", "cached_fraction", "accuracy")
RUN = "method string, repeat int, cache_salt string, rows long, wall_seconds double, planning_seconds double, prompt_tokens double, cached_tokens double, cached_fraction double, accuracy double, agreement double"


def accuracy(found: DataFrame, truth: DataFrame, on: str = "_pos") -> DataFrame:
    """(rows, correct, accuracy) of decisions against truth, both text by position."""
    right = F.sum(F.when(F.col("decision") == F.col("truth"), 1).otherwise(0))
    return found.join(truth, on).agg(F.count("*").alias("rows"), right.alias("correct"), (right / F.count("*")).alias("accuracy"))


def agreement(a: DataFrame, b: DataFrame, on: str = "_pos") -> DataFrame:
    """(agreement): the share of rows on which two runs decide alike."""
    other = b.select(on, F.col("decision").alias("other"))
    return a.join(other, on).agg(F.avg((F.col("decision") == F.col("other")).cast("double")).alias("agreement"))


def summarize_runs(runs: DataFrame, baseline: str = "original", candidate: str = "greedy") -> DataFrame:
    """A row for each method: medians of trials, rows a second of the median time, agreement, speedups against both."""
    by = runs.groupBy("method").agg(F.max("rows").alias("rows"), F.count("*").alias("repeats"), *(F.median(c).alias(c) for c in MEDIANS), F.avg("agreement").alias("agreement_with_original"))
    time_of = lambda m: by.where(F.col("method") == m).select(F.col("wall_seconds").alias(f"__{m}"))
    both = by.join(F.broadcast(time_of(baseline)), how="left").join(F.broadcast(time_of(candidate)), how="left")
    ratio = lambda a, b: F.when(b != 0, a / b)
    wall = F.col("wall_seconds")
    return both.select(*by.columns, F.coalesce(ratio(F.col("rows"), wall), F.lit(0.0)).alias("rows_per_second"), ratio(F.col(f"__{baseline}"), wall).alias("speedup_vs_original"), ratio(wall, F.col(f"__{candidate}")).alias("greedy_speedup_vs_this_method"))


@dataclass(frozen=True)
class Comparison:
    runs: DataFrame
    summary: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, methods, repeats, runs, truth: DataFrame | None, rows: int) -> Comparison:
        """``runs``: (method, repeat, salt, result) of each trial."""
        baseline = {r: x for m, r, _, x in runs if m == "original"}
        out = []
        for m, r, salt, x in runs:
            found = x.metrics()
            right = accuracy(x.frame, truth).first()["accuracy"] if truth is not None else None
            alike = agreement(x.frame, baseline[r].frame).first()["agreement"] if r in baseline and rows else None
            number = lambda k: None if found[k] is None else float(found[k])  # noqa: B023, E731
            out.append((m, r, salt, rows, *map(number, MEDIANS[:5]), right, alike))
        frame = spark.createDataFrame(out, RUN)
        return cls(frame, summarize_runs(frame))

    def to_pandas(self):
        return self.summary.toPandas().set_index("method")
