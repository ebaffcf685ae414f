"""What layouts share, without a model: distinct values, prefix groups, bytes shared by neighbours."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import shared_prefix
from ..sources.cells import CellTable
from .layout import LayoutOptimizer, LayoutPlan


@dataclass(frozen=True)
class LayoutExplanation:
    rows: int
    columns: tuple[str, ...]
    column_ndv: tuple[int, ...]
    layouts: list[dict]

    def to_dict(self) -> dict:
        return {
            "rows": self.rows,
            "columns": list(self.columns),
            "column_ndv": dict(zip(self.columns, self.column_ndv, strict=True)),
            "layouts": self.layouts,
            "measurement": "UTF-8 bytes of serialized rows, without question and template",
            "interpretation": "Shared prefixes of neighbours describe the input; they predict neither cache hits nor speed.",
        }

    def to_pandas(self):
        import pandas as pd

        return pd.DataFrame(self.layouts).set_index("method")


def column_ndv(table: CellTable) -> tuple[int, ...]:
    if not table.columns:
        return ()
    found = table.frame.agg(*(F.count_distinct(c).alias(c) for c in table.cells)).first()
    return tuple(found[c] for c in table.cells)


def prefix_group_curve(table: CellTable, order) -> DataFrame:
    """(k, groups): distinct combinations of the first k fields in ``order``, of all k by one grouping of the table."""
    names = [f"_c{c}" for c in order]
    every = table.frame.sparkSession.range(1, len(names) + 1).select(F.col("id").cast("int").alias("k"))
    if not names:
        return every.select("k", F.lit(0).cast("long").alias("groups"))
    groups = table.frame.rollup(*names).agg(F.grouping_id().alias("__g"))
    # the fields that a combination leaves out are ones in its grouping, at the end
    counted = groups.groupBy((len(names) - F.bit_count("__g")).cast("int").alias("k")).agg(F.count("*").alias("groups"))
    return every.join(counted, "k", "left").select("k", F.coalesce("groups", F.lit(0)).alias("groups"))


def prefix_group_counts(table: CellTable, order) -> list[int]:
    return [r["groups"] for r in prefix_group_curve(table, order).orderBy("k").collect()] if order else []


def neighbour_bytes(states: DataFrame, order: str = "_exec_pos") -> DataFrame:
    """(_exec_pos, bytes, shared): the length of each state, and the bytes it begins with like the one before.

    Each row meets the one before by a join on positions, so that no task holds all rows.
    """
    before = states.select((F.col(order) + 1).alias(order), F.col("state").alias("before"))
    joined = states.select(order, "state").join(before, order, "left")
    return joined.select(order, F.octet_length("state").cast("long").alias("bytes"), F.coalesce(shared_prefix(F.col("before"), F.col("state")), F.lit(0)).cast("long").alias("shared"))


def report(plan: LayoutPlan) -> dict:
    sums = neighbour_bytes(plan.serialized()).agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("shared"), F.lit(0))).first()
    return {
        "method": plan.method,
        "column_order": list(plan.ordered_columns),
        "prefix_group_counts": list(plan.group_counts) if plan.group_counts else prefix_group_counts(plan.table, plan.column_order),
        "serialized_bytes": sums[0],
        "adjacent_prefix_bytes": sums[1],
        "adjacent_prefix_fraction": sums[1] / sums[0] if sums[0] else 0.0,
        "planning_seconds": plan.planning_seconds,
        "plan_rows": plan.plan_rows,
        "encoded_bytes": plan.encoded_bytes,
        "workspace_bytes": plan.workspace_bytes,
    }


def explain(spark: SparkSession, table: CellTable, methods, seed: int = 0, sample_size: int | None = None) -> LayoutExplanation:
    methods = tuple(methods)
    if not methods or len(set(methods)) < len(methods):
        raise ValueError("methods must be given, each once")
    optimizers = [LayoutOptimizer(spark, m, seed=seed, sample_size=sample_size) for m in methods]
    return LayoutExplanation(table.count(), table.columns, column_ndv(table), [report(o.plan_cells(table)) for o in optimizers])
