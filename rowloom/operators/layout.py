"""Layouts: an order of rows and of fields under which consecutive rows share long prefixes.

``greedy`` takes, again and again, the field that with those taken before has the fewest distinct combinations.
"""

from __future__ import annotations

import random
import time
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import json_string
from ..plans.materialize import materialize, number
from ..sources.cells import CellTable, as_cells

LAYOUTS = ("original", "lexicographic", "random", "random_columns", "cardinality", "greedy")
#: Tables of so many cells at most are planned on the driver, larger ones by Spark; the orders are the same. The driver gets
#: eight bytes for each cell, however long its text.
DRIVER_CELLS = 2_000_000


@dataclass(frozen=True)
class LayoutPlan:
    """Order of fields, and all rows with their place: ``placed`` has ``_pos``, ``_exec_pos`` and the cells.

    ``encoded_bytes`` and ``workspace_bytes``: codes of cells, and numbers of groups, that planning held on the driver."""

    method: str
    column_order: tuple[int, ...]
    columns: tuple[str, ...]
    placed: DataFrame
    table: CellTable
    rows: int
    plan_rows: int
    planning_seconds: float
    group_counts: tuple[int, ...] | None = field(default=None, compare=False)
    encoded_bytes: int = 0
    workspace_bytes: int = 0

    @property
    def order(self) -> DataFrame:
        return self.placed.select("_pos", "_exec_pos")

    @property
    def ordered_columns(self) -> tuple[str, ...]:
        return tuple(self.columns[c] for c in self.column_order)

    def serialized(self) -> DataFrame:
        """(_pos, _exec_pos, state): each row as one JSON object with its fields in this order."""
        return self.placed.select("_pos", "_exec_pos", serialize(self.table, self.column_order).alias("state"))

    def apply(self, df: DataFrame | None = None) -> DataFrame:
        """The rows in order with all fields in order, and ``_exec_pos``; ``df`` has ``_pos`` and the named fields, else the
        cells themselves are shown. A table that isn't the planned one is refused."""
        if df is None:
            cells = (F.col(f"_c{c}").alias(self.columns[c]) for c in self.column_order)
            return self.placed.orderBy("_exec_pos").select("_exec_pos", *cells)
        if tuple(c for c in df.columns if c != "_pos") != self.columns:
            raise ValueError("the plan has other columns")
        if df.count() != self.rows:
            raise ValueError("the plan has another number of rows")
        shown = df.join(self.order, "_pos").orderBy("_exec_pos")
        return shown.select("_exec_pos", *(F.col(f"`{c}`") for c in self.ordered_columns))

    def restore(self, outputs: DataFrame) -> DataFrame:
        """Outputs keyed by ``_exec_pos`` in input order, keyed by ``_pos``; one is needed for each row."""
        if outputs.count() != self.rows:
            raise ValueError("there must be one output for each input row")
        return outputs.join(self.order, "_exec_pos").drop("_exec_pos").orderBy("_pos")


def serialize(table: CellTable, order: Sequence[int]):
    """A row as a JSON object of the fields in ``order``, without spaces."""
    import json

    parts = []
    for at, c in enumerate(order):
        cell = F.col(f"_c{c}")
        parts += [F.lit(("," if at else "{") + json.dumps(table.columns[c], ensure_ascii=False) + ":"), cell if table.json_values else json_string(cell)]
    return F.concat(*parts, F.lit("}")) if parts else F.lit("{}")


def _driver_codes(rows: DataFrame, cells: list[str]) -> np.ndarray:
    """Cells as numbers from 0, equal where texts are (their 64-bit hashes, of which DRIVER_CELLS at most are compared)."""
    import pandas as pd

    table = rows.select(*(F.xxhash64(c).alias(c) for c in cells)).toPandas()
    return np.column_stack([pd.factorize(table[c])[0] for c in cells]).astype(np.int64) if len(cells) else np.zeros((len(table), 0), np.int64)


def dense_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with each of ``columns`` as the rank of its value among those of the column, from 0: numbers for texts in the
    order of texts, and numbers without gaps for sparse or negative ones. Nulls have none."""
    for c in columns:
        col = F.col(f"`{c}`")
        ranked = materialize(number(df.where(col.isNotNull()).select(col.alias("__v")).distinct(), "__code", ["__v"]), "codes")
        df = df.join(ranked, col == F.col("__v"), "left").withColumn(c, F.col("__code")).drop("__v", "__code")
    return df


def code_bytes(values: int) -> int:
    """Bytes of the smallest unsigned number that tells so many values apart."""
    return next(k for k in (1, 2, 4, 8) if values <= 1 << (8 * k))


def encode_cells(table: CellTable) -> tuple[DataFrame, int]:
    """(_pos and the code of each cell, bytes of all codes at the width that the column with most values needs)."""
    coded = materialize(dense_codes(table.frame.select("_pos", *table.cells), table.cells), "encoded")
    most = coded.agg(*(F.coalesce(F.max(c) + 1, F.lit(0)).alias(c) for c in table.cells)).first() if table.cells else ()
    return coded, table.count() * len(table.columns) * code_bytes(max(most, default=0))


def _pairs(groups: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, int]:
    import pandas as pd

    found, values = pd.factorize(groups * (codes.max() + 1) + codes)
    return found.astype(np.int64), len(values)


def greedy_on_driver(codes: np.ndarray) -> tuple[list[int], list[int]]:
    """The greedy order of columns and the number of prefix groups after each."""
    n, m = codes.shape
    groups, count, left, order, curve = np.zeros(n, np.int64), min(n, 1), list(range(m)), [], []
    while left:
        if count == n:
            return order + left, curve + [n] * len(left)
        sized = [(_pairs(groups, codes[:, c])[1], c) for c in left]
        least, best = min(sized)
        same = [c for k, c in sized if k == count] if least == count else [best]
        if least > count:
            groups, count = _pairs(groups, codes[:, best])
        order += same
        curve += [count] * len(same)
        left = [c for c in left if c not in same]
    return order, curve


def greedy_in_spark(rows: DataFrame, cells: list[str]) -> tuple[list[int], list[int]]:
    """The same by Spark jobs: one for the counts of all columns that are left, one to refine the groups.

    Works on distinct rows, as multiplicity changes no count. Groups are named by the least row number in them.
    """
    state = materialize(rows.select(*cells).distinct().withColumn("_gid", F.lit(0).cast("long")).withColumn("_row", F.monotonically_increasing_id()), "plan")
    n = state.count()
    count, left, order, curve = min(n, 1), list(range(len(cells))), [], []
    while left:
        if count == n:
            return order + left, curve + [n] * len(left)
        sizes = state.agg(*(F.count_distinct("_gid", cells[c]).alias(cells[c]) for c in left)).first()
        sized = [(sizes[cells[c]], c) for c in left]
        least, best = min(sized)
        same = [c for k, c in sized if k == count] if least == count else [best]
        order += same
        curve += [least] * len(same)
        left = [c for c in left if c not in same]
        if least > count and left:
            names = state.groupBy("_gid", cells[best]).agg(F.min("_row").alias("_new"))
            state = materialize(state.join(names, ["_gid", cells[best]]).select(F.col("_new").alias("_gid"), "_row", *(cells[c] for c in left)), "plan")
        count = least
    return order, curve


def checked_seed_sample(sample_size):
    if sample_size is not None and (isinstance(sample_size, bool) or not isinstance(sample_size, int) or sample_size < 1):
        raise ValueError("sample_size must be a positive whole number or None")


class LayoutOptimizer:
    """Plans one layout. ``sample_size`` rows, whose positions the driver draws, choose the fields of ``greedy`` and
    ``cardinality``; all rows are sorted. ``random`` sorts by a hash of seed and position at every size."""

    def __init__(self, spark: SparkSession, method: str = "greedy", *, seed: int = 0, sample_size: int | None = None):
        if method not in LAYOUTS:
            raise ValueError(f"no layout {method!r}; there are {', '.join(LAYOUTS)}")
        checked_seed_sample(sample_size)
        self.spark, self.method, self.seed, self.sample_size = spark, method, seed, sample_size

    def plan(self, data, *, columns=None, order_by=None) -> LayoutPlan:
        return self.plan_cells(as_cells(self.spark, data, columns, order_by=order_by))

    def plan_cells(self, table: CellTable) -> LayoutPlan:
        started = time.perf_counter()
        n, m = table.count(), len(table.columns)
        order, planned, counts, held = list(range(m)), n, None, (0, 0)
        rng = random.Random(self.seed)
        frame, cells = table.frame, table.cells
        if self.method == "random":
            rng.shuffle(order)
            placed = number(frame.withColumn("_h", F.md5(F.concat_ws(":", F.lit(self.seed), "_pos").cast("binary"))), "_exec_pos", ["_h", "_pos"], n).drop("_h")
            return LayoutPlan("random", tuple(order), table.columns, placed, table, n, n, time.perf_counter() - started)
        if self.method == "original" or not n or not m:
            placed = frame.withColumn("_exec_pos", F.col("_pos"))
            return LayoutPlan(self.method, tuple(order), table.columns, placed, table, n, n, time.perf_counter() - started)
        chosen = frame
        if self.method in ("greedy", "cardinality") and self.sample_size and self.sample_size < n:
            planned = self.sample_size
            some = self.spark.createDataFrame(pa.table({"_pos": pa.array(rng.sample(range(n), planned), pa.int64())}))
            chosen = frame.join(some, "_pos", "left_semi")
        if self.method == "greedy":
            if planned * m <= DRIVER_CELLS:
                codes = _driver_codes(chosen, cells)
                held = codes.nbytes, codes.nbytes // m
                order, counts = greedy_on_driver(codes)
            else:
                order, counts = greedy_in_spark(chosen, cells)
        elif self.method == "cardinality":
            ndv = chosen.agg(*(F.count_distinct(c).alias(c) for c in cells)).first()
            order.sort(key=lambda c: ndv[c])
        elif self.method == "random_columns":
            rng.shuffle(order)
        placed = number(frame, "_exec_pos", [*(cells[c] for c in order), "_pos"], n)
        return LayoutPlan(self.method, tuple(order), table.columns, placed, table, n, planned, time.perf_counter() - started, tuple(counts) if counts and planned == n else None, *held)

    def explain(self, data, *, columns=None, methods=None, order_by=None):
        from .explain import explain

        methods = tuple(dict.fromkeys(("original", self.method))) if methods is None else tuple(methods)
        return explain(self.spark, as_cells(self.spark, data, columns, order_by=order_by), methods, self.seed, self.sample_size)


def plan_by_group(spark: SparkSession, df: DataFrame, group: str, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Greedy plans of each group by itself: (group, _exec_pos, key columns, state).

    Groups are ready batches, each small enough for one task; a plan over all of them may put a field first that
    differs within every batch.
    """
    from ..functions.text import text_cell

    key, columns = list(key), list(columns)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cells = df.select(F.col(f"`{group}`").alias("g"), *(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(key)), *(text_cell(F.col(f"`{c}`"), kinds[c]).alias(f"_c{i}") for i, c in enumerate(columns)))

    def each(pdf):
        import json

        import pandas as pd

        pdf = pdf.sort_values([f"k{i}" for i in range(len(key))], kind="stable").reset_index(drop=True)
        names = [f"_c{i}" for i in range(len(columns))]
        codes = np.column_stack([pd.factorize(pdf[c])[0] for c in names]).astype(np.int64)
        order, _ = greedy_on_driver(codes)
        pdf = pdf.sort_values([names[c] for c in order], kind="stable").reset_index(drop=True)
        pdf["_exec_pos"] = np.arange(len(pdf))
        rows = zip(*(pdf[names[c]] for c in order), strict=True)
        pdf["state"] = ["{" + ",".join(f"{json.dumps(columns[c], ensure_ascii=False)}:{json.dumps(v, ensure_ascii=False)}" for c, v in zip(order, r, strict=True)) + "}" for r in rows]
        return pdf[["g", "_exec_pos", *(f"k{i}" for i in range(len(key))), "state"]]

    schema = ", ".join([f"g {kinds[group].simpleString()}", "_exec_pos long", *(f"k{i} {kinds[k].simpleString()}" for i, k in enumerate(key)), "state string"])
    out = cells.groupBy("g").applyInPandas(each, schema)
    return out.select(F.col("g").alias(group), "_exec_pos", *(F.col(f"k{i}").alias(k) for i, k in enumerate(key)), "state")
