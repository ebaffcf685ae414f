"""One decision for each row of a table, asked in the order of a layout and answered in the order of the input."""

from __future__ import annotations

import time
import uuid
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.materialize import materialize, number
from ..sources.cells import as_cells
from .decisions import DecisionSpec, decided, valid, valid_response
from .layout import LayoutOptimizer, LayoutPlan

#: A row's timeline. Offsets count from the start of the scan; executors' clocks are theirs, so they compare within a host.
TRACE = "submit_offset_seconds double, request_start_offset_seconds double, complete_offset_seconds double, client_request_seconds double, prompt_tokens long, cached_tokens long, completion_tokens long, created_cache_tokens long, queue_time_ms double, engine_prefill_interval_ms double, generation_time_ms double, request_id string"
COUNTS = ("prompt_tokens", "cached_tokens", "completion_tokens", "created_cache_tokens")


def all_or_unknown(c: str):
    """The sum of a counter if every row has it (of no rows: 0), else null."""
    return F.when(F.count(c) == F.count(F.lit(1)), F.coalesce(F.sum(c), F.lit(0))).alias(c)


@dataclass(frozen=True)
class ScanResult:
    """``frame`` is written: _pos, _exec_pos, decision, probabilities and the trace of each row."""

    frame: DataFrame
    spec: DecisionSpec
    layout: LayoutPlan
    wall_seconds: float
    inference_seconds: float
    preparation_seconds: float

    def decisions(self) -> DataFrame:
        """_pos, decision, and the probability of each option, by input position."""
        names = self.spec.option_columns()
        return self.frame.select("_pos", "decision", *(F.col("probabilities")[i].alias(n) for i, n in enumerate(names))).orderBy("_pos")

    def to_pandas(self):
        """As decisions(), in input order, with the input's own index if it had one."""
        out = self.decisions().toPandas().drop(columns="_pos")
        out["decision"] = out["decision"].map({str(o): o for o in self.spec.options})
        return out if self.layout.table.index is None else out.set_index(self.layout.table.index)

    def traces(self) -> DataFrame:
        wait = F.col("request_start_offset_seconds") - F.col("submit_offset_seconds")
        names = [x.split()[0] for x in TRACE.split(", ")]
        return self.frame.select(F.col("_pos").alias("row_position"), F.col("_exec_pos").alias("execution_position"), *names, F.col("complete_offset_seconds").alias("batch_sojourn_seconds"), wait.alias("executor_wait_seconds"))

    def metrics(self) -> dict:
        return {"method": self.layout.method, "wall_seconds": self.wall_seconds, "preparation_seconds": self.preparation_seconds, "planning_seconds": self.layout.planning_seconds, "inference_seconds": self.inference_seconds, "column_order": list(self.layout.ordered_columns)} | self._measured()

    def _measured(self) -> dict:
        found = scan_metrics(self.frame).first().asDict()
        return found | {"rows_per_second": found["rows"] / self.wall_seconds if self.wall_seconds else 0.0}


def percentiles(df: DataFrame, keys: list[str], column: str, ps: dict[str, float]) -> DataFrame:
    """Exact percentiles of a column in each group of ``keys`` (none: of all rows), interpolated, nulls left out; (keys, rows,
    and a column for each of ``ps``). All rows are sorted once across tasks, and the few ranks wanted are looked up, so no
    task holds a group."""
    safe = [f"__k{i}" for i in range(len(keys))]
    told = df.where(F.col(column).isNotNull()).select(*(F.col(k).alias(s) for k, s in zip(keys, safe, strict=True)), F.col(column).cast("double").alias("__x"))
    placed = number(told.withColumn("__one", F.lit(0)), "__r", [*safe, "__x"])
    by = ["__one", *safe]
    groups = placed.groupBy(*by).agg(F.min("__r").alias("__first"), F.count("*").alias("rows"))
    exact = lambda p: F.col("__first") + (F.col("rows") - 1) * F.lit(float(p))
    wanted = groups.select(*by, "rows", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), exact(p).alias("at")) for n, p in ps.items()))).alias("w"))
    ends = wanted.select(*by, "rows", "w.*", F.explode(F.array_distinct(F.array(F.floor("w.at"), F.ceil("w.at")))).alias("__r"))
    part = F.when(F.floor("at") == F.ceil("at"), 1.0).when(F.col("__r") == F.floor("at"), F.ceil("at") - F.col("at")).otherwise(F.col("at") - F.floor("at"))
    weighed = ends.join(placed.select("__r", "__x"), "__r").withColumn("__w", part * F.col("__x"))
    found = weighed.groupBy(*by).agg(F.max("rows").alias("rows"), *(F.sum(F.when(F.col("name") == n, F.col("__w"))).alias(n) for n in ps))
    return found.select(*(F.col(s).alias(k) for k, s in zip(keys, safe, strict=True)), "rows", *ps)


def scan_metrics(traces: DataFrame) -> DataFrame:
    """One row of totals, percentiles and means of traces; percentiles interpolate, means leave nulls out."""
    mean = lambda c, n: (F.avg(c) * 0.001).alias(n)
    sums = traces.agg(
        F.count(F.lit(1)).alias("rows"), *map(all_or_unknown, COUNTS),
        mean("queue_time_ms", "engine_queue_mean_seconds"), mean("engine_prefill_interval_ms", "engine_prefill_interval_mean_seconds"), mean("generation_time_ms", "engine_generation_mean_seconds"),
    )
    for c, k in (("client_request_seconds", "latency"), ("complete_offset_seconds", "batch_sojourn")):
        names = [f"{k}_p50_seconds", f"{k}_p95_seconds"]
        given = percentiles(traces, [], c, dict(zip(names, (0.5, 0.95), strict=True))).select(*names)
        sums = sums.join(given, how="left").withColumns({n: F.coalesce(n, F.lit(0.0)) for n in names})
    return sums.withColumn("cached_fraction", F.when(F.col("prompt_tokens") > 0, F.col("cached_tokens") / F.col("prompt_tokens")))


def in_turn(items, do, width: int):
    """(item, result or error) of ``do`` for each item, at most ``width`` at a time, in the order of items among those done
    together. The first error stops the asking: what is under way is awaited and given, the rest isn't begun."""
    with ThreadPoolExecutor(width) as pool:
        waiting, items, failed = {}, enumerate(items), False
        while True:
            while not failed and len(waiting) < width and (following := next(items, None)) is not None:
                n, item = following
                waiting[pool.submit(do, item)] = n, item
            if not waiting:
                return
            done, _ = wait(waiting, return_when=FIRST_COMPLETED)
            for future in sorted(done, key=lambda f: waiting[f][0]):
                _, item = waiting.pop(future)
                error = future.exception()
                failed |= error is not None
                yield item, error if error is not None else future.result()


def _ask(batches, backend, spec: DecisionSpec, salt: str | None, started: float, width: int):
    """A row for each request that was made: its answer and trace, or what went wrong."""
    names, kinds = zip(*(x.split() for x in TRACE.split(", ")), strict=True)
    types = [{"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[k] for k in kinds]
    schema = pa.schema([("_pos", pa.int64()), ("_exec_pos", pa.int64()), ("probabilities", pa.list_(pa.float64())), *zip(names, types, strict=True), ("error", pa.string())])

    def rows():
        for b in batches:
            for at, place, state in zip(*(b.column(c).to_pylist() for c in ("_pos", "_exec_pos", "state")), strict=True):
                yield at, place, state, time.time()

    def one(row):
        *_, state, submitted = row
        begun = time.time()
        r = backend.decide(state, spec, cache_salt=salt)
        done = time.time()
        if not valid_response(r.probabilities, len(spec.options)):
            raise ValueError("the answer is no distribution over the options")
        return list(r.probabilities), submitted - started, begun - started, done - started, done - begun, r.prompt_tokens, r.cached_tokens, r.completion_tokens, r.created_cache_tokens, r.queue_time_ms, r.time_to_first_token_ms, r.generation_time_ms, r.request_id, None

    def batch(held):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    try:
        held = []
        for (at, place, *_), found in in_turn(rows(), one, width):
            held.append((at, place, *(found if isinstance(found, tuple) else [None] * (len(schema) - 3) + [str(found)])))
            if len(held) == 1024:
                yield batch(held)
                held = []
        if held:
            yield batch(held)
    finally:
        if hasattr(backend, "close"):
            backend.close()


class DecisionEngine:
    """Scans tables with a backend that gets ``concurrency`` requests at a time.

    There are as many tasks as that, but no more than cores, and they share it. Each gets a run of neighbours in the
    layout's order and asks in that order, so the prefix of one request serves the next; when an answer comes the next
    request goes out. A row without an answer ends its task's asking, not the task, so Spark repeats nothing; the scan
    then fails with the row's position. Tasks lost with an executor are run again: their requests are repeated, and
    ``cache_salt`` with the position names a request.
    """

    def __init__(self, spark: SparkSession, backend, *, concurrency: int = 4):
        if isinstance(concurrency, bool) or not isinstance(concurrency, int) or concurrency < 1:
            raise ValueError("concurrency must be a positive whole number")
        self.spark, self.backend, self.concurrency, self.closed = spark, backend, concurrency, False

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def close(self) -> None:
        if not self.closed and hasattr(self.backend, "close"):
            self.backend.close()
        self.closed = True

    def explain(self, data, *, columns=None, methods=("original", "lexicographic", "random", "greedy"), seed=0, sample_size=None, order_by=None):
        """What layouts share; asks no backend."""
        return LayoutOptimizer(self.spark, seed=seed, sample_size=sample_size).explain(data, columns=columns, methods=methods, order_by=order_by)

    def scan(self, data, question: str, *, columns=None, method="greedy", kind="noul", options=None, seed=0, sample_size=None, cache_salt=None, order_by=None) -> ScanResult:
        if self.closed:
            raise RuntimeError("the engine is closed")
        started, origin = time.perf_counter(), time.time()
        spec = DecisionSpec.create(question, kind, options)
        optimizer = LayoutOptimizer(self.spark, method, seed=seed, sample_size=sample_size)
        table = as_cells(self.spark, data, columns, order_by=order_by)
        if table.count() and hasattr(self.backend, "prepare"):
            self.backend.prepare(spec)
        plan = optimizer.plan_cells(table)
        states = plan.serialized()
        prepared = time.perf_counter()
        if hasattr(self.backend, "column"):
            p = self.backend.column(F.col("state"))
            tokens, none = F.length("state").cast("long"), F.lit(None)
            filled = {"submit_offset_seconds": F.lit(0.0), "request_start_offset_seconds": F.lit(0.0), "complete_offset_seconds": F.lit(0.0), "client_request_seconds": F.lit(0.0), "prompt_tokens": tokens, "cached_tokens": F.lit(0), "completion_tokens": F.lit(1), "created_cache_tokens": F.lit(0)}
            asked = states.withColumn("probabilities", p).select("_pos", "_exec_pos", "probabilities", *(filled.get(n, none).cast(t).alias(n) for n, t in (x.split() for x in TRACE.split(", "))))
            wrong = F.raise_error(F.concat(F.lit("the answer is no distribution at input row position "), F.col("_pos").cast("string")))
            asked = asked.withColumn("probabilities", F.when(valid(F.col("probabilities"), len(spec.options)), F.col("probabilities")).otherwise(wrong))
        else:
            backend, salt = self.backend, cache_salt
            tasks = min(self.concurrency, self.spark.sparkContext.defaultParallelism)
            share, extra = divmod(self.concurrency, tasks)

            def ask(batches):
                from pyspark import TaskContext

                return _ask(batches, backend, spec, salt, origin, share + (TaskContext.get().partitionId() < extra))

            dealt = states.repartitionByRange(tasks, "_exec_pos").sortWithinPartitions("_exec_pos")
            asked = dealt.mapInArrow(ask, f"_pos long, _exec_pos long, probabilities array<double>, {TRACE}, error string")
        frame = materialize(asked.withColumn("decision", decided(F.col("probabilities"), spec.options)), "scan")
        if "error" in frame.columns:
            wrong = frame.where("error is not null").agg(F.min(F.struct("_pos", "error")).alias("x")).first()["x"]
            if wrong:
                raise RuntimeError(f"no decision at input row position {wrong['_pos']}: {wrong['error']}")
            frame = frame.drop("error")
        ended = time.perf_counter()
        return ScanResult(frame, spec, plan, ended - started, ended - prepared, prepared - started - plan.planning_seconds)

    def compare(self, data, question: str, *, methods=("original", "lexicographic", "random", "greedy"), repeats=2, truth=None, columns=None, kind="noul", options=None, seed=0, sample_size=None, order_by=None):
        """Trials of each method with a fresh salt each, in turn forwards and backwards; medians and ratios of them."""
        from .compare import Comparison

        methods = tuple(methods)
        if isinstance(repeats, bool) or not isinstance(repeats, int) or repeats < 1:
            raise ValueError("repeats must be a positive whole number")
        if not methods or len(set(methods)) < len(methods):
            raise ValueError("methods must be given, each once")
        for m in methods:
            LayoutOptimizer(self.spark, m, seed=seed, sample_size=sample_size)
        if not getattr(self.backend, "supports_cache_salt", False):
            raise ValueError("the backend can't keep trials apart by a cache salt")
        table = as_cells(self.spark, data, columns, order_by=order_by)
        labels = None
        if truth is not None:
            labels = truth if isinstance(truth, DataFrame) else self.spark.createDataFrame([(i, str(x)) for i, x in enumerate(truth)], "_pos long, truth string")
            if labels.count() != table.count():
                raise ValueError("truth needs a label for each row")
        runs = []
        for r in range(repeats):
            for m in methods if r % 2 == 0 else methods[::-1]:
                salt = uuid.uuid4().hex
                result = self.scan(table, question, method=m, kind=kind, options=options, seed=seed, sample_size=sample_size, cache_salt=salt)
                runs.append((m, r, salt, result))
        return Comparison.of(self.spark, methods, repeats, runs, labels, table.count())
