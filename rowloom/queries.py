"""The engine's queries over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

import random
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import canonical_cell, float_text, shared_prefix, text_cell
from .operators import compare, reports
from .operators.backends import KeywordBackend
from .operators.decisions import DecisionSpec, decided, normalised, softmax, valid
from .operators.explain import column_ndv, neighbour_bytes, prefix_group_curve
from .operators.layout import LayoutOptimizer, plan_by_group
from .operators.scan import DecisionEngine, scan_metrics
from .plans.materialize import discard, number, shared_folder
from .sources.cells import of_dataframe
from .sources.jsonio import parse_texts, read_json_file
from .sources.workloads import CHOICES as CONTRACT_CHOICES
from .sources.workloads import annotated, correlated, coverage_batches, expand_history, interleaved_batches, load_contract_nli, load_mind, prompt_filter, refunds, shared, unique_identifiers

QUERIES: dict = {}
SQL: dict[str, str] = {}
ORDERS = ["o_custkey", "o_orderstatus", "o_orderpriority"]
QUESTION = "Is the text in a Romance language?"
KEYWORDS = [["the", "and"], ["de", "la"]]
CHOICES = ("English", "Spanish", "French")
#: Plans of 20 columns at 0.75 s for 20,000 rows are the published figure; this is the table for it.
PLANNER = (20_000, 20)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def orders(spark, sf_dir):
    return of_dataframe(read(spark, sf_dir, "orders").select("o_orderkey", *ORDERS), order_by=["o_orderkey"])


def planned(spark, sf_dir, method: str) -> DataFrame:
    """The place of each order under a layout of three of its fields."""
    table = of_dataframe(read(spark, sf_dir, "orders").select("o_orderkey", *ORDERS), order_by=["o_orderkey"])
    from .sources.cells import CellTable

    three = CellTable(table.frame.select("_pos", *(F.col(f"_c{i + 1}").alias(f"_c{i}") for i in range(3))), tuple(ORDERS))
    plan = LayoutOptimizer(spark, method).plan_cells(three)
    return plan.order.select("_pos", "_exec_pos")


_POS = "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS _pos, CAST(o_custkey AS VARCHAR) AS a, o_orderstatus AS b, o_orderpriority AS c FROM orders"
_SUBSETS = f"""t AS ({_POS}),
n AS (SELECT count(DISTINCT a) AS a, count(DISTINCT b) AS b, count(DISTINCT c) AS c, count(DISTINCT (a, b)) AS ab, count(DISTINCT (a, c)) AS ac, count(DISTINCT (b, c)) AS bc, count(DISTINCT (a, b, c)) AS abc FROM t)"""
_GREEDY = f"""{_SUBSETS},
g1 AS (SELECT *, CASE WHEN a <= b AND a <= c THEN 1 WHEN b <= c THEN 2 ELSE 3 END AS x FROM n),
g2 AS (SELECT *, CASE x WHEN 1 THEN CASE WHEN ab <= ac THEN 2 ELSE 3 END WHEN 2 THEN CASE WHEN ab <= bc THEN 1 ELSE 3 END ELSE CASE WHEN ac <= bc THEN 1 ELSE 2 END END AS y FROM g1),
g AS (SELECT *, 6 - x - y AS z, [a, b, c][x] AS n1, CASE x + y WHEN 3 THEN ab WHEN 4 THEN ac ELSE bc END AS n2, abc AS n3 FROM g2)"""


def _placed(keys: str) -> str:
    return f"WITH {_GREEDY} SELECT _pos, row_number() OVER (ORDER BY {keys}, _pos) - 1 AS _exec_pos FROM t, g"


@query(f"SELECT _pos, _pos AS _exec_pos FROM ({_POS})")
def layout_original(spark, sf_dir):
    return planned(spark, sf_dir, "original")


@query(_placed("t.a, t.b, t.c"))
def layout_lexicographic(spark, sf_dir):
    return planned(spark, sf_dir, "lexicographic")


@query(_placed("CASE WHEN g.b <= g.a AND g.b <= g.c THEN [t.b] || CASE WHEN g.a <= g.c THEN [t.a, t.c] ELSE [t.c, t.a] END WHEN g.a <= g.c THEN [t.a] || CASE WHEN g.b <= g.c THEN [t.b, t.c] ELSE [t.c, t.b] END ELSE [t.c] || CASE WHEN g.a <= g.b THEN [t.a, t.b] ELSE [t.b, t.a] END END"))
def layout_cardinality(spark, sf_dir):
    return planned(spark, sf_dir, "cardinality")


@query(_placed("[t.a, t.b, t.c][g.x], [t.a, t.b, t.c][g.y], [t.a, t.b, t.c][g.z]"))
def layout_greedy(spark, sf_dir):
    """The flagship: where greedy joint-distinct planning puts each order."""
    return planned(spark, sf_dir, "greedy")


@query(f"SELECT _pos, row_number() OVER (ORDER BY md5('0:' || _pos), _pos) - 1 AS _exec_pos FROM ({_POS})")
def layout_random(spark, sf_dir):
    """Rows by a hash of seed 0 and position."""
    return planned(spark, sf_dir, "random")


def _shuffled(n: int, seed: int = 0) -> list[int]:
    order = list(range(n))
    random.Random(seed).shuffle(order)
    return order


@query(f"SELECT _pos, row_number() OVER (ORDER BY {', '.join('abc'[c] for c in _shuffled(3))}, _pos) - 1 AS _exec_pos FROM ({_POS})")
def layout_random_columns(spark, sf_dir):
    """Rows sorted by fields in an order that Python's generator shuffles from seed 0."""
    return planned(spark, sf_dir, "random_columns")


def greedy_sql(rows: str, cells: list[str], group: str = "1") -> str:
    """CTEs for DuckDB: ``t`` is the query ``rows``, ``g`` has (grp, ord, curve): the greedy order of the columns ``cells`` and the
    groups after each, for each value of ``group``. Every set of columns is counted; sets are numbered by their bits."""
    sets = range(1, 1 << len(cells))
    counts = ", ".join(f"count(DISTINCT ({', '.join(c for i, c in enumerate(cells) if m >> i & 1)},))" if m.bit_count() > 1 else f"count(DISTINCT {cells[m.bit_length() - 1]})" for m in sets).replace(",))", "))")
    return f"""RECURSIVE t AS ({rows}),
cnt AS (SELECT {group} AS grp, unnest([{", ".join(map(str, sets))}]) AS mask, unnest([{counts}]) AS n FROM t GROUP BY {group}),
steps(grp, mask, ord, curve) AS (SELECT DISTINCT grp, 0, CAST([] AS INT[]), CAST([] AS BIGINT[]) FROM cnt UNION ALL
  SELECT grp, mask | (1 << b), list_append(ord, b), list_append(curve, n) FROM (SELECT s.grp, s.mask, ord, curve, arg_min(CAST(x.b AS INT), cnt.n * {len(cells)} + x.b) AS b, min(cnt.n) AS n
    FROM steps s, range({len(cells)}) x(b), cnt WHERE (s.mask >> x.b) & 1 = 0 AND cnt.grp = s.grp AND cnt.mask = (s.mask | (1 << x.b)) GROUP BY s.grp, s.mask, ord, curve)),
g AS (SELECT grp, ord, curve FROM steps WHERE len(ord) = {len(cells)})"""


@query(f"WITH {_GREEDY} SELECT * FROM (SELECT 1 AS step, x - 1 AS field, n1 AS groups FROM g UNION ALL SELECT 2, y - 1, n2 FROM g UNION ALL SELECT 3, z - 1, n3 FROM g)")
def greedy_column_order(spark, sf_dir):
    from .operators.layout import greedy_in_spark

    rows = read(spark, sf_dir, "orders").select(*(F.col(c).cast("string").alias(f"_c{i}") for i, c in enumerate(ORDERS)))
    order, curve = greedy_in_spark(rows, ["_c0", "_c1", "_c2"])
    return spark.createDataFrame([(i + 1, c, n) for i, (c, n) in enumerate(zip(order, curve, strict=True))], "step int, field int, groups long")


LINE = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_suppkey"]


def lines(spark, sf_dir):
    from .sources.cells import CellTable

    df = read(spark, sf_dir, "lineitem")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return CellTable(df.select(*(text_cell(F.col(c), kinds[c]).alias(f"_c{i}") for i, c in enumerate(LINE))), tuple(LINE))


@query("SELECT unnest(['l_returnflag', 'l_linestatus', 'l_linenumber', 'l_quantity', 'l_suppkey']) AS field, unnest([count(DISTINCT l_returnflag), count(DISTINCT l_linestatus), count(DISTINCT l_linenumber), count(DISTINCT l_quantity), count(DISTINCT l_suppkey)]) AS ndv FROM lineitem")
def column_distinct_values(spark, sf_dir):
    return spark.createDataFrame(list(zip(LINE, column_ndv(lines(spark, sf_dir)), strict=True)), "field string, ndv long")


@query("SELECT unnest([1, 2, 3, 4, 5]) AS k, unnest([count(DISTINCT l_returnflag), count(DISTINCT (l_returnflag, l_linestatus)), count(DISTINCT (l_returnflag, l_linestatus, l_linenumber)), count(DISTINCT (l_returnflag, l_linestatus, l_linenumber, l_quantity)), count(DISTINCT (l_returnflag, l_linestatus, l_linenumber, l_quantity, l_suppkey))]) AS groups FROM lineitem")
def prefix_groups(spark, sf_dir):
    return prefix_group_curve(lines(spark, sf_dir), range(5))


CUSTOMER = ["c_mktsegment", "c_nationkey", "c_acctbal", "c_name", "c_custkey"]
_STATE = """'{"c_mktsegment":"' || c_mktsegment || '","c_nationkey":"' || c_nationkey || '","c_acctbal":"' || CAST(c_acctbal AS VARCHAR) || '","c_name":"' || c_name || '","c_custkey":"' || c_custkey || '"}'"""
_STATES = f"SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS _pos, row_number() OVER (ORDER BY c_mktsegment, CAST(c_nationkey AS VARCHAR), CAST(c_acctbal AS VARCHAR), c_name, c_custkey) - 1 AS _exec_pos, {_STATE} AS state FROM customer"


def customer_states(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select(*CUSTOMER)
    return LayoutOptimizer(spark, "lexicographic").plan(df, order_by=["c_custkey"]).serialized()


@query(_STATES)
def serialize_rows(spark, sf_dir):
    return customer_states(spark, sf_dir)


@query(f"""WITH s AS ({_STATES}), p AS (SELECT _exec_pos, state, lag(state) OVER (ORDER BY _exec_pos) AS before FROM s)
SELECT _exec_pos, CAST(strlen(state) AS BIGINT) AS bytes, CAST(coalesce(len(list_filter(range(1, length(state) + 1), lambda i: state[1:i] = before[1:i])), 0) AS BIGINT) AS shared FROM p""")
def neighbour_prefixes(spark, sf_dir):
    return neighbour_bytes(customer_states(spark, sf_dir))


@query("""WITH d AS (SELECT doc_id, hex(encode(text)) AS a, lag(hex(encode(text))) OVER (ORDER BY doc_id) AS b FROM documents),
n AS (SELECT doc_id, a, b, least(length(a), length(b)) // 2 AS m FROM d)
SELECT doc_id, CAST(CASE WHEN b IS NULL THEN 0 ELSE coalesce(list_filter(range(1, m + 1), lambda i: a[2 * i - 1:2 * i] <> b[2 * i - 1:2 * i])[1] - 1, m) END AS BIGINT) AS shared FROM n""")
def shared_utf8_prefix(spark, sf_dir):
    """Bytes that neighbouring documents begin with alike; split characters count by bytes."""
    docs = number(read(spark, sf_dir, "documents").select("doc_id", "text"), "at", ["doc_id"])
    before = docs.select((F.col("at") + 1).alias("at"), F.col("text").alias("before"))
    return docs.join(before, "at", "left").select("doc_id", F.coalesce(shared_prefix(F.col("before"), F.col("text")), F.lit(0)).cast("long").alias("shared"))


@query("SELECT event_id, CAST(value AS VARCHAR) AS value, CASE WHEN date_part('microseconds', ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS ts, CASE WHEN value > 10 THEN 'True' ELSE 'False' END AS large, CASE WHEN value > 10 THEN event_type ELSE 'None' END AS kind FROM events")
def text_cells(spark, sf_dir):
    df = read(spark, sf_dir, "events").withColumn("large", F.col("value") > 10).withColumn("kind", F.when(F.col("value") > 10, F.col("event_type")))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select("event_id", *(text_cell(F.col(c), kinds[c]).alias(c) for c in ("value", "ts", "large", "kind")))


@query("""SELECT event_id, '{"a":[' || user_id || ',null],"b":{"k":' || (props->>'$.k') || ',"type":"' || event_type || '"}}' AS cell FROM events""")
def json_canonical(spark, sf_dir):
    props = F.struct(F.col("event_type").alias("type"), F.from_json("props", "k int")["k"].alias("k"))
    cell = F.struct(props.alias("b"), F.array(F.col("user_id"), F.lit(None).cast("long")).alias("a"))
    return read(spark, sf_dir, "events").select("event_id", canonical_cell(cell).alias("cell"))


_LINES = {"noul": "false' || chr(10) || 'true", "score": "' || chr(10) || '".join("012345"), "choice": "' || chr(10) || '".join(f"{'ABC'[i]}) {x}" for i, x in enumerate(CHOICES))}


def _prompt(kind: str) -> str:
    return f"SELECT doc_id, sha256('[kind] {kind}' || chr(10) || '[state] ' || text || chr(10) || '[question] {QUESTION}' || chr(10) || '[options]' || chr(10) || '{_LINES[kind]}' || chr(10) || '[decision]:') AS prompt FROM documents"


def prompts(spark, sf_dir, kind: str):
    spec = DecisionSpec.create(QUESTION, kind, CHOICES if kind == "choice" else None)
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(spec.prompt_column(F.col("text")), 256).alias("prompt"))


@query(_prompt("noul"))
def prompt_noul(spark, sf_dir):
    return prompts(spark, sf_dir, "noul")


@query(_prompt("choice"))
def prompt_choice(spark, sf_dir):
    return prompts(spark, sf_dir, "choice")


@query(_prompt("score"))
def prompt_score(spark, sf_dir):
    return prompts(spark, sf_dir, "score")


def _times(word: str) -> str:
    return f"(length(state) - length(replace(state, '{word}', ''))) / {len(word)}.0"


_DECIDED = f"""WITH s AS (SELECT doc_id, '{{"doc_id":"' || doc_id || '","source":"' || source || '","text":' || to_json(text) || '}}' AS state FROM documents),
k AS (SELECT doc_id, {" + ".join(map(_times, KEYWORDS[0]))} AS a, {" + ".join(map(_times, KEYWORDS[1]))} AS b FROM s),
p AS (SELECT doc_id, exp(a - greatest(a, b)) AS x, exp(b - greatest(a, b)) AS y FROM k)"""


@query(f"{_DECIDED} SELECT doc_id, CASE WHEN y > x THEN 'True' ELSE 'False' END AS decision, round(y / (x + y), 9) AS p_true FROM p")
def decide_offline(spark, sf_dir):
    """A whole scan of whole texts with a backend of keywords: does the record use Romance articles more than English words?"""
    df = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    result = DecisionEngine(spark, KeywordBackend(KEYWORDS)).scan(df, QUESTION, order_by=["doc_id"])
    keys = result.layout.table.frame.select("_pos", F.col("_c0").cast("long").alias("doc_id"))
    return result.frame.join(keys, "_pos").select("doc_id", "decision", F.round(F.col("probabilities")[1], 9).alias("p_true"))


@query("""WITH k AS (SELECT item_id, length(text) % 3 + 0.25 AS a, length(text) % 5 + 0.5 AS b, length(text) % 7 - 1.0 AS c FROM benchmark),
e AS (SELECT item_id, exp((a - greatest(a, b, c)) / 1.5) AS a, exp((b - greatest(a, b, c)) / 1.5) AS b, exp((c - greatest(a, b, c)) / 1.5) AS c FROM k)
SELECT item_id, round(a / (a + b + c), 9) AS p_a, round(b / (a + b + c), 9) AS p_b, CASE WHEN a >= b AND a >= c THEN 'English' WHEN b >= c THEN 'Spanish' ELSE 'French' END AS decision, true AS valid FROM e""")
def calibrated_softmax(spark, sf_dir):
    n = F.length("text")
    logs = F.array((n % 3).cast("double"), (n % 5).cast("double"), (n % 7).cast("double"))
    p = softmax(logs, F.array(F.lit(0.25), F.lit(0.5), F.lit(-1.0)), 1.5)
    return read(spark, sf_dir, "benchmark").withColumn("p", p).select("item_id", F.round(F.col("p")[0], 9).alias("p_a"), F.round(F.col("p")[1], 9).alias("p_b"), decided(F.col("p"), CHOICES).alias("decision"), valid(F.col("p"), 3).alias("valid"))


@query("SELECT event_id, round(value / (value + user_id + 1), 9) AS share FROM events")
def renormalised(spark, sf_dir):
    p = normalised(F.array(F.col("value"), (F.col("user_id") + 1).cast("double")))
    return read(spark, sf_dir, "events").select("event_id", F.round(p[0], 9).alias("share"))


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS _pos, CAST(value AS VARCHAR) AS value FROM events")
def restore_order(spark, sf_dir):
    """Outputs of a sorted layout, put back in input order."""
    df = read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    plan = LayoutOptimizer(spark, "cardinality").plan(df, order_by=["event_id"])
    outputs = plan.apply().select("_exec_pos", "value")
    return plan.restore(outputs).select("_pos", "value")


# Traces of requests, made of events so that both sides have the same.
_TRACES = """SELECT event_id, value / 10 AS client_request_seconds, (event_id % 997) / 100.0 AS complete_offset_seconds, user_id + 100 AS prompt_tokens, user_id AS cached_tokens, CASE WHEN user_id > 0 THEN 1 END AS completion_tokens,
CASE WHEN event_id % 3 > 0 THEN value END AS queue_time_ms, value * 2 AS engine_prefill_interval_ms, value / 2 AS generation_time_ms FROM events"""


def traces(spark, sf_dir):
    v, e, u = F.col("value"), F.col("event_id"), F.col("user_id")
    none = F.lit(None)
    return read(spark, sf_dir, "events").select("event_id", (v / 10).alias("client_request_seconds"), (e % 997 / 100.0).alias("complete_offset_seconds"), (u + 100).alias("prompt_tokens"), u.alias("cached_tokens"), F.when(u > 0, 1).cast("long").alias("completion_tokens"), none.cast("long").alias("created_cache_tokens"), F.when(e % 3 > 0, v).alias("queue_time_ms"), (v * 2).alias("engine_prefill_interval_ms"), (v / 2).alias("generation_time_ms"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


@query(f"""WITH t AS ({_TRACES}) SELECT count(*) AS rows, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens, CASE WHEN count(completion_tokens) = count(*) THEN CAST(sum(completion_tokens) AS BIGINT) END AS completion_tokens, CAST(NULL AS BIGINT) AS created_cache_tokens,
round(quantile_cont(client_request_seconds, 0.5), 9) AS latency_p50_seconds, round(quantile_cont(client_request_seconds, 0.95), 9) AS latency_p95_seconds, round(quantile_cont(complete_offset_seconds, 0.5), 9) AS batch_sojourn_p50_seconds, round(quantile_cont(complete_offset_seconds, 0.95), 9) AS batch_sojourn_p95_seconds,
round(avg(queue_time_ms) * 0.001, 9) AS engine_queue_mean_seconds, round(avg(engine_prefill_interval_ms) * 0.001, 9) AS engine_prefill_interval_mean_seconds, round(avg(generation_time_ms) * 0.001, 9) AS engine_generation_mean_seconds, round(sum(cached_tokens) / sum(prompt_tokens), 9) AS cached_fraction FROM t""")
def scan_totals(spark, sf_dir):
    return rounded(scan_metrics(traces(spark, sf_dir)), "latency_p50_seconds", "latency_p95_seconds", "batch_sojourn_p50_seconds", "batch_sojourn_p95_seconds", "engine_queue_mean_seconds", "engine_prefill_interval_mean_seconds", "engine_generation_mean_seconds", "cached_fraction")


# Runs: each event is a trial of a method on a batch.
_RUNS = """SELECT CASE event_id % 2 WHEN 0 THEN 'original' ELSE 'greedy' END AS method, event_id // 2 AS batch_id, [8, 16, 32, 64][1 + (event_id // 2) % 4] AS batch_size, 0 AS batch_index, 0 AS repeat, value + 1 AS wall_seconds, 8 / (value + 1) AS rows_per_second, CASE WHEN event_id % 10 > 0 THEN user_id / 100 END AS cached_fraction, user_id + 1 AS prompt_tokens, user_id AS cached_tokens, (user_id % 10) / 10 AS accuracy, (user_id % 4) / 4 AS agreement_with_original, value / 4 AS batch_sojourn_p95_seconds, 8 AS rows, user_id % 9 AS correct, CASE WHEN user_id % 3 = 0 THEN 'disabled' ELSE 'enabled' END AS cache_mode FROM events"""


def runs(spark, sf_dir):
    v, e, u = F.col("value"), F.col("event_id"), F.col("user_id")
    half = F.floor(e / 2)
    size = F.element_at(F.array(*map(F.lit, (8, 16, 32, 64))), (half % 4 + 1).cast("int"))
    return read(spark, sf_dir, "events").select(F.when(e % 2 == 0, "original").otherwise("greedy").alias("method"), half.alias("batch_id"), size.alias("batch_size"), F.lit(0).alias("batch_index"), F.lit(0).alias("repeat"), (v + 1).alias("wall_seconds"), (F.lit(8) / (v + 1)).alias("rows_per_second"), F.when(e % 10 > 0, u / 100).alias("cached_fraction"), (u + 1).alias("prompt_tokens"), u.alias("cached_tokens"), (u % 10 / 10).alias("accuracy"), (u % 4 / 4).alias("agreement_with_original"), (v / 4).alias("batch_sojourn_p95_seconds"), F.lit(8).cast("long").alias("rows"), (u % 9).alias("correct"), F.when(u % 3 == 0, "disabled").otherwise("enabled").alias("cache_mode"))


@query(f"""WITH r AS ({_RUNS}) SELECT batch_size, method, count(*) AS runs, round(median(wall_seconds), 9) AS wall_seconds_median, round(median(rows_per_second), 9) AS rows_per_second_median, round(median(cached_fraction), 9) AS cached_fraction_median, median(CAST(prompt_tokens AS DOUBLE)) AS prompt_tokens_median, round(median(accuracy), 9) AS accuracy_median, round(median(agreement_with_original), 9) AS agreement_with_original_median FROM r GROUP BY batch_size, method""")
def batch_medians(spark, sf_dir):
    return rounded(reports.batch_medians(runs(spark, sf_dir)), "wall_seconds_median", "rows_per_second_median", "cached_fraction_median", "accuracy_median", "agreement_with_original_median")


@query(f"""WITH r AS ({_RUNS}), x AS (SELECT a.batch_size, a.wall_seconds / b.wall_seconds AS s FROM r a JOIN r b ON a.batch_id = b.batch_id AND a.method = 'original' AND b.method = 'greedy')
SELECT batch_size, 'original' AS baseline, 'greedy' AS candidate, count(*) AS pairs, round(median(s), 9) AS speedup_median, round(min(s), 9) AS speedup_min, round(max(s), 9) AS speedup_max FROM x GROUP BY batch_size""")
def paired_speedups(spark, sf_dir):
    return rounded(reports.paired_speedups(runs(spark, sf_dir)), "speedup_median", "speedup_min", "speedup_max")


@query(f"""WITH r AS ({_RUNS}) SELECT method, CAST(sum(rows) AS BIGINT) AS rows, round(sum(wall_seconds), 6) AS wall_seconds, round(sum(rows) / sum(wall_seconds), 9) AS rows_per_second, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens, round(sum(cached_tokens) / sum(prompt_tokens), 9) AS cached_fraction, round(sum(correct) / sum(rows), 9) AS accuracy FROM r GROUP BY method""")
def quality_roll_up(spark, sf_dir):
    return rounded(reports.roll_up(runs(spark, sf_dir)), "rows_per_second", "cached_fraction", "accuracy").withColumn("wall_seconds", F.round("wall_seconds", 6))


@query(f"""WITH r AS ({_RUNS}), m AS (SELECT * FROM r WHERE batch_size = 64)
SELECT batch_size, method, round(median(wall_seconds) FILTER (cache_mode = 'disabled'), 9) AS cache_off_wall_seconds, round(median(cached_fraction) FILTER (cache_mode = 'disabled'), 9) AS cache_off_cached_fraction, round(median(wall_seconds) FILTER (cache_mode = 'enabled'), 9) AS cache_on_wall_seconds, round(median(cached_fraction) FILTER (cache_mode = 'enabled'), 9) AS cache_on_cached_fraction FROM m GROUP BY batch_size, method""")
def cache_causality(spark, sf_dir):
    r = runs(spark, sf_dir)
    out = reports.cache_causality(r.where("cache_mode = 'enabled'"), r.where("cache_mode = 'disabled'"))
    return rounded(out, "cache_off_wall_seconds", "cache_off_cached_fraction", "cache_on_wall_seconds", "cache_on_cached_fraction")


@query(f"WITH r AS ({_RUNS}) SELECT method, batch_size, round(median(wall_seconds), 9) AS wall_seconds, round(median(batch_sojourn_p95_seconds), 9) AS batch_sojourn_p95_seconds, round(median(accuracy), 9) AS accuracy FROM r GROUP BY method, batch_size")
def microbatches(spark, sf_dir):
    return rounded(reports.microbatches(runs(spark, sf_dir)), "wall_seconds", "batch_sojourn_p95_seconds", "accuracy")


@query(f"""WITH r AS ({_RUNS}), b AS (SELECT method, CAST(8 AS BIGINT) AS rows, count(*) AS repeats, median(wall_seconds) AS wall_seconds, median(CAST(prompt_tokens AS DOUBLE)) AS prompt_tokens, median(cached_fraction) AS cached_fraction, median(accuracy) AS accuracy, avg(agreement_with_original) AS agreement_with_original FROM r GROUP BY method)
SELECT method, rows, repeats, round(wall_seconds, 9) AS wall_seconds, prompt_tokens, round(cached_fraction, 9) AS cached_fraction, round(accuracy, 9) AS accuracy, round(agreement_with_original, 9) AS agreement_with_original, round(rows / wall_seconds, 9) AS rows_per_second, round((SELECT wall_seconds FROM b WHERE method = 'original') / wall_seconds, 9) AS speedup_vs_original, round(wall_seconds / (SELECT wall_seconds FROM b WHERE method = 'greedy'), 9) AS greedy_speedup_vs_this_method FROM b""")
def compare_summary(spark, sf_dir):
    r = runs(spark, sf_dir).withColumnRenamed("agreement_with_original", "agreement").withColumn("planning_seconds", F.lit(0.0))
    out = compare.summarize_runs(r).drop("planning_seconds", "cached_tokens")
    return rounded(out, "wall_seconds", "cached_fraction", "accuracy", "agreement_with_original", "rows_per_second", "speedup_vs_original", "greedy_speedup_vs_this_method")


# Decisions of two layouts on labelled documents.
_PAIRED = """SELECT doc_id, quality = 1 AS gold, doc_id % 3 > 0 AS a, doc_id % 5 > 1 AS b FROM labels"""


def paired_requests(spark, sf_dir):
    d = F.col("doc_id")
    both = F.explode(F.array(F.struct(F.lit("original").alias("method"), (d % 3 > 0).alias("decision")), F.struct(F.lit("greedy").alias("method"), (d % 5 > 1).alias("decision"))))
    rows = read(spark, sf_dir, "labels").select(d.alias("row_id"), (F.col("quality") == 1).alias("gold"), both.alias("x")).select("row_id", "gold", "x.*")
    return rows.withColumn("correct", F.col("decision") == F.col("gold"))


@query(f"""WITH p AS (SELECT *, a = gold AS ac, b = gold AS bc FROM ({_PAIRED})) SELECT count(*) AS rows, round(count(*) FILTER (a = b) / count(*), 9) AS agreement, count(*) FILTER (a = b AND ac) AS same_correct, count(*) FILTER (a = b AND NOT ac) AS same_wrong, count(*) FILTER (a <> b AND bc AND NOT ac) AS fixes, count(*) FILTER (a <> b AND ac AND NOT bc) AS breaks, count(*) FILTER (a <> b AND ac = bc) AS both_wrong_different, round(count(*) FILTER (bc) / count(*) - count(*) FILTER (ac) / count(*), 9) AS accuracy_delta FROM p""")
def paired_outcomes(spark, sf_dir):
    return rounded(reports.paired_outcomes(paired_requests(spark, sf_dir)), "agreement", "accuracy_delta")


@query(f"""WITH p AS ({_PAIRED}), r AS (SELECT 'original' AS method, a = gold AS c FROM p UNION ALL SELECT 'greedy', b = gold FROM p) SELECT method, count(*) AS rows, count(*) FILTER (c) AS correct, round(count(*) FILTER (c) / count(*), 9) AS accuracy FROM r GROUP BY method""")
def quality_by_method(spark, sf_dir):
    return rounded(reports.quality_by_method(paired_requests(spark, sf_dir)), "accuracy")


@query(f"""WITH t AS ({_TRACES}), b AS (SELECT *, event_id % 12000 AS n FROM t) SELECT CASE WHEN n <= 512 THEN '≤512' WHEN n <= 2048 THEN '513–2K' WHEN n <= 4096 THEN '2–4K' WHEN n <= 8192 THEN '4–8K' ELSE '>8K' END AS label, median(CAST(n AS DOUBLE)) AS tokens, round(median(client_request_seconds), 9) AS client_seconds, round(median(engine_prefill_interval_ms / 1000), 9) AS prefill_seconds, round(median(queue_time_ms / 1000), 9) AS queue_seconds, count(*) AS samples FROM b WHERE n > 0 GROUP BY 1""")
def latency_bins(spark, sf_dir):
    rows = traces(spark, sf_dir).withColumn("local_prompt_tokens", F.col("event_id") % 12000)
    return rounded(reports.latency_bins(rows), "client_seconds", "prefill_seconds", "queue_seconds")


_PHASES = """SELECT CASE event_id % 2 WHEN 0 THEN 'original' ELSE 'greedy' END AS method, (value * 4 + 5) / 1000 AS client_request_seconds, value AS queue_time_ms, value * 2 AS engine_prefill_interval_ms, value / 2 AS generation_time_ms FROM events"""


def phase_requests(spark, sf_dir):
    v = F.col("value")
    return read(spark, sf_dir, "events").select(F.when(F.col("event_id") % 2 == 0, "original").otherwise("greedy").alias("method"), ((v * 4 + 5) / 1000).alias("client_request_seconds"), v.alias("queue_time_ms"), (v * 2).alias("engine_prefill_interval_ms"), (v / 2).alias("generation_time_ms"), F.lit(1).alias("completion_tokens"))


_PROFILE = f"""WITH p AS ({_PHASES}), x AS (SELECT method, unnest(['client', 'queue', 'prefill_and_first_token', 'decode_after_first_token', 'client_and_other']) AS phase, unnest([client_request_seconds * 1000, queue_time_ms, engine_prefill_interval_ms, generation_time_ms, greatest(client_request_seconds * 1000 - queue_time_ms - engine_prefill_interval_ms - generation_time_ms, 0)]) AS ms FROM p),
f AS (SELECT method, phase, count(*) AS requests, avg(ms) AS mean_ms, median(ms) AS median_ms, quantile_cont(ms, 0.95) AS p95_ms, min(ms) AS min_ms, max(ms) AS max_ms FROM x GROUP BY method, phase)"""


@query(f"{_PROFILE} SELECT method, phase, requests, round(mean_ms, 6) AS mean_ms, round(median_ms, 6) AS median_ms, round(p95_ms, 6) AS p95_ms, round(min_ms, 6) AS min_ms, round(max_ms, 6) AS max_ms FROM f")
def phase_profile(spark, sf_dir):
    out = reports.phase_profile(phase_requests(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_ms", "median_ms", "p95_ms", "min_ms", "max_ms")})


@query(f"""{_PROFILE}, w AS (SELECT * FROM f PIVOT (max(mean_ms) AS mean, max(median_ms) AS med, max(requests) AS n, max(max_ms) AS top FOR method IN ('original', 'greedy') GROUP BY phase))
SELECT max(original_n) AS requests, round(max(original_med / greedy_med) FILTER (phase = 'prefill_and_first_token'), 6) AS first_token_median_speedup, round(max(original_mean / greedy_mean) FILTER (phase = 'prefill_and_first_token'), 6) AS first_token_mean_speedup, round(max(original_mean / greedy_mean) FILTER (phase = 'client'), 6) AS client_mean_speedup, max(greatest(original_top, greedy_top)) FILTER (phase = 'decode_after_first_token') = 0 AS no_decode_time FROM w""")
def phase_comparison(spark, sf_dir):
    out = reports.phase_comparison(reports.phase_profile(phase_requests(spark, sf_dir)))
    return out.withColumns({c: F.round(c, 6) for c in ("first_token_median_speedup", "first_token_mean_speedup", "client_mean_speedup")})


@query("""WITH h AS (SELECT event_id, unnest([event_id % 3000, user_id * 7, event_id % 50]) AS k, unnest([0, 1, 2]) AS p FROM events),
l AS (SELECT * FROM h WHERE p >= 1) SELECT e.event_id, coalesce(array_to_string(list(part.p_name ORDER BY l.p) FILTER (part.p_name IS NOT NULL), '|'), '') AS history FROM events e LEFT JOIN l ON l.event_id = e.event_id LEFT JOIN part ON part.p_partkey = l.k GROUP BY e.event_id""")
def history_expand(spark, sf_dir):
    """The last two of three item numbers of each event as names of parts, unknown ones left out."""
    ids = F.concat_ws(" ", F.col("event_id") % 3000, F.col("user_id") * 7, F.col("event_id") % 50)
    seen = read(spark, sf_dir, "events").select("event_id", ids.alias("ids"))
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("item"), "p_name")
    return expand_history(seen, parts, ["event_id"], "ids", "item", 2).select("event_id", F.array_join(F.transform("history", lambda x: x["p_name"]), "|").alias("history"))


@query("SELECT d.doc_id, b.item_id, sha256(b.text) AS hypothesis, CASE WHEN b.item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS a FROM documents d JOIN benchmark b ON b.item_id IN (d.doc_id % 40, d.doc_id % 17 + 50)")
def label_cross(spark, sf_dir):
    """Documents with those of all labels that they have an annotation for; one of each document's two is no label at all times."""
    key = lambda k: F.struct(k.alias("key"), F.when(k % 2 == 0, "even").otherwise("odd").alias("value"))
    d = F.col("doc_id")
    docs = read(spark, sf_dir, "documents").select("doc_id", F.map_from_entries(F.array(key(d % 40), key(d % 17 + 50))).alias("notes"))
    labels = read(spark, sf_dir, "benchmark").select("item_id", F.sha2("text", 256).alias("hypothesis"))
    return annotated(docs, labels, F.col("notes"), "item_id").select("doc_id", "item_id", "hypothesis", "a")


def conversations(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("group_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("row_pos"))


_PACKS = """RECURSIVE g AS (SELECT conv_id, count(*) AS n, row_number() OVER (ORDER BY conv_id) AS i FROM conversations GROUP BY conv_id),
pk(i, pack, held) AS (SELECT i, 0, n FROM g WHERE i = 1 UNION ALL SELECT g.i, CASE WHEN held >= 16 THEN pack + 1 ELSE pack END, CASE WHEN held >= 16 THEN n ELSE held + n END FROM pk JOIN g ON g.i = pk.i + 1),
r AS (SELECT c.conv_id AS group_id, c.conv_id * 1000 + c.turn AS row_pos, pack, g.i, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) AS off FROM conversations c JOIN g USING (conv_id) JOIN pk ON pk.i = g.i),
a AS (SELECT *, row_number() OVER (PARTITION BY pack ORDER BY off, i) - 1 AS spot, row_number() OVER (ORDER BY pack, off, i) - 1 AS whole FROM r)"""


@query(f"WITH {_PACKS} SELECT group_id, row_pos, CAST(whole // 16 AS INTEGER) AS batch, CAST(whole % 16 AS INTEGER) AS place FROM a")
def coverage(spark, sf_dir):
    return coverage_batches(conversations(spark, sf_dir), 16, seed=None)


@query(f"WITH {_PACKS} SELECT group_id, row_pos, pack AS batch, CAST(spot AS INTEGER) AS place FROM a WHERE pack < 5 AND spot < 16")
def interleaved(spark, sf_dir):
    """Five ready batches of conversations."""
    return interleaved_batches(conversations(spark, sf_dir), 16, 5, seed=None)


@query("WITH l AS (SELECT conv_id % 100 AS group_id, length(text) AS n FROM conversations) SELECT group_id FROM l GROUP BY group_id HAVING max(n) <= 2000")
def prompts_that_fit(spark, sf_dir):
    lengths = read(spark, sf_dir, "conversations").select((F.col("conv_id") % 100).alias("group_id"), F.length("text").alias("length"))
    return prompt_filter(lengths, 2000)[0]


@query("WITH o AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS r, count(*) OVER () AS n FROM documents) SELECT doc_id, n_chars FROM o WHERE r IN (SELECT CAST(round_even(i * (n - 1) / 24.0, 0) AS BIGINT) FROM range(25) x(i))")
def quantile_selection(spark, sf_dir):
    """25 documents, evenly spaced by length."""
    return reports.select_quantiles(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), 25, "n_chars", "doc_id")


@query("WITH h AS (SELECT page_id, regexp_extract(url, '//([^/]+)', 1) AS host, row_number() OVER (ORDER BY page_id) AS p FROM pages), f AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY p) AS n FROM h) SELECT page_id, CASE WHEN n = 1 THEN host ELSE 'row-' || lpad(CAST(page_id + 1 AS VARCHAR), 9, '0') END AS name FROM f")
def unique_names(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "//([^/]+)", 1).alias("host"), (F.col("page_id") + 1).alias("p"))
    return unique_identifiers(pages, "host", "p", "name").select("page_id", "name")


_FIELDS = ("o_orderstatus", "o_orderpriority", "o_orderkey")


@query("WITH c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS v FROM orders" for c in _FIELDS) + "), f AS (SELECT field, count(DISTINCT v) AS ndv, min(length(v)) AS least, max(length(v)) AS most, sum(length(v)) AS tokens, count(*) AS rows FROM c GROUP BY field) SELECT field, ndv, CAST(least AS INTEGER) AS least, CAST(most AS INTEGER) AS most, CAST(tokens AS BIGINT) AS tokens, rows, ndv < rows AS reusable, round((SELECT sum(tokens) FROM f WHERE ndv < rows) / (SELECT sum(tokens) FROM f), 9) AS share FROM f")
def describe_fields(spark, sf_dir):
    out = reports.describe(read(spark, sf_dir, "orders"), list(_FIELDS), F.length)
    return rounded(out, "share").withColumn("tokens", F.col("tokens").cast("long")).withColumnRenamed("column", "field")


@query("SELECT sha256(sha256(string_agg(sha256(n_name), chr(10) ORDER BY n_nationkey))) AS sha256 FROM nation")
def table_digest(spark, sf_dir):
    return reports.tree_digest(read(spark, sf_dir, "nation"), "n_name", "n_nationkey")


@query("SELECT sha256('[' || string_agg('{\"n_name\":\"' || n_name || '\",\"n_regionkey\":\"' || n_regionkey || '\"}', ',' ORDER BY n_nationkey) || ']') AS sha256 FROM nation")
def dataset_digest(spark, sf_dir):
    """The digest that a table of texts is known by."""
    return reports.records_digest(read(spark, sf_dir, "nation").withColumn("n_regionkey", F.col("n_regionkey").cast("string")), ["n_name", "n_regionkey"], "n_nationkey")


@query(f"WITH {_PACKS}, x AS (SELECT CAST(whole // 16 AS INTEGER) AS batch, whole % 16 AS place, row_pos, group_id FROM a) SELECT batch, substr(sha256(string_agg('row-' || row_pos, chr(10) ORDER BY place)), 1, 16) AS batch_id, count(*) AS rows, count(DISTINCT group_id) AS group_count FROM x GROUP BY batch")
def batch_ids(spark, sf_dir):
    """Ready batches by the digest of their row ids, with their rows and groups."""
    rows = coverage_batches(conversations(spark, sf_dir), 16, seed=None).withColumn("row_id", F.concat(F.lit("row-"), F.col("row_pos").cast("string")))
    return reports.batch_table(rows)


@query("""SELECT 'single' AS phase, event_id, value, CAST(NULL AS BIGINT) AS batch_id FROM events WHERE event_id % 3 = 0 UNION ALL SELECT 'batch', event_id, value, user_id FROM events WHERE event_id % 3 = 1 UNION ALL SELECT 'quality', event_id, value, NULL FROM events WHERE event_id % 3 = 2""")
def request_union(spark, sf_dir):
    """Requests of three kinds of runs in one table."""
    e = read(spark, sf_dir, "events").select("event_id", "value", F.col("user_id").alias("batch_id"), (F.col("event_id") % 3).alias("k"))
    part = lambda k, *more: e.where(F.col("k") == k).select("event_id", "value", *more)
    return reports.request_rows(part(0), part(1, "batch_id"), part(2))


_REFUND = "Refund policy: approve only what is verified and has all the evidence it needs. Reject the rest. "


@query(f"""SELECT 'request-' || lpad(CAST(i AS VARCHAR), 4, '0') AS request_id, repeat('{_REFUND}', 2) AS policy, 'customer-segment-' || (i % 4) AS customer_context, 'purchase-' || lpad(CAST(i AS VARCHAR), 4, '0') AS purchase, CASE WHEN i % 2 = 0 THEN 'purchase verified; all evidence is there' ELSE 'purchase verified; the receipt is missing' END AS evidence, i % 2 = 0 AS approve FROM range(1000) t(i)""")
def refund_workload(spark, sf_dir):
    return refunds(spark, 1000, 2).withColumnRenamed("_truth", "approve")


def _words(text: str) -> int:
    return len(text.split())


@query("SELECT unnest(['a_00', 'customer_request', 'b_00', 'a_01']) AS field, CAST(64 AS BIGINT) AS ndv, 40 AS least, 40 AS most, CAST(4096 * 40 AS BIGINT) AS tokens, CAST(4096 AS BIGINT) AS rows, true AS reusable, 1.0 AS share")
def correlated_fields(spark, sf_dir):
    """A synthetic table of 4,096 rows: all fields have equally many values of equal length."""
    df = correlated(spark, 4096, 64, 2, 40, 7, _words)
    return reports.describe(df.drop("_truth"), [c for c in df.columns if c != "_truth"], lambda c: F.size(F.split(c, r"\s+"))).withColumnRenamed("column", "field").withColumn("share", F.col("share").cast("decimal(2,1)")).withColumn("tokens", F.col("tokens").cast("long"))


@query("SELECT unnest(['record_id', 'customer_request', 'company_policy', 'service_context', 'profile_0', 'profile_1', 'profile_2', 'profile_3', 'profile_4', 'profile_5']) AS field, CAST(unnest([512, 512, 1, 1, 4, 8, 16, 32, 64, 64]) AS BIGINT) AS ndv, unnest([1, 263, 132, 132, 132, 132, 132, 132, 132, 132]) AS most")
def shared_fields(spark, sf_dir):
    """A synthetic table of 512 rows, eighty percent of whose tokens can be reused."""
    df = shared(spark, 512, 0.8, 7, _words)
    out = reports.describe(df.drop("_truth"), [c for c in df.columns if c != "_truth"], lambda c: F.size(F.split(c, r"\s+")))
    return out.where("least = most").select(F.col("column").alias("field"), "ndv", "most")


def _file(spark: SparkSession, rows: DataFrame, name: str) -> str:
    """One text file of ``rows`` (at, value) in order; its folder's path."""
    path = f"{shared_folder(spark)}/rowloom-{uuid.uuid4().hex}{name}"
    rows.coalesce(1).sortWithinPartitions("at").select("value").write.text(path)
    return path


@query("""SELECT event_id AS _pos, '{"k":' || (props->>'$.k') || ',"z":[null,"' || event_type || '"]}' AS props, CAST(user_id AS VARCHAR) AS "user", 'true' AS ok, to_json(event_type || chr(10) || 'é"') AS note FROM events""")
def json_lines_cells(spark, sf_dir):
    """A file of JSON Lines, with a blank line after each, as cells that keep their types."""
    v = F.concat(F.lit('{"user": '), F.col("user_id").cast("string"), F.lit(', "ok":true,"props":{"z":[null , "'), F.col("event_type"), F.lit('"], "k":'), F.get_json_object("props", "$.k"), F.lit('},"note": "'), F.col("event_type"), F.lit('\\n\\u00e9\\""}\n'))
    path = _file(spark, read(spark, sf_dir, "events").select(F.col("event_id").alias("at"), v.alias("value")), ".jsonl")
    table = read_json_file(spark, path, lines=True)
    return table.cells().toDF("_pos", *table.fields)


_FAULTS = ("{}", '{"a":1,"a":2}', '{"x":{"b":1,"b":1}}', '{"a":NaN}', '{"a":1e999}', "[1]", '"text"', '{"a":', '{"a":-Infinity}', '{"a":1.5}')


@query("SELECT event_id, event_id % 10 IN (0, 9) AS accepted FROM events")
def json_rejects(spark, sf_dir):
    """Lines of JSON that are records, and lines that are refused."""
    lines = read(spark, sf_dir, "events").select(F.col("event_id").alias("at"), F.element_at(F.array(*map(F.lit, _FAULTS)), (F.col("event_id") % 10 + 1).cast("int")).alias("text"))
    return parse_texts(lines, True).select(F.col("at").alias("event_id"), F.col("fault").isNull().alias("accepted"))


@query("""WITH s AS (SELECT event_id, user_id, unnest([event_id % 2500, user_id * 7]) AS item, unnest([1, 2]) AS p FROM events),
k AS (SELECT s.*, part.p_name, part.p_type, row_number() OVER (ORDER BY event_id, p) AS row_pos FROM s JOIN part ON p_partkey = item),
n AS (SELECT *, row_number() OVER (PARTITION BY event_id, item ORDER BY p) AS nth FROM k),
h AS (SELECT e.event_id, coalesce(string_agg(part.p_name, '|' ORDER BY x.p), '') AS history FROM events e CROSS JOIN (SELECT unnest([1, 2]) AS p) x LEFT JOIN part ON p_partkey = CASE x.p WHEN 1 THEN (e.event_id + 5) % 3000 ELSE e.user_id END GROUP BY e.event_id)
SELECT CASE nth WHEN 1 THEN 'impression-' || event_id || ':' || item ELSE 'row-' || lpad(CAST(row_pos AS VARCHAR), 9, '0') END AS row_id, 'impression-' || event_id AS group_id, p_name AS candidate, p_type AS category, 'u' || user_id AS user_id, history, p = 1 AS gold FROM n JOIN h USING (event_id)""")
def mind_rows(spark, sf_dir):
    """A whole news workload, loaded from files: candidates of impressions with the last two items of their readers' histories."""
    tab = lambda *cs: F.concat_ws("\t", *cs)
    parts = read(spark, sf_dir, "part")
    news = parts.select(F.col("p_partkey").alias("at"), tab(F.col("p_partkey").cast("string"), "p_type", "p_brand", "p_name", F.lit("abstract"), F.lit("u"), F.lit("[]"), F.lit("[]")).alias("value"))
    e, u = F.col("event_id"), F.col("user_id")
    shown = F.concat_ws(" ", F.concat((e % 2500).cast("string"), F.lit("-1")), F.concat((u * 7).cast("string"), F.lit("-0")))
    seen = read(spark, sf_dir, "events").select(e.alias("at"), tab(e.cast("string"), F.concat(F.lit("u"), u.cast("string")), F.lit("t"), F.concat_ws(" ", F.lit("0"), (e + 5) % 3000, u), shown).alias("value"))
    found = load_mind(spark, _file(spark, news, ".tsv"), _file(spark, seen, ".tsv"), history_items=2).rows
    history = F.array_join(F.transform("state.history", lambda x: x["title"]), "|")
    return found.select("row_id", "group_id", F.col("state.candidate.title").alias("candidate"), F.col("state.candidate.category").alias("category"), "state.user_id", history.alias("history"), "gold")


@query("""WITH d AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS p FROM documents WHERE length(trim(text)) > 0),
x AS (SELECT d.*, b.item_id, b.text AS hypothesis FROM d JOIN benchmark b ON b.item_id = doc_id % 40 OR (b.item_id = doc_id % 7 AND b.item_id <> doc_id % 40))
SELECT 'contract-' || doc_id || ':h' || item_id AS row_id, 'contract-' || doc_id AS group_id, 'h' || item_id AS hypothesis_id, sha256(hypothesis) AS hypothesis, CAST(doc_id AS VARCHAR) AS document_id, sha256(text) AS contract_text, row_number() OVER (ORDER BY p, item_id) AS row_pos, ['Entailment', 'Contradiction', 'NotMentioned'][1 + item_id % 3] AS gold FROM x""")
def contract_rows(spark, sf_dir):
    """A whole contract workload, loaded from a file: documents with those hypotheses that annotate them."""
    d = F.col("doc_id")
    choice = lambda k: F.struct(F.element_at(F.array(*map(F.lit, CONTRACT_CHOICES)), (k % 3 + 1).cast("int")).alias("choice"), F.array().cast("array<int>").alias("spans"))
    notes = F.map_from_entries(F.array_distinct(F.array(*(F.struct(F.concat(F.lit("h"), k.cast("string")).alias("key"), choice(k).alias("value")) for k in (d % 40, d % 7)))))
    docs = read(spark, sf_dir, "documents").where(F.length(F.trim("text")) > 0).select(d.alias("at"), F.to_json(F.struct(d.cast("string").alias("id"), "text", F.lit("t").alias("document_type"), F.array(F.struct(notes.alias("annotations"))).alias("annotation_sets"))).alias("value"))
    first, last = docs.agg(F.min("at"), F.max("at")).first()
    comma = lambda at, value: F.when(F.col("at") == at, value).otherwise(F.concat(F.lit(","), value))
    labels = read(spark, sf_dir, "benchmark").select((F.col("item_id") - (1 << 40)).alias("at"), F.concat(F.lit('"h'), F.col("item_id").cast("string"), F.lit('":'), F.to_json(F.struct(F.col("text").alias("hypothesis")))).alias("value"))
    least = labels.agg(F.min("at")).first()[0]
    frame = spark.createDataFrame([(-(1 << 41), '{"labels":{'), (-1, '},"documents":['), (last + 1, "]}")], "at long, value string")
    whole = frame.unionByName(labels.select("at", comma(least, F.col("value")).alias("value"))).unionByName(docs.select("at", comma(first, F.col("value")).alias("value")))
    path = _file(spark, whole, ".json")
    found = load_contract_nli(spark, path).rows
    discard(spark.read.text(path))  # the rows come from tables that were made of it
    return found.select("row_id", "group_id", "state.hypothesis_id", F.sha2("state.hypothesis", 256).alias("hypothesis"), "state.document_id", F.sha2("state.contract_text", 256).alias("contract_text"), "row_pos", "gold")


_BATCHED = greedy_sql("SELECT o_custkey // 500 AS batch, o_orderkey, CAST(o_custkey AS VARCHAR) AS a, o_orderstatus AS b, o_orderpriority AS c FROM orders", ["a", "b", "c"], "batch")


@query(f"""WITH {_BATCHED} SELECT batch, o_orderkey, row_number() OVER (PARTITION BY batch ORDER BY list_transform(ord, lambda i: [a, b, c][i + 1]), o_orderkey) - 1 AS _exec_pos,
CAST(strlen('{{"' || '{'":"","'.join(ORDERS)}' || '":""}}') + strlen(a) + strlen(b) + strlen(c) AS INTEGER) AS bytes FROM t JOIN g ON batch = grp""")
def plan_by_batch(spark, sf_dir):
    """Each order placed by the plan of its customer's batch of 500 alone."""
    df = read(spark, sf_dir, "orders").withColumn("batch", F.floor(F.col("o_custkey") / 500)).select("batch", "o_orderkey", *ORDERS)
    return plan_by_group(spark, df, "batch", ["o_orderkey"], ORDERS).select("batch", "o_orderkey", "_exec_pos", F.octet_length("state").alias("bytes"))


_CELLS = ["c_mktsegment", "CAST(c_nationkey AS VARCHAR)", "CAST(c_acctbal AS VARCHAR)", "c_name", "CAST(c_custkey AS VARCHAR)"]
_EXPLAINED = greedy_sql("SELECT c_custkey AS pos, " + ", ".join(f"{c} AS v{i}" for i, c in enumerate(_CELLS)) + " FROM customer", [f"v{i}" for i in range(5)])


@query(f"""WITH {_EXPLAINED},
m AS (SELECT 'original' AS method, [0, 1, 2, 3, 4] AS ord, false AS sorted UNION ALL SELECT 'lexicographic', [0, 1, 2, 3, 4], true UNION ALL SELECT 'greedy', ord, true FROM g),
s AS (SELECT method, pos, sorted, list_transform(ord, lambda i: [v0, v1, v2, v3, v4][i + 1]) AS vals, '{{' || array_to_string(list_transform(ord, lambda i: ['{"', '".join(f'"{c}":"' for c in CUSTOMER)}'][i + 1] || [v0, v1, v2, v3, v4][i + 1] || '"'), ',') || '}}' AS state FROM m, t),
p AS (SELECT method, state, lag(state) OVER (PARTITION BY method ORDER BY CASE WHEN sorted THEN vals ELSE [] END, pos) AS before FROM s),
b AS (SELECT method, CAST(sum(strlen(state)) AS BIGINT) AS serialized_bytes, CAST(sum(coalesce(len(list_filter(range(1, length(state) + 1), lambda i: state[1:i] = before[1:i])), 0)) AS BIGINT) AS adjacent_prefix_bytes FROM p GROUP BY method),
c AS (SELECT method, list(n ORDER BY k) AS prefix_group_counts FROM (SELECT method, k, CAST(list_reduce(list_transform(ord[1:k], lambda i: 1 << i), lambda x, y: x | y) AS INTEGER) AS mask FROM m, range(1, 6) r(k)) JOIN cnt USING (mask) GROUP BY method)
SELECT method, serialized_bytes, adjacent_prefix_bytes, prefix_group_counts FROM b JOIN c USING (method)""")
def explain_layouts(spark, sf_dir):
    """Shared bytes of the customers' rows under three layouts."""
    df = read(spark, sf_dir, "customer").select(*CUSTOMER)
    found = LayoutOptimizer(spark).explain(df, methods=("original", "lexicographic", "greedy"), order_by=["c_custkey"])
    return spark.createDataFrame([(r["method"], r["serialized_bytes"], r["adjacent_prefix_bytes"], r["prefix_group_counts"]) for r in found.layouts], "method string, serialized_bytes long, adjacent_prefix_bytes long, prefix_group_counts array<long>")


@query("SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS VARCHAR) AS price, CAST(l_tax AS VARCHAR) AS tax FROM lineitem")
def float_texts(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", float_text(F.col("l_extendedprice")).alias("price"), float_text(F.col("l_tax")).alias("tax"))
