import json
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rowloom.operators.backends import ChoiceBackend, CompletionBackend, KeywordBackend
from rowloom.operators.decisions import DecisionResponse, DecisionSpec, decided, softmax, valid
from rowloom.operators.layout import LAYOUTS
from rowloom.operators.scan import DecisionEngine, in_turn


class AmountBackend:
    """Says yes to amounts above 2; counts tokens if asked to; fails on ERROR."""

    supports_cache_salt = True

    def __init__(self, counts=True):
        self.counts = counts

    def decide(self, state, spec, *, cache_salt=None):
        amount = json.loads(state)["amount"]
        if amount == "ERROR":
            raise ValueError("bad amount")
        yes = float(amount) > 2
        p = (0.1, 0.9) if yes else (0.9, 0.1)
        return DecisionResponse(p, *((100, 50, 1, 25) if self.counts else ()))


TICKETS = pd.DataFrame({"amount": [5, 1, 4, 2, 0], "notes": ["a", "b", "a", "b", "a"]}, index=list("zzabb"))


@pytest.mark.parametrize("method", LAYOUTS)
def test_five_tickets(spark, method):
    result = DecisionEngine(spark, AmountBackend(), concurrency=2).scan(TICKETS, "large?", method=method)
    out = result.to_pandas()
    assert out["decision"].tolist() == [True, False, True, False, False] and list(out.index) == list("zzabb") and list(out.columns) == ["decision", "p_false", "p_true"]
    m = result.metrics()
    assert [m[k] for k in ("prompt_tokens", "cached_tokens", "completion_tokens", "created_cache_tokens", "cached_fraction")] == [500, 250, 5, 125, 0.5]
    traces = result.traces().orderBy("row_position").collect()
    assert sorted(t["execution_position"] for t in traces) == list(range(5)) and all(t["complete_offset_seconds"] >= t["request_start_offset_seconds"] for t in traces)


def test_json_keeps_types(spark):
    records = [{"amount": 3, "meta": {"kind": "x"}}, {"amount": 1, "meta": {"kind": "y"}}, {"amount": 9, "meta": {"kind": "x"}}]
    assert DecisionEngine(spark, AmountBackend()).scan(json.dumps(records), "large?").to_pandas()["decision"].tolist() == [True, False, True]


def test_missing_counts_stay_unknown(spark):
    m = DecisionEngine(spark, AmountBackend(counts=False)).scan([{"amount": 1}], "?").metrics()
    assert m["prompt_tokens"] is None and m["cached_fraction"] is None and m["engine_queue_mean_seconds"] is None


def test_empty(spark):
    result = DecisionEngine(spark, AmountBackend()).scan([], "?", columns=["amount", "notes"])
    assert result.to_pandas().shape == (0, 3) and result.metrics()["prompt_tokens"] == 0


def test_failure_names_the_row(spark):
    with pytest.raises(Exception, match="input row position 1"):
        DecisionEngine(spark, AmountBackend()).scan([{"amount": "1"}, {"amount": "ERROR"}, {"amount": "3"}], "?")


def test_requests_in_flight():
    """Never more than the width, refilled in order; an error lets what is under way end and begins nothing more."""
    lock, now, most, begun = threading.Lock(), [0], [0], []

    def do(x):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
            begun.append(x)
        time.sleep(0.01 if x % 3 else 0.03)
        with lock:
            now[0] -= 1
        if x == 20:
            raise ValueError("twenty")
        return x * x

    found = list(in_turn(range(1000), do, 4))
    assert most[0] == 4 and now[0] == 0 and sorted(begun) == list(range(len(begun))) and 21 <= len(begun) <= 24
    assert sorted(x for x, _ in found) == list(range(len(begun))) and all(isinstance(r, ValueError) if x == 20 else r == x * x for x, r in found)
    assert list(in_turn([], do, 2)) == [] and list(in_turn([1], do, 2)) == [(1, 1)]


def test_a_failing_row_is_asked_once(spark, tmp_path):
    class Counting(AmountBackend):
        def decide(self, state, spec, *, cache_salt=None):
            with open(tmp_path / "asked", "a") as f:
                f.write(state + "\n")
            return super().decide(state, spec, cache_salt=cache_salt)

    with pytest.raises(RuntimeError, match="input row position 2: bad amount"):
        DecisionEngine(spark, Counting(), concurrency=1).scan([{"amount": "1"}, {"amount": "2"}, {"amount": "ERROR"}, {"amount": "3"}], "?", method="original")
    assert len((tmp_path / "asked").read_text().splitlines()) == 3


def test_compare(spark):
    engine = DecisionEngine(spark, AmountBackend())
    found = engine.compare([{"amount": 1}, {"amount": 3}, {"amount": 5}], "?", methods=("original", "greedy"), truth=[False, True, True])
    runs = found.runs.collect()
    assert [r["method"] for r in runs] == ["original", "greedy", "greedy", "original"] and len({r["cache_salt"] for r in runs}) == 4
    table = found.to_pandas()
    assert table["accuracy"].tolist() == [1, 1] and table["agreement_with_original"].tolist() == [1, 1] and table.loc["original", "speedup_vs_original"] == 1
    for bad in ({"repeats": 0}, {"repeats": True}, {"methods": ()}, {"methods": ("original", "original")}, {"methods": ("best",)}, {"truth": [True]}):
        with pytest.raises(ValueError):
            engine.compare([{"amount": 1}, {"amount": 2}], "?", **bad)


def test_engine_lifecycle(spark):
    for bad in (0, True, 1.5):
        with pytest.raises(ValueError):
            DecisionEngine(spark, AmountBackend(), concurrency=bad)
    with DecisionEngine(spark, AmountBackend()) as engine:
        pass
    with pytest.raises(RuntimeError):
        engine.scan([{"amount": 1}], "?")


def test_keyword_backend_is_the_same_in_spark_and_python(spark):
    backend = KeywordBackend([["no", "not"], ["yes"], ["maybe"]])
    spec = DecisionSpec.create("?", "choice", ["n", "y", "m"])
    states = ["no yes", "yes yes", "", "maybe not", "nono"]
    out = spark.createDataFrame([(s,) for s in states], "state string").select("state", backend.column(F.col("state")).alias("p")).collect()
    for r in out:
        assert r["p"] == pytest.approx(backend.decide(r["state"], spec).probabilities)


def test_specs():
    assert DecisionSpec.create("Q?", "choice", ["a", "b"]).prompt("S") == "[kind] choice\n[state] S\n[question] Q?\n[options]\nA) a\nB) b\n[decision]:"
    assert DecisionSpec.create("Q?").prompt("S").endswith("[options]\nfalse\ntrue\n[decision]:") and DecisionSpec.create("Q?", "score").options == tuple(range(6))
    assert DecisionSpec.create("Q?", "choice", ["A", "a"]).option_columns() == ["p_a", "p_a_2"]
    for bad in (("",), (" ",), ("q", "noul", [1]), ("q", "score", ["a", "b"]), ("q", "choice"), ("q", "choice", "ab"), ("q", "choice", ["a"]), ("q", "choice", ["a", "a"]), ("q", "choice", ["a", ""]), ("q", "choice", ["a", "b\nc"]), ("q", "choice", list(map(str, range(17)))), ("q", "other"), (3,)):
        with pytest.raises(ValueError):
            DecisionSpec.create(*bad)


def test_probabilities(spark):
    rows = [([0.0, 1.0, 1.0],), ([-1000.0, 0.0, -5.0],)]
    out = spark.createDataFrame(rows, "x array<double>").select(softmax(F.col("x"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.5)), 2.0).alias("p")).withColumn("v", valid(F.col("p"), 3)).withColumn("d", decided(F.col("p"), ["a", "b", "c"])).collect()
    for (x,), r in zip(rows, out, strict=True):
        e = np.exp((np.array(x) + [1, 0, 0.5]) / 2 - max((np.array(x) + [1, 0, 0.5]) / 2))
        assert r["p"] == pytest.approx(e / e.sum()) and r["v"] and r["d"] == "abc"[int(np.argmax(e))]
    bad = [([0.5, 0.6],), ([float("nan"), 1.0],), ([-0.1, 1.1],), ([1.0],), (None,), ([None, 1.0],)]
    assert not any(r[0] for r in spark.createDataFrame(bad, "p array<double>").select(valid(F.col("p"), 2)).collect())
    assert spark.createDataFrame([([0.5, 0.5],)], "p array<double>").select(decided(F.col("p"), [False, True])).first()[0] == "False"


@pytest.fixture
def server():
    """Answers as told; keeps what it was asked."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            http.asked.append((self.path, body, self.headers.get("Authorization")))
            data = json.dumps(http.answer).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.send_header("x-request-id", "r1")
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    http.asked, http.answer = [], {}
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield http
    http.shutdown()


def head(tmp_path, **slots):
    ranges = {"noul": [0, 2], "score": [2, 8], "choice": [8, 24]} | slots
    (tmp_path / "decision_head.json").write_text(json.dumps({"bias": [0.0, 0.5, *[0.0] * 22], "verbalizer_ids": list(range(100, 124)), "slots": {"template_version": "bare-v1", "ranges": ranges}}))
    (tmp_path / "calibration.json").write_text(json.dumps({"per_kind": {"noul": 2.0, "score": 1.0, "choice": 1.0}}))
    return tmp_path


def test_completion_backend(server, tmp_path):
    server.answer = {"id": "x", "choices": [{"logprobs": {"top_logprobs": [{"token_id:100": -1.0, "token_id:101": -0.5}]}}], "usage": {"prompt_tokens": 9, "completion_tokens": 1, "prompt_tokens_details": {"cached_tokens": 4}}, "metrics": {"queue_time_ms": 1, "time_to_first_token_ms": 2.5, "generation_time_ms": 0}}
    backend = CompletionBackend(f"http://127.0.0.1:{server.server_port}/v1", model="m", model_dir=head(tmp_path), api_key="k")
    spec = DecisionSpec.create("Q?")
    r = backend.decide("S", spec, cache_salt="salt")
    e = np.exp([-0.5, 0.0])
    assert r.probabilities == pytest.approx(tuple(e / e.sum())) and (r.prompt_tokens, r.cached_tokens, r.completion_tokens, r.created_cache_tokens, r.queue_time_ms, r.time_to_first_token_ms, r.request_id) == (9, 4, 1, None, 1.0, 2.5, "x")
    path, body, key = server.asked[0]
    assert path == "/v1/completions" and key == "Bearer k" and body["prompt"] == spec.prompt("S") and body["allowed_token_ids"] == [100, 101] and body["cache_salt"] == "salt" and body["max_tokens"] == 1
    for broken in ({"usage": {"prompt_tokens": -1}}, {"usage": {"prompt_tokens": True}}, {"metrics": {"queue_time_ms": -1}}, {"id": 3}, {"choices": [{"logprobs": {"top_logprobs": [{"token_id:100": -1.0}]}}]}, {"choices": [{"logprobs": {"top_logprobs": [{"token_id:100": -1.0, "token_id:101": None}]}}]}):
        good, server.answer = server.answer, server.answer | broken
        with pytest.raises(RuntimeError):
            backend.decide("S", spec)
        server.answer = good
    with pytest.raises(ValueError):
        CompletionBackend(model="m", model_dir=head(tmp_path, score=[2, 7])).prepare(spec)


def test_choice_backend(server):
    server.answer = {"probabilities": {"no": 1, "yes": 3}, "prompt_tokens": [5, 6], "cached_tokens": [1, 0]}
    backend = ChoiceBackend(f"http://127.0.0.1:{server.server_port}/v1", path="/choice", temperature=0.5)
    r = backend.decide('{"b":1,"a":2}', DecisionSpec.create("Q?"), cache_salt="s")
    assert r.probabilities == (0.25, 0.75) and (r.prompt_tokens, r.cached_tokens, r.completion_tokens, r.request_id) == (11, 1, 0, "r1")
    assert server.asked[0][:2] == ("/choice", {"state": '{"b":1,"a":2}', "question": "Q?", "options": ["no", "yes"], "use_prefix_cache": True, "cache_salt": "s", "temperature": 0.5})
    for bad in ({}, {"probabilities": []}, {"probabilities": {"no": 1}}, {"probabilities": {"no": -1, "yes": 2}}, {"probabilities": {"no": 0, "yes": 0}}, {"probabilities": {"no": True, "yes": 1}}, {"probabilities": {"no": 1, "yes": 1}, "prompt_tokens": [-1]}, {"probabilities": {"no": 1, "yes": 1}, "prompt_tokens": 3}):
        server.answer = bad
        with pytest.raises(RuntimeError):
            backend.decide("S", DecisionSpec.create("Q?"))
    for bad in ({"timeout": 0}, {"timeout": True}, {"temperature": -1}, {"use_prefix_cache": 1}):
        with pytest.raises(ValueError):
            ChoiceBackend(path="/x", **bad)


def test_scan_over_http(spark, server):
    server.answer = {"probabilities": {"no": 1, "yes": 3}}
    backend = ChoiceBackend(f"http://127.0.0.1:{server.server_port}", path="/choice")
    out = DecisionEngine(spark, backend, concurrency=2).scan([{"a": "x"}, {"a": "y"}, {"a": "x"}], "?").to_pandas()
    assert out["decision"].tolist() == [True] * 3 and sorted(b["state"] for _, b, _ in server.asked) == ['{"a":"x"}', '{"a":"x"}', '{"a":"y"}']


def test_stream(spark, tmp_path):
    from rowloom.streaming.scans import scan_stream

    spark.createDataFrame([(i, i % 5) for i in range(20)], "id long, amount long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, amount long").parquet(str(tmp_path / "in"))
    query = scan_stream(stream, DecisionEngine(spark, AmountBackend()), "large?", str(tmp_path / "out"), "id").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r["id"]: r["decision"] for r in out} == {str(i): str(i % 5 > 2) for i in range(20)}


def test_percentiles_by_sorting(spark, monkeypatch):
    from rowloom.operators import scan
    from rowloom.plans import materialize

    rng = np.random.default_rng(5)
    xs = rng.random(300).round(2)
    df = spark.createDataFrame([(float(x),) for x in xs] + [(None,)], "x double")
    for limit in (10, 10_000):
        monkeypatch.setattr(materialize, "ONE_SORT", limit)
        found = scan.percentiles(df, [], "x", {"a": 0.0, "b": 0.5, "c": 0.95, "d": 1.0}).collect()
        assert [tuple(r) for r in found] == [(300, *map(pytest.approx, np.percentile(xs, [0, 50, 95, 100])))]
        by = {r["k"]: r for r in scan.percentiles(df.withColumn("k", F.when(F.col("x") < 0.3, "low")), ["k"], "x", {"m": 0.5, "p": 0.95}).collect()}
        for k, part in (("low", xs[xs < 0.3]), (None, xs[xs >= 0.3])):
            assert (by[k]["rows"], by[k]["m"], by[k]["p"]) == (len(part), pytest.approx(np.median(part)), pytest.approx(np.percentile(part, 95)))
    assert scan.percentiles(df.where("x > 5"), [], "x", {"m": 0.5}).count() == 0
