import hashlib

import pandas as pd
import pytest

from rowloom.operators import reports
from rowloom.operators.compare import summarize_runs


def test_requests_of_three_kinds(spark, tmp_path):
    single = spark.createDataFrame([("w", 9)], "workload string, local_prompt_tokens int")
    batch = spark.createDataFrame([("w", "b1", "r1"), ("w", "b1", "r2")], "workload string, batch_id string, row_id string")
    quality = spark.createDataFrame([("w", "r3")], "workload string, row_id string")
    rows = reports.request_rows(single, batch, quality)
    assert sorted(r["phase"] for r in rows.collect()) == ["batch", "batch", "quality", "single"]
    reports.write_requests(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 4


def paired(spark, rows):
    return spark.createDataFrame(rows, "method string, row_id string, decision string, correct boolean")


def test_paired_outcomes(spark):
    rows = [("original", "a", "x", True), ("original", "b", "x", False), ("greedy", "a", "x", True), ("greedy", "b", "y", True)]
    r = reports.paired_outcomes(paired(spark, rows)).first()
    assert (r["rows"], r["fixes"], r["breaks"], r["same_correct"], r["same_wrong"], r["both_wrong_different"], r["agreement"], r["accuracy_delta"]) == (2, 1, 0, 1, 0, 0, 0.5, 0.5)
    assert {q["method"]: q["accuracy"] for q in reports.quality_by_method(paired(spark, rows)).collect()} == {"original": 0.5, "greedy": 1.0}
    with pytest.raises(Exception, match="different rows"):
        reports.paired_outcomes(paired(spark, rows[:3])).collect()


def test_latency_bins(spark):
    rows = [(500, 0.2, 150.0, 2.0), (512, 0.4, None, None), (513, 1.0, 10.0, 1.0), (9000, 3.0, None, 1.0), (0, 9.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "local_prompt_tokens int, client_request_seconds double, engine_prefill_interval_ms double, queue_time_ms double")
    out = {r["label"]: r for r in reports.latency_bins(df).collect()}
    assert set(out) == {"≤512", "513–2K", ">8K"} and out["≤512"]["samples"] == 2 and out["≤512"]["prefill_seconds"] == 0.15 and out[">8K"]["prefill_seconds"] is None


RUNS = "batch_id string, batch_size int, batch_index int, repeat int, method string, wall_seconds double, rows_per_second double, cached_fraction double, prompt_tokens long, accuracy double, agreement_with_original double, batch_sojourn_p95_seconds double"


def runs(spark):
    rows = [("a", 8, 0, 0, "original", 10.0, 1.0, 0.5, 10, 0.5, None, 9.0), ("a", 8, 0, 0, "greedy", 2.0, 4.0, 0.75, 10, 0.75, 0.75, 2.0), ("b", 8, 1, 0, "original", 2.0, 4.0, None, 20, 1.0, None, 1.0), ("b", 8, 1, 0, "greedy", 1.0, 2.0, 0.5, 20, 0.75, 1.0, 1.0), ("c", 16, 0, 0, "original", 5.0, 3.0, 0.1, 5, 1.0, None, 4.0)]
    return spark.createDataFrame(rows, RUNS)


def test_batches(spark):
    out = {(r["batch_size"], r["method"]): r for r in reports.batch_medians(runs(spark)).collect()}
    assert out[8, "original"]["wall_seconds_median"] == 6 and out[8, "greedy"]["cached_fraction_median"] == 0.625 and out[8, "greedy"]["agreement_with_original_median"] == 0.875 and out[8, "original"]["agreement_with_original_median"] is None
    pairs = reports.paired_speedups(runs(spark)).collect()
    assert [(r["batch_size"], r["pairs"], r["speedup_median"], r["speedup_min"], r["speedup_max"]) for r in pairs] == [(8, 2, 3.5, 2, 5)]
    both = {r["method"]: r for r in reports.cache_causality(runs(spark), runs(spark).where("batch_size = 8")).collect()}
    assert set(both) == {"original", "greedy"} and both["original"]["cache_on_wall_seconds"] == 6 and both["greedy"]["batch_size"] == 8
    assert reports.microbatches(runs(spark)).count() == 3
    assert reports.same_batches(runs(spark), runs(spark).where("method = 'original'")) and not reports.same_batches(runs(spark), runs(spark).where("batch_size = 8"))


def test_roll_up(spark):
    df = spark.createDataFrame([("m", 2, 1.0, 10, 5, 1), ("m", 6, 3.0, 30, 5, 6)], "method string, rows int, wall_seconds double, prompt_tokens long, cached_tokens long, correct int")
    r = reports.roll_up(df).first()
    assert (r["rows"], r["rows_per_second"], r["cached_fraction"], r["accuracy"]) == (8, 2.0, 0.25, 7 / 8)


PHASES = "method string, client_request_seconds double, queue_time_ms double, engine_prefill_interval_ms double, generation_time_ms double, completion_tokens int"


def test_phases(spark):
    rows = [("original", 0.1, 5.0, 40.0, 0.0, 1), ("original", 0.1, 5.0, 60.0, 0.0, 1), ("greedy", 0.05, 5.0, 25.0, 0.0, 1), ("greedy", 0.05, 5.0, 25.0, 0.0, 1)]
    profile = reports.phase_profile(spark.createDataFrame(rows, PHASES))
    out = {(r["method"], r["phase"]): r for r in profile.collect()}
    assert out["original", "client_and_other"]["mean_ms"] == pytest.approx(45) and out["original", "prefill_and_first_token"]["p95_ms"] == pytest.approx(59) and out["greedy", "queue"]["requests"] == 2
    r = reports.phase_comparison(profile).first()
    assert (r["requests"], r["first_token_median_speedup"], r["client_mean_speedup"], r["no_decode_time"]) == (2, 2.0, 2.0, True)
    for bad, text in (([("original", 0.01, 5.0, 40.0, 0.0, 1)], "less than"), ([("original", 0.1, None, 40.0, 0.0, 1)], "lacks")):
        with pytest.raises(Exception, match=text):
            reports.phase_profile(spark.createDataFrame(bad, PHASES)).collect()
    with pytest.raises(Exception, match="numbers of requests"):
        reports.phase_comparison(reports.phase_profile(spark.createDataFrame(rows[:3], PHASES))).collect()


def test_selection(spark):
    df = spark.createDataFrame([(i, f"r{i:02d}") for i in (5, 3, 9, 1, 7, 3)], "length int, row_id string")
    pick = lambda k: sorted(r["length"] for r in reports.select_quantiles(df, k).collect())
    assert pick(2) == [1, 9] and pick(1) == [5] and pick(3) == [1, 3, 9] and len(pick(9)) == 6


def test_gate_and_hash(spark):
    good = spark.createDataFrame([(0, 1.0, 2.0)], "cached_tokens long, queue_time_ms double, engine_prefill_interval_ms double")
    reports.require_metrics(good, "disabled")
    for bad, mode in (([(3, 1.0, 2.0)], "disabled"), ([(0, None, 2.0)], "enabled")):
        with pytest.raises(RuntimeError):
            reports.require_metrics(spark.createDataFrame(bad, good.schema), mode)
    reports.require_metrics(spark.createDataFrame([(0, None, 2.0)], good.schema), "enabled", allow_missing=True)
    df = spark.createDataFrame([(2, "b"), (1, "a")], "i int, t string")
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert reports.tree_digest(df, "t", "i").first()[0] == digest(digest("\n".join(map(digest, "ab"))))
    frame = pd.DataFrame({"t": ["a/é", 'q"\n'], "u": ["1", "x"]})
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(frame.itertuples(index=False))], "i int, t string, u string")
    assert reports.records_digest(df, ["t", "u"], "i").first()[0] == digest(frame.to_json(orient="records", force_ascii=False))
    rows = spark.createDataFrame([(0, 1, "b", "g"), (0, 0, "a", "g"), (1, 0, "c", "g"), (1, 1, "d", "h")], "batch int, place int, row_id string, group_id string")
    assert sorted(map(tuple, reports.batch_table(rows).collect())) == [(0, digest("a\nb")[:16], 2, 1), (1, digest("c\nd")[:16], 2, 2)]


def test_summary_of_runs(spark):
    rows = [(m, r, "s", 4, w, 0.1, 10.0, c, None if c is None else c / 10, None, a) for m, r, w, c, a in (("original", 0, 4.0, 2.0, 1.0), ("original", 1, 6.0, None, 1.0), ("greedy", 0, 2.0, 8.0, 0.5), ("greedy", 1, 2.0, 8.0, 1.0))]
    from rowloom.operators.compare import RUN

    out = {r["method"]: r for r in summarize_runs(spark.createDataFrame(rows, RUN)).collect()}
    assert (out["original"]["wall_seconds"], out["original"]["cached_tokens"], out["greedy"]["rows_per_second"], out["greedy"]["agreement_with_original"], out["greedy"]["speedup_vs_original"], out["original"]["greedy_speedup_vs_this_method"], out["greedy"]["accuracy"]) == (5.0, 2.0, 2.0, 0.75, 2.5, 2.5, None)
