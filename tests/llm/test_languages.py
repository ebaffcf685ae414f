import random

import pytest
from pyspark.sql import functions as F

from rowloom.llm import languages
from rowloom.llm.languages import address_language, fit, identify, op9_language_id

SYLLABLES = {"en": "the and ing ton wh ould er st".split(), "de": "sch ung ei keit der ä ö über".split(), "fr": "eau que ou é è tion la les".split(), "es": "ción ña el los ar ez ue ó".split()}


def made(language, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[language]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def corpus(n=600, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        k = rng.choice(list(SYLLABLES))
        rows.append((i, made(k, rng.choice((3, 10, 80, 400)), rng), k, f"src{rng.randrange(5)}"))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "id long, text string, lang string, source string")
    model = fit(df.where("id < 300").select("id", "text", "lang"))
    out = identify(df.where("id >= 300"), model, F.col("source")).collect()
    assert sum(r["__rl_lang"] == r["lang"] for r in out) >= 0.98 * len(out)
    assert all(r["__rl_accepted"] for r in out)


def test_query(spark, documents):
    rows = corpus() + [(None, made("en", 50, random.Random(1)), None, None), (2000, None), (2001, ""), (2002, " 12 345 !!"), (2003, "北京 大学 " * 50), (5, *corpus()[5][1:])]
    out = op9_language_id(spark, documents(rows)).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    assert not any(by[i]["accepted"] for i in (2000, 2001, 2002, 2003)) and by[2003]["language"] == "und"
    assert sum(by[i]["language"] == k for i, _, k, *_ in rows[:600]) >= 590 and all(by[i]["accepted"] for i in range(600))


def test_evidence_decides_where_text_does_not(spark):
    """Declared markup, an address and a host's other pages tip a text that fits two languages."""
    rng = random.Random(2)
    rows = [(i, made(k, 60, rng), k, f"http://{k}.example.com/{i}", None) for i, k in enumerate(["de", "fr"] * 100)]
    short = [(1000, "la", None, "http://x.test/1", "fr-CA"), (1001, "der", None, "http://y.test/de/1", None), (1002, "q", None, "http://de.example.com/9", None), (1003, "q", None, "http://fr.example.com/9", None), (1004, "q", None, None, "fr")]
    df = spark.createDataFrame(rows + short, "id long, text string, lang string, url string, declared string")
    model = fit(df.select("id", "text", "lang"))
    host = F.regexp_extract("url", "://([^/]+)", 1)
    out = {r["id"]: r for r in identify(df, model, host, F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.col("declared"), address_language(F.col("url"))).collect()}
    assert [out[i]["__rl_lang"] for i in range(1000, 1005)] == ["fr", "de", "de", "fr", "fr"]
    assert out[1002]["__rl_posterior"] > 0.9


def test_rare_languages_have_models_in_large_tables(spark, monkeypatch):
    monkeypatch.setattr(languages, "SAMPLE", 20)
    rows = [(i, f"the text number {i}", "en") for i in range(600)] + [(1000 + i, "wort und satz", f"x{i}") for i in range(3)]
    model = fit(spark.createDataFrame(rows, "id long, text string, lang string"))
    assert model.languages == ["en", "x0", "x1", "x2", "und"] and len(model.logs) == 5
    assert all(abs(model.logs[i] - model.logs[4]).max() > 0.1 for i in range(4))  # each is fitted on rows of its own


def test_address_language(spark):
    urls = ["http://a.example.com/de/x", "https://b.fr/p", "http://c.example.es:80/", "http://d.com/page", None, "no scheme", "http://e.de/FR"]
    out = [r[0] for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").orderBy("i").select(address_language(F.col("u"))).collect()]
    assert out == ["de", "fr", "es", None, None, None, "fr"]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "no label here"), (2, "12")]])
def test_without_labels(spark, documents, rows):
    out = {r["doc_id"]: (r["language"], r["accepted"]) for r in op9_language_id(spark, documents(rows)).collect()}
    assert out == {i: (None, i == 1 and t is not None) for i, t in rows}
