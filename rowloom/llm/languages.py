"""Language ID by Bayesian fusion of evidence.

A text's likelihood comes from byte trigrams under one smoothed model for each language and one, ``und``, under which
all trigrams are alike; a declared markup language and the language that an address suggests (its country suffix, or
a language as first part of its path) are further evidence; and the prior is that of the row's host, smoothed towards its
domain's, which is smoothed towards that of all rows. These come from sums of the text's posteriors, by grouped
aggregation over all rows. Whole texts count.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import store
from .words import pieces

#: Each language's model is fitted on about so many labelled rows, those with the least hashes of their ids.
SAMPLE = 4000
BUCKETS = 1 << 15
#: Neighbouring trigrams share two bytes of three, so each counts as a third of one.
TEMPER = 1 / 3
#: Share of trigrams in any language that follow no language: names, codes, foreign words.
FOREIGN = 0.1
#: Prior of ``und``, weight of the prior above in smoothing (in rows), chance that a declaration or address is right.
UNKNOWN, WEIGHT, DECLARED, ADDRESSED = 1e-3, 10.0, 0.9, 0.8
#: Least posterior of all known languages together for a row to be accepted: a text that fits several of them stays.
LEAST = 0.5
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[[*range(9, 14)]] = 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def trigrams(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the trigrams of all texts together (BUCKETS for those not of letters and spaces alone), where each text's begin and end, and letters (or other bytes above 127) of each."""
    texts = b.column("text").cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    o = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    size = int(o[-1] - o[0])
    data = np.frombuffer(texts.buffers()[2], np.uint8, size, int(o[0])) if size else np.zeros(0, np.uint8)
    o = o - o[0]
    low = _LOWER[data]
    grams = ((low[:-2] * 0x9E3779B1 + low[1:-1] * 0x85EBCA77 + low[2:] * 0xC2B2AE3D) >> np.uint32(17)).astype(np.int64) if size > 2 else np.zeros(0, np.int64)
    used = _LETTER[data] | (low == 32)
    if len(grams):
        grams[~(used[:-2] & used[1:-1] & used[2:])] = BUCKETS
    letters = np.concatenate(([0], np.cumsum(_LETTER[data])))
    last = np.minimum(np.maximum(o[1:] - 2, o[:-1]), len(grams))
    return grams, np.stack([np.minimum(o[:-1], len(grams)), last]), letters[o[1:]] - letters[o[:-1]]


def _count(batches, languages: list[str]):
    total = np.zeros((len(languages), BUCKETS), np.int64)
    for b in pieces(batches, 1 << 20):
        grams, (first, last), _ = trigrams(b)
        which = np.array([languages.index(x) for x in b.column("lang").to_pylist()])
        for k in np.unique(which):
            own = np.concatenate([grams[first[i] : last[i]] for i in np.flatnonzero(which == k)])
            total[k] += np.bincount(own, minlength=BUCKETS + 1)[:BUCKETS]
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])


class Model:
    """Log likelihoods of trigrams, one row for each of ``languages``."""

    def __init__(self, languages: list[str], logs: np.ndarray):
        self.languages, self.logs = languages, logs


def fit(rows: DataFrame) -> Model:
    """A model of (id, text, lang); rows without a language or text are left out."""
    known = rows.where("lang is not null and text is not null").select(F.xxhash64("id").alias("h"), "lang", "text")
    sizes = sorted(tuple(r) for r in known.groupBy("lang").agg(F.count("*"), F.min("h")).collect())
    languages = [r[0] for r in sizes]
    if not languages:
        return Model([], np.zeros((0, BUCKETS + 1)))
    # hashes are even over 64 bits; a language whose least hash lies beyond its share has the rows of that one
    cuts = [max(least, (SAMPLE << 64) // n - (1 << 63)) if n > SAMPLE else (1 << 63) - 1 for _, n, least in sizes]
    cut = F.create_map(*(x for lang, c in zip(languages, cuts, strict=True) for x in (F.lit(lang), F.lit(c).cast("long"))))
    counted = known.where(F.col("h") <= cut[F.col("lang")]).select("text", "lang").repartition(8)
    total = np.zeros((len(languages), BUCKETS), np.int64)
    for r in counted.mapInArrow(lambda it: _count(it, languages), "counts binary").collect():
        total += np.frombuffer(bytes(r[0]), np.int64).reshape(total.shape)
    share = (total + 0.5) / (total.sum(1, keepdims=True) + 0.5 * BUCKETS)
    logs = np.log((1 - FOREIGN) * share + FOREIGN / BUCKETS)
    logs = np.vstack([logs, np.full(BUCKETS, -math.log(BUCKETS))])
    return Model([*languages, "und"], np.hstack([logs, np.zeros((len(logs), 1))]).astype(np.float32))


def score(batches, model: Model, carried: list[str]):
    """Tempered log likelihoods of each text, the best at 0, and its letters."""
    k = len(model.languages)
    for b in pieces(batches, 1 << 20):
        grams, (first, last), letters = trigrams(b)
        out = np.zeros((b.num_rows, k))
        for i in range(k):
            sums = np.concatenate(([0.0], np.cumsum(model.logs[i][grams], dtype=np.float64)))
            out[:, i] = (sums[last] - sums[first]) * TEMPER
        out -= out.max(1, keepdims=True) if k else 0
        logs = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * k), pa.array(out.ravel()))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), logs, pa.array(letters)], [*carried, "__rl_logs", "__rl_letters"])


def normal(logs: Column) -> Column:
    """Probabilities from logs."""
    raised = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, y: a + y))


def given(language: Column, languages: list[str], right: float) -> Column:
    """Log chance of a stated language under each; a null one, or one without a model, says nothing."""
    wrong = math.log((1 - right) / max(1, len(languages) - 1))
    return F.array(*(F.when(language.isin([x for x in languages if x != "und"]), F.when(language == x, math.log(right)).otherwise(wrong)).otherwise(0.0) for x in languages))


def address_language(url: Column) -> Column:
    """A two-letter first part of the path, else the suffix of the host; lower case; null if neither."""
    part = F.lower(F.regexp_extract(url, r"://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1))
    suffix = F.lower(F.regexp_extract(url, r"://[^/?#]*\.([A-Za-z]{2})(?::\d+)?(?:[/?#]|$)", 1))
    return F.when(F.length(part) > 0, part).when(F.length(suffix) > 0, suffix)


def identify(df: DataFrame, model: Model, host: Column, domain: Column | None = None, markup: Column | None = None, address: Column | None = None, text: str = "text") -> DataFrame:
    """Add __rl_lang, __rl_posterior and __rl_accepted to ``df``.

    Accepted: the known languages together have a posterior of LEAST or more, and the text has a letter; null, empty and
    letterless texts are not. Without a model (no labelled row) the language is null and texts with a letter are accepted.
    A null host is a host of its own. ``df`` is read twice.
    """
    names = [f"__rl_{i}" for i in range(len(df.columns))]
    null = F.lit(None).cast("string")
    short = lambda c: F.substring(F.lower(c), 1, 2)
    told = df.select(F.col(f"`{text}`").alias("text"), *(F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names, strict=True)), F.coalesce(host, F.lit("")).alias("__rl_host"), F.coalesce(domain if domain is not None else F.lit(""), F.lit("")).alias("__rl_domain"), (short(markup) if markup is not None else null).alias("__rl_markup"), (short(address) if address is not None else null).alias("__rl_address"))
    k = len(model.languages)

    def scored(carried: list[str]) -> DataFrame:
        schema = ", ".join([*(f"{n} {told.schema[n].dataType.simpleString()}" for n in carried), "__rl_logs array<double>, __rl_letters long"])
        return told.select("text", *carried).mapInArrow(lambda it: score(it, model, carried), schema)

    if not k:
        out = scored(names)
        return out.select(*(F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True)), null.alias("__rl_lang"), F.lit(None).cast("double").alias("__rl_posterior"), (F.col("__rl_letters") > 0).alias("__rl_accepted"))
    flat = F.array(*(F.lit(math.log(UNKNOWN if x == "und" else (1 - UNKNOWN) / (k - 1))) for x in model.languages))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    votes = scored(["__rl_host", "__rl_domain"]).where("__rl_letters > 0").withColumn("p", normal(add(F.col("__rl_logs"), flat)))
    sums = [F.sum(F.col("p")[i]).alias(f"n{i}") for i in range(k)]
    by_host = store(votes.groupBy("__rl_host", "__rl_domain").agg(*sums), "language-hosts")
    whole = by_host.agg(*(F.sum(f"n{i}") for i in range(k))).first()
    n = sum(x or 0 for x in whole)
    top = [((whole[i] or 0) + WEIGHT * (UNKNOWN if x == "und" else (1 - UNKNOWN) / (k - 1))) / (n + WEIGHT) for i, x in enumerate(model.languages)]
    by_domain = by_host.groupBy("__rl_domain").agg(*(F.sum(f"n{i}").alias(f"d{i}") for i in range(k)))
    total = lambda c: sum((F.col(f"{c}{i}") for i in range(1, k)), F.col(f"{c}0"))
    above = [(F.col(f"d{i}") + WEIGHT * top[i]) / (total("d") + WEIGHT) for i in range(k)]
    priors = by_host.join(by_domain, "__rl_domain").select("__rl_host", "__rl_domain", F.array(*(F.log((F.col(f"n{i}") + WEIGHT * above[i]) / (total("n") + WEIGHT)) for i in range(k))).alias("__rl_prior"))
    priors = store(priors, "language-priors")
    out = scored([*names, "__rl_host", "__rl_domain", "__rl_markup", "__rl_address"]).join(priors, ["__rl_host", "__rl_domain"], "left")
    logs = add(F.col("__rl_logs"), F.coalesce("__rl_prior", F.array(*(F.lit(math.log(x)) for x in top))))
    for c, right in (("__rl_markup", DECLARED), ("__rl_address", ADDRESSED)):
        logs = add(logs, given(F.col(c), model.languages, right))
    out = out.withColumn("__rl_p", normal(logs)).withColumn("__rl_posterior", F.array_max("__rl_p"))
    best = F.element_at(F.array(*map(F.lit, model.languages)), F.array_position("__rl_p", F.col("__rl_posterior")).cast("int"))
    best = F.when(F.col("__rl_letters") > 0, best).otherwise("und")
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True)), best.alias("__rl_lang"), "__rl_posterior", ((F.col("__rl_letters") > 0) & (F.element_at("__rl_p", -1) <= 1 - LEAST)).alias("__rl_accepted"))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of each of ``documents``, with its posterior to six decimals; sources stand for hosts, and neither markup
    nor address is known."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.select(F.col("doc_id").alias("id"), "text", "lang"))
    out = identify(docs.select("doc_id", "source", "text"), model, F.col("source"))
    return out.select("doc_id", F.col("__rl_lang").alias("language"), F.round("__rl_posterior", 6).alias("posterior"), F.col("__rl_accepted").alias("accepted"))


#: The same where no language has more than SAMPLE labelled rows, so that all of them fit its model, and one at least has some.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(source, '') AS source, text, hex(encode(coalesce(text, ''))) AS x FROM documents),
bytes AS (SELECT rid, unnest(list_transform(range(length(x) // 2), lambda i: [i, CAST('0x' || substr(x, 2 * i + 1, 2) AS INTEGER)])) AS e FROM d),
low AS (SELECT rid, e[1] AS i, CASE WHEN e[2] BETWEEN 65 AND 90 THEN e[2] + 32 WHEN e[2] BETWEEN 9 AND 13 THEN 32 ELSE e[2] END AS c FROM bytes),
letters AS (SELECT rid, count(*) AS n FROM low WHERE c BETWEEN 97 AND 122 OR c >= 128 GROUP BY rid),
three AS (SELECT rid, c AS a, lead(c) OVER w AS b, lead(c, 2) OVER w AS z FROM low WINDOW w AS (PARTITION BY rid ORDER BY i)),
grams AS (SELECT rid, ((a * {0x9E3779B1} + b * {0x85EBCA77} + z * {0xC2B2AE3D}) % {1 << 32}) >> 17 AS bucket, count(*) AS n FROM three
  WHERE z IS NOT NULL AND (a = 32 OR a BETWEEN 97 AND 122 OR a >= 128) AND (b = 32 OR b BETWEEN 97 AND 122 OR b >= 128) AND (z = 32 OR z BETWEEN 97 AND 122 OR z >= 128) GROUP BY ALL),
known AS (SELECT rid, lang FROM d WHERE lang IS NOT NULL AND text IS NOT NULL),
counts AS (SELECT lang, bucket, sum(n) AS n FROM grams JOIN known USING (rid) GROUP BY ALL),
langs AS (SELECT lang, row_number() OVER (ORDER BY lang) AS k, count(*) OVER () AS m, coalesce((SELECT sum(n) FROM counts c WHERE c.lang = l.lang), 0) AS total FROM (SELECT DISTINCT lang FROM known) l),
scores AS (SELECT g.rid, l.lang, sum(g.n * CAST(CAST(ln({1 - FOREIGN} * ((coalesce(c.n, 0) + 0.5) / (total + {0.5 * BUCKETS})) + {FOREIGN / BUCKETS}) AS FLOAT) AS DOUBLE)) AS v FROM grams g CROSS JOIN langs l LEFT JOIN counts c ON c.lang = l.lang AND c.bucket = g.bucket GROUP BY ALL
  UNION ALL SELECT rid, 'und', sum(n * CAST(CAST(-ln({BUCKETS}) AS FLOAT) AS DOUBLE)) FROM grams GROUP BY rid),
every AS (SELECT lang, k, CAST((1 - {UNKNOWN}) / m AS DOUBLE) AS prior FROM langs UNION ALL SELECT 'und', (SELECT count(*) + 1 FROM langs), {UNKNOWN}),
logs AS (SELECT d.rid, d.source, e.lang, e.k, e.prior, coalesce(s.v, 0) / 3 AS v, coalesce(n, 0) AS letters FROM d CROSS JOIN every e LEFT JOIN scores s ON s.rid = d.rid AND s.lang = e.lang LEFT JOIN letters t ON t.rid = d.rid),
flat AS (SELECT *, exp(v + ln(prior) - max(v + ln(prior)) OVER (PARTITION BY rid)) AS r FROM logs),
votes AS (SELECT source, lang, prior, r / sum(r) OVER (PARTITION BY rid) AS p FROM flat WHERE letters > 0),
whole AS (SELECT lang, sum(p) AS s FROM votes GROUP BY lang),
top AS (SELECT e.lang, (coalesce(s, 0) + {WEIGHT} * prior) / ((SELECT coalesce(sum(s), 0) FROM whole) + {WEIGHT}) AS t, coalesce(s, 0) AS s FROM every e LEFT JOIN whole USING (lang)),
above AS (SELECT lang, t, (s + {WEIGHT} * t) / (sum(s) OVER () + {WEIGHT}) AS a FROM top),
hosts AS (SELECT source, lang, sum(p) AS s FROM votes GROUP BY ALL),
priors AS (SELECT source, lang, (s + {WEIGHT} * a) / (sum(s) OVER (PARTITION BY source) + {WEIGHT}) AS q FROM hosts JOIN above USING (lang)),
fused AS (SELECT l.*, v + ln(coalesce(q, t)) AS f FROM logs l JOIN above USING (lang) LEFT JOIN priors p ON p.source = l.source AND p.lang = l.lang),
raised AS (SELECT *, exp(f - max(f) OVER (PARTITION BY rid)) AS r FROM fused),
post AS (SELECT *, r / sum(r) OVER (PARTITION BY rid) AS p FROM raised),
best AS (SELECT rid, max(letters) AS letters, arg_min(lang, struct_pack(a := -p, b := k)) AS lang, max(p) AS p, max(p) FILTER (lang = 'und') AS und FROM post GROUP BY rid)
SELECT doc_id, CASE WHEN letters > 0 THEN best.lang ELSE 'und' END AS language, round(p, 6) AS posterior, letters > 0 AND und <= {1 - LEAST} AS accepted FROM d JOIN best USING (rid)
"""
