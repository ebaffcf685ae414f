"""URL filters: rules first, then trust and distrust that spread along links between hosts.

Hosts most of whose pages a rule allows are trusted seeds, those most of whose pages a rule blocks are blocked seeds; a
host that is linked but has no page in the table counts as one page with the path ``/``.
Trust follows links from the trusted (personalised PageRank); distrust follows them backwards, from the blocked to those
that link to them. A page that no rule fits is blocked if its host has more distrust than trust. Links are summed by
pairs of hosts first, so rounds work on hosts alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import store
from .webpages import host_of

#: Rules as host, path and verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DAMPING, ROUNDS = 0.85, 20
HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules) of those hosts that rules (rule_host, rule_path, verdict) fit: as many as name the host or one of its domains."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = hosts.where("host <> ''").select("host", F.explode(suffixes).alias("rule_host")).join(rules, "rule_host")
    size = F.length("rule_host") + F.length("rule_path")
    return found.groupBy("host").agg(F.collect_list(F.struct(size.alias("size"), F.length("rule_host").alias("h"), "rule_path", F.concat("rule_host", "rule_path").alias("rule"), "verdict")).alias("rules"))


def spread(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(host, trust, distrust) of (host, trusted, blocked): both start from seeds that sum to one, or to none."""
    total = seeds.agg(F.sum("trusted"), F.sum("blocked")).first()
    start = lambda c, t: F.col(c) / t if t else F.lit(0.0)
    base = store(seeds.select("host", start("trusted", total[0]).alias("s"), start("blocked", total[1]).alias("z")), "url-seeds")
    ranks = base.select("host", F.col("s").alias("trust"), F.col("z").alias("distrust"))
    if edges.isEmpty():
        return ranks
    out, into = (edges.groupBy(c).agg(F.sum("links").alias(f"{c}_links")) for c in ("src", "dst"))
    edges = store(edges.join(out, "src").join(into, "dst"), "url-edges")
    for _ in range(ROUNDS):
        one = edges.join(ranks, edges.src == ranks.host).groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("trust") * F.col("links") / F.col("src_links")).alias("a"))
        two = edges.join(ranks, edges.dst == ranks.host).groupBy(F.col("src").alias("host")).agg(F.sum(F.col("distrust") * F.col("links") / F.col("dst_links")).alias("b"))
        moved = base.join(one, "host", "left").join(two, "host", "left")
        rank = lambda s, x: (1 - DAMPING) * F.col(s) + DAMPING * F.coalesce(x, F.lit(0.0))
        ranks = store(moved.select("host", rank("s", "a").alias("trust"), rank("z", "b").alias("distrust")), "url-ranks")
    return ranks


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", source: str | None = "html") -> DataFrame:
    """Add __rl_host, __rl_path, __rl_rule, __rl_verdict to all columns of ``pages``.

    The longest fitting rule decides (of equals the one with the longer host, then the one that blocks). Null urls and
    those without ``://`` have an empty host, which no rule fits and which is no seed: allowed. Links come from the
    ``href`` of ``a`` in ``source``, if given; those within a host say nothing. Equal rows are judged alike.
    """
    spark: SparkSession = pages.sparkSession
    address = pages.select(host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"), *([F.col(f"`{source}`").alias("html")] if source else []))
    table = spark.createDataFrame([(h.lower(), p, v) for h, p, v in rules], "rule_host string, rule_path string, verdict string")
    if source:
        found = address.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(HREF), 1)).alias("dst"))
        edges = found.withColumn("dst", F.lower("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))
    else:
        edges = spark.createDataFrame([], "src string, dst string, links long")
    edges = store(edges, "url-links")
    hosts = address.select("host").distinct()
    linked = edges.select(F.col("dst").alias("host")).distinct().join(hosts, "host", "left_anti")
    fits = store(fitting(hosts.unionByName(linked), table), "url-rules")

    def ruled(df: DataFrame) -> DataFrame:
        here = F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"]))
        return df.join(fits, "host", "left").withColumn("rule", F.array_max(here)).drop("rules")

    verdict = lambda v: F.avg(F.when(F.col("rule.verdict") == v, 1.0).otherwise(0.0)) > 0.5
    judged = ruled(address.select("host", "path").unionByName(linked.withColumn("path", F.lit("/"))))
    seeds = judged.where("host <> ''").groupBy("host").agg(verdict("allow").cast("double").alias("trusted"), verdict("block").cast("double").alias("blocked"))
    ranks = store(spread(seeds, edges), "url-hosts")
    names = [f"__rl_{i}" for i in range(len(pages.columns))]
    told = pages.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(pages.columns, names, strict=True)), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    out = ruled(told).join(ranks, "host", "left")
    by_method = F.when(F.coalesce(F.col("distrust") > F.col("trust"), F.lit(False)), "block").otherwise("allow")
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, pages.columns, strict=True)), F.col("host").alias("__rl_host"), F.col("path").alias("__rl_path"), F.col("rule.rule").alias("__rl_rule"), F.coalesce("rule.verdict", by_method).alias("__rl_verdict"))


def op3_url_filters(spark, sf_dir: str) -> DataFrame:
    """Verdicts on each of ``pages``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    names = [f"__rl_{c}" for c in ("host", "path", "rule", "verdict")]
    out = judge(pages, RULES)
    return out.select("page_id", *(F.col(n).alias(n[5:]) for n in names))


def _sql() -> str:
    rounds = "".join(f""",
r{k + 1} AS MATERIALIZED (SELECT s.host, 0.15 * s.s + 0.85 * coalesce(a.a, 0) AS trust, 0.15 * s.z + 0.85 * coalesce(b.b, 0) AS distrust FROM base s
  LEFT JOIN (SELECT dst AS host, sum(trust * links / src_links) AS a FROM e JOIN r{k} ON src = r{k}.host GROUP BY dst) a USING (host)
  LEFT JOIN (SELECT src AS host, sum(distrust * links / dst_links) AS b FROM e JOIN r{k} ON dst = r{k}.host GROUP BY src) b USING (host))""" for k in range(ROUNDS))
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    href = HREF.replace("'", "''")
    return f"""
WITH p AS (SELECT page_id, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(h, pa, v) AS (VALUES {rules}),
fit AS (SELECT DISTINCT host, path, h || pa AS rule, v, row_number() OVER (PARTITION BY host, path ORDER BY length(h || pa) DESC, length(h) DESC, v DESC) AS n
  FROM (SELECT DISTINCT host, path FROM p) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pa)),
j AS (SELECT p.page_id, p.html, p.host, p.path, f.rule, f.v FROM p LEFT JOIN fit f ON f.host = p.host AND f.path = p.path AND f.n = 1),
seeds AS (SELECT host, CASE WHEN avg(CASE WHEN v = 'allow' THEN 1.0 ELSE 0.0 END) > 0.5 THEN 1.0 ELSE 0.0 END AS t, CASE WHEN avg(CASE WHEN v = 'block' THEN 1.0 ELSE 0.0 END) > 0.5 THEN 1.0 ELSE 0.0 END AS b FROM j WHERE host <> '' GROUP BY host),
base AS MATERIALIZED (SELECT host, coalesce(CAST(t AS DOUBLE) / nullif((SELECT sum(t) FROM seeds), 0), 0) AS s, coalesce(CAST(b AS DOUBLE) / nullif((SELECT sum(b) FROM seeds), 0), 0) AS z FROM seeds),
l AS (SELECT src, dst, count(*) AS links FROM (SELECT host AS src, lower(unnest(regexp_extract_all(html, '{href}', 1))) AS dst FROM p WHERE host <> '') WHERE src <> dst AND dst IN (SELECT host FROM seeds) GROUP BY src, dst),
e AS MATERIALIZED (SELECT src, dst, links, sum(links) OVER (PARTITION BY src) AS src_links, sum(links) OVER (PARTITION BY dst) AS dst_links FROM l),
r0 AS MATERIALIZED (SELECT host, s AS trust, z AS distrust FROM base){rounds}
SELECT j.page_id, j.host, j.path, j.rule, coalesce(j.v, CASE WHEN r.distrust > r.trust THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN r{ROUNDS} r USING (host)
"""


SQL = _sql()
