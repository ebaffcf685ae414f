import re

import pytest

from rowloom.llm.urlfilter import DAMPING, ROUNDS, RULES, judge, op3_url_filters


def split(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("", "") if not m else (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2])


def ruled(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, default=(0, None, None))[1:]


URLS = ["http://a.example.net/en/1", "http://A.EXAMPLE.net/de/1?x#y", "https://example.com/de/", "https://sub.example.com/de/x", "http://example.com/fr", "http://x.org/fr/2", "http://x.org/fr", "http://y.net", "http://y.net/", "http://notnet/", "ftp://net/a://b/c", None, "no scheme", "http://", "http://É.net/x", "x://h?a/b", "http://z.example.net/en", "http://a.com#f/g"]


def test_rules(spark, tmp_path):
    rows = [(i, u, "<p>no links</p>") for i, u in enumerate(URLS)] + [(0, URLS[0], None), (None, URLS[2], "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' as host", "'clash' as rules", "'clash' as verdict").write.parquet(str(tmp_path / "pages.parquet"))
    out = op3_url_filters(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    for r in out:
        url = URLS[2] if r["page_id"] is None else URLS[r["page_id"]]
        host, path = split(url)
        rule, verdict = ruled(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), url
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")


def brute(edges, trusted, blocked, hosts):
    """Dense power iteration."""
    def run(seeds, links):
        base = {h: (1 / len(seeds) if h in seeds else 0.0) for h in hosts} if seeds else dict.fromkeys(hosts, 0.0)
        out = {}
        for (a, _), n in links.items():
            out[a] = out.get(a, 0) + n
        rank = base
        for _ in range(ROUNDS):
            new = {h: (1 - DAMPING) * base[h] for h in hosts}
            for (a, b), n in links.items():
                new[b] += DAMPING * rank[a] * n / out[a]
            rank = new
        return rank

    return run(trusted, edges), run(blocked, {(b, a): n for (a, b), n in edges.items()})


def test_trust_and_distrust_spread(spark):
    link = lambda *hosts: "".join(f'<a class=x href="http://{h}/p">l</a> <a href=/local>l</a>' for h in hosts)
    rules = [("good.test", "/", "allow"), ("bad.test", "/", "block")]
    pages = [("good.test", link("friend.test", "friend.test", "both.test")), ("bad.test", link("bystander.test")), ("spam.test", link("bad.test", "spammer.test")), ("spammer.test", link("spam.test", "SPAM.test")), ("friend.test", ""), ("both.test", link("bad.test")), ("bystander.test", None), ("alone.test", "<p>")]
    df = spark.createDataFrame([(i, f"http://{h}/", x) for i, (h, x) in enumerate(pages)], "id long, url string, html string")
    out = {r["__rl_host"]: r["__rl_verdict"] for r in judge(df, rules).collect()}
    edges = {("good.test", "friend.test"): 2, ("good.test", "both.test"): 1, ("bad.test", "bystander.test"): 1, ("spam.test", "bad.test"): 1, ("spam.test", "spammer.test"): 1, ("spammer.test", "spam.test"): 2, ("both.test", "bad.test"): 1}
    trust, distrust = brute(edges, ["good.test"], ["bad.test"], [h for h, _ in pages])
    for h, _ in pages:
        expected = {"good.test": "allow", "bad.test": "block"}.get(h, "block" if distrust[h] > trust[h] else "allow")
        assert out[h] == expected, h
    assert [out[h] for h in ("spam.test", "spammer.test", "friend.test", "bystander.test", "alone.test")] == ["block", "block", "allow", "allow", "allow"]


def test_hosts_that_are_only_linked(spark):
    """Listed hosts without a page are seeds too: those that link to blocked ones are distrusted."""
    link = lambda *hosts: "".join(f'<a href="http://{h}/p">l</a>' for h in hosts)
    rules = [("net", "/", "block"), ("good.test", "/", "allow"), ("part.test", "/x/", "block")]
    pages = [("good.test", link("friend.test", "unknown.test")), ("spam.test", link("www.bad.NET", "unknown.test")), ("second.test", link("spam.test")), ("friend.test", link("unknown.test")), ("partly.test", link("part.test"))]
    df = spark.createDataFrame([(i, f"http://{h}/", x) for i, (h, x) in enumerate(pages)], "id long, url string, html string")
    rows = judge(df, rules).collect()
    edges = {("good.test", "friend.test"): 1, ("good.test", "unknown.test"): 1, ("spam.test", "www.bad.net"): 1, ("spam.test", "unknown.test"): 1, ("second.test", "spam.test"): 1, ("friend.test", "unknown.test"): 1, ("partly.test", "part.test"): 1}
    trust, distrust = brute(edges, ["good.test"], ["www.bad.net"], sorted({h for e in edges for h in e}))
    assert len(rows) == len(pages)
    for r in rows:
        h = r["__rl_host"]
        assert r["__rl_verdict"] == ("allow" if h == "good.test" else "block" if distrust[h] > trust[h] else "allow"), h
    assert {r["__rl_host"] for r in rows if r["__rl_verdict"] == "block"} == {"spam.test", "second.test"}


@pytest.mark.parametrize("rows", [[], [(1, None, None)]])
def test_tiny(spark, tmp_path, rows):
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert [r["verdict"] for r in op3_url_filters(spark, str(tmp_path)).collect()] == ["allow"] * len(rows)
