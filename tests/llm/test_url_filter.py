"""URL rules and their spread against a direct search."""

import random
import re

import duckdb
from pyspark.sql import functions as F

from assay.llm import url_filter as uf
from assay.llm.queries import QUERIES


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"(?s)[^/?#]*", rest)[0]
    path = re.match(r"(?s)[^?#]*", rest[len(host):])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.text), r.verdict == "allow"), default=None)


def test_rules(spark):
    urls = ["http://a.example.org/es/1", "https://example.org/en/12?x=/fr/", "http://EXAMPLE.org/en/2#a", "http://badexample.org/es/1", "ftp://x.com/fr/", "http://x.com/de/9://", "http://x.com/DE/", "http://x.net/fr/",
            "http://com/de/", "http://org", "http://org?/", "no scheme", "://org/", "a://b://org/", None, "", "http://\nx.org/\n#", "http://É.com/fr/é", "http://x.com:80/fr/", "http://" + "a." * 20_000 + "org/" + "p" * 50_000]
    df = spark.createDataFrame([(i, u, None, "old") for i, u in enumerate(urls)] + [(0, urls[0], "", "old")], "page_id long, url string, html string, host string")
    found = uf.judge(df, uf.RULES).collect()
    assert len(found) == len(urls) + 1
    for r in found:
        host, path = split(r["url"])
        rule = rule_of(host, path, uf.RULES)
        assert (r["host"], r["path"]) == (host, path)
        assert (r["rule"], r["verdict"]) == ((rule.text, rule.verdict) if rule else (None, "allow")), r["url"]
    assert uf.judge(df.limit(0), uf.RULES).count() == 0


def slow_verdicts(pages, rules, edges):
    """Verdicts by repeated spreading over ``edges`` of page positions."""
    own = [rule_of(*split(u), rules) for u, _ in pages]
    groups = [{i} for i in range(len(pages))]
    for a, b in edges:
        if groups[a] is not groups[b]:
            groups[a] |= groups[b]
            for i in groups[b]:
                groups[i] = groups[a]
    out = []
    for i, rule in enumerate(own):
        near = {own[j].verdict for j in groups[i] if own[j]}
        out.append(rule.verdict if rule else "allow" if "allow" in near or not near else "block")
    return out


def test_decisions_spread_over_aliases(spark):
    rng = random.Random(2)
    rules = [uf.Rule("block", "bad.net/"), uf.Rule("allow", "good.net/"), uf.Rule("allow", "bad.net/ok/")]
    hosts = ["bad.net", "good.net"] + [f"h{i}.info" for i in range(12)]
    urls = [f"http://{rng.choice(hosts)}/{'ok/' if i % 9 == 0 else ''}p{i}" for i in range(120)]
    pages, edges = [], []
    for i, u in enumerate(urls):
        html = "<html>"
        if i and rng.random() < 0.6:
            j = rng.randrange(max(0, i - 4), i)
            edges.append((i, j))
            html = rng.choice(['<head><LINK href="{}" rel=canonical>', "<link rel='canonical' title=x href='{}'/>", '<meta http-equiv="refresh" content="0; url={}">']).format(urls[j])
        pages.append((u, html))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string").repartition(4)
    found = {r["page_id"]: r["verdict"] for r in uf.judge(df, rules).collect()}
    expected = slow_verdicts(pages, rules, edges)
    assert [found[i] for i in range(len(pages))] == expected
    assert {"allow", "block"} == set(expected)


def test_addresses_and_redirects(spark):
    rules = [uf.Rule("block", "bad.net/")]
    rows = [(1, "http://x.info/a", '<link rel="canonical" href="/b">'), (2, "https://www.X.info/b/#top", None), (3, "http://x.info/b?utm_source=q", ""), (4, "http://x.info/b?id=1", ""),
            (5, "http://x.info/d/e", "<link rel=canonical href=f>"), (6, "http://x.info/d/f", ""), (7, "http://bad.net/1", '<link rel=canonical href="//x.info/d/f">'), (8, "http://y.info/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    more = spark.createDataFrame([("http://bad.net/z", "http://x.info/a"), (None, "http://y.info/"), ("http://bad.net/z", "http://bad.net/z")], "src string, dst string")
    plain = {r["page_id"]: r["verdict"] for r in uf.judge(df, rules).collect()}
    assert plain == {1: "allow", 2: "allow", 3: "allow", 4: "allow", 5: "block", 6: "block", 7: "block", 8: "allow"}
    # A url that is no page decides nothing by itself, but one that is connects.
    pages = df.union(spark.createDataFrame([(9, "http://bad.net/z", None)], df.schema))
    told = {r["page_id"]: r["verdict"] for r in uf.judge(pages, rules, redirects=more).collect()}
    assert told == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "block", 6: "block", 7: "block", 8: "allow", 9: "block"}


def test_whole_table_without_python(spark, sf):
    query = QUERIES["op2_url_filter"](spark, sf)
    plan = query._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = query.collect()
    assert sorted(r["page_id"] for r in rows) == sorted(urls)
    for r in rows:
        rule = rule_of(*split(urls[r["page_id"]]), uf.RULES)
        assert (r["host"], r["path"]) == split(urls[r["page_id"]])
        assert r["rule"] == (rule.text if rule else None)
        assert r["verdict"] == (rule.verdict if rule else "allow")


def test_every_link_counts_and_references_are_decoded(spark):
    rules = [uf.Rule("block", "bad.net/")]
    rows = [(1, "http://bad.net/1", '<link rel=canonical href="http://a.info/p?x=1&amp;y=2">'), (2, "http://a.info/p?x=1&y=2", ""),
            (3, "http://bad.net/2", '<link rel=canonical href="http://a.info/q"><link rel=canonical href="http://a.info/r?a=1&#38;b=2&#x26;c=&#233;">'), (4, "http://a.info/r?a=1&b=2&c=é", None), (5, "http://a.info/q", ""),
            (6, "http://bad.net/3", '<meta http-equiv=refresh content="0;url=/x"><meta http-equiv=refresh content="0;url=http://a.info/s?t=&#xD800;&nbsp;&u">'), (7, "http://a.info/s?t=&#xD800;&nbsp;&u", None),
            (8, "http://a.info/p?x=1", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    verdicts = {r["page_id"]: r["verdict"] for r in uf.judge(df, rules).collect()}
    assert {i for i, v in verdicts.items() if v == "block"} == {1, 2, 3, 4, 5, 6, 7}


def test_sql_twin_on_pages_with_links(spark):
    rng = random.Random(5)
    paths = ["/de/", "/es/", "/a/b/", "/x//", "/en/1", "", "/", "/q;r/", "/\u00e9/"]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(['', 'www.'])}{rng.choice(['s.com', 'S.com', 'example.org', 't.net', 'u.info', 'v.info'])}{rng.choice(paths)}"
            f"{rng.choice(['', f'p{i}', f'p{i}#top', f'p{i}/', f'?id={i}&b=2', f'?utm_source=a&n={i}'])}" for i in range(240)] + [None, "", "no scheme", "://x", "http://"]
    tags = ['<link rel=canonical href="{}">', "<LINK title=a>b HREF='{}' Rel = 'canonical'/>", "<link href=\n'{}'\n rel=canonical>", '<meta http-equiv="refresh" content="0;url={}">', "<meta content='5 , URL = {}' http-equiv=Refresh>",
            "<link rel=canonical href=first href={}>", "<link rel=canonicals href={}>", "<link rel=next href={}>", "<meta http-equiv=refresh content=5>", "<link rel=canonical>", "<link <meta http-equiv=refresh content=';url={}'>", '<link rel=canonical href="{}',
            "<meta name=refresh content='0;url={}'>", "<linked rel=canonical href={}>"]
    forms = [lambda u: u, lambda u: u.replace("&", "&amp;"), lambda u: u.replace("&", "&#38;"), lambda u: u.replace("&", "&#X26;"), lambda u: u.replace("/", "&#x2f;"), lambda u: u + "&nbsp;&#xD800;&#0;&#99999999;&",
             lambda u: "//" + u.partition("://")[2], lambda u: "/" + u.rpartition("/")[2], lambda u: u.rpartition("/")[2], lambda u: "//", lambda u: ""]
    html = lambda: rng.choice([None, "", "<html>"]) if rng.random() < 0.5 else "".join(rng.choice(tags).format(rng.choice(forms)(rng.choice(urls) or "")) for _ in range(rng.choice([1, 1, 2])))
    rows = [(i, u, html()) for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows + rows[:3], "page_id long, url string, html string")
    found = sorted(tuple(r) for r in uf.judge(df, uf.RULES).select("page_id", "host", "path", F.coalesce("rule", F.lit("")), "verdict").collect())
    con = duckdb.connect()
    con.register("pages", df.toPandas().astype(object).where(lambda x: x.notna(), None))
    expected = sorted((a, b, c, d or "", e) for a, b, c, d, e in con.sql(uf.ORACLE).fetchall())
    assert found == expected
    ruled = {i for i, _, _, rule, _ in found if rule}
    assert any(v == "block" for i, _, _, _, v in found if i not in ruled)
    assert uf.links(df, "url", "html").where("src <> dst").count() > 50
