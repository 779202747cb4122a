"""URL rules spread over redirect and canonical-link aliases.

A rule decides the urls that it fits.  Pages whose urls redirect to each other,
or name each other as canonical, are one component; a block decision reaches
the pages of its component that no rule fits, unless an allow decision is
among them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.components import components

ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``text`` is a host, with its subdomains, followed by the start of a path."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "".join(self.text.partition("/")[1:])


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits; among equal texts allow wins.  NULL if none fits."""
    choice = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.verdict == ALLOW)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        choice = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(choice)
    return choice


def address(url: Column) -> Column:
    """The url under which its plain redirects meet: no scheme, fragment, ``www.``, final slash or campaign parameters."""
    bare = F.regexp_replace(F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), path_of(url)), "/+$", "")
    query = F.regexp_extract(url, r"(?s)^[^#?]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|gclid|fbclid)=")), "&")
    return F.when(url.contains("://"), F.concat(bare, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def _resolved(target: Column, url: Column) -> Column:
    """An absolute url from a link: absolute, without scheme, from the root, or from the page's folder."""
    root = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*(?=/))?)", 1)
    return (F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.startswith("//"), F.concat(F.lit("http:"), target))
            .when(target.startswith("/"), F.concat(root, target)).when(target != "", F.concat(folder, F.lit("/"), target)))


def _decoded(target: Column) -> Column:
    """``target`` with its numeric and XML character references as characters; others, and invalid numbers, stay."""
    named = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}

    def one(part: Column) -> Column:
        digits = F.regexp_extract(part, "(?i)^&#x([0-9a-f]{1,8});$", 1)
        code = F.when(digits != "", F.conv(digits, 16, 10)).otherwise(F.nullif(F.regexp_extract(part, "^&#([0-9]{1,9});$", 1), F.lit(""))).cast("long")
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        out = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(63)), 8, "0")), "UTF-32")).otherwise(part)
        for name, character in named.items():
            out = F.when(part == name, F.lit(character)).otherwise(out)
        return out

    parts = F.regexp_extract_all(target, F.lit("&#?[0-9A-Za-z]+;|[^&]+|&"), F.lit(0))
    return F.when(target.contains("&"), F.array_join(F.transform(parts, one), "")).otherwise(target)


def links(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(src, dst) addresses of all canonical links and refresh redirects; an attribute may stand before or after the other."""
    page = F.col(html)
    canonical = F.regexp_extract_all(page, F.lit(r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'>\s]+)"), F.lit(1))
    refresh = F.regexp_extract_all(page, F.lit(r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\bcontent\s*=\s*[\"']?\s*[\d.]*\s*[;,]\s*url\s*=\s*[\"']?([^\"'>\s]+)"), F.lit(1))
    rows = pages.where(page.rlike("(?i)canonical|http-equiv")).select(F.col(url).alias("url"), F.explode(F.concat(canonical, refresh)).alias("target")).withColumn("target", _decoded(F.col("target")))
    return rows.select(address(F.col("url")).alias("src"), address(_resolved(F.col("target"), F.col("url"))).alias("dst"))


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", html: str = "html", redirects: DataFrame | None = None,
          default: str = ALLOW) -> DataFrame:
    """``pages`` plus ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` is a short list held in the plan.  ``redirects`` may name further
    equivalent urls as (src, dst).  A page's own rule stands.  Without one, the
    verdict is allow if an allow rule fits any page of its component, else block
    if a block rule does, else ``default``.  A NULL url, or one without ``://``,
    has empty host and path and no alias.  NULL and empty html has no links.
    Repeated rows are judged alike.  Input columns with the names of the new
    ones are replaced.
    """
    new = ("host", "path", "rule", "verdict")
    keep = [c for c in pages.columns if c not in new]
    named = pages.select(*keep, host_of(F.col(url)).alias("__host"), path_of(F.col(url)).alias("__path"), address(F.col(url)).alias("__address"))
    ruled = named.withColumn("__match", match(F.col("__host"), F.col("__path"), rules))
    edges = links(pages, url, html)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(address(F.col("src")).alias("src"), address(F.col("dst")).alias("dst")))
    groups = components(edges, "src", "dst").select(F.col("node").alias("__address"), F.col("root").alias("__root"))
    decided = ruled.where("__match IS NOT NULL AND __address IS NOT NULL").groupBy("__address").agg(
        F.bool_or(F.col("__match.verdict") == ALLOW).alias("allowed"), F.bool_or(F.col("__match.verdict") == BLOCK).alias("blocked"))
    roots = decided.join(groups, "__address", "left").groupBy(F.coalesce("__root", "__address").alias("__root")).agg(
        F.when(F.bool_or("allowed"), ALLOW).when(F.bool_or("blocked"), BLOCK).alias("__spread"))
    # Of the addresses that no rule fits, those with decided aliases.
    members = groups.unionByName(roots.select(F.col("__root").alias("__address"), "__root").join(groups.select("__address"), "__address", "left_anti"))
    spread = members.join(roots, "__root").select("__address", "__spread")
    judged = ruled.join(spread, "__address", "left")
    verdict = F.coalesce("__match.verdict", "__spread", F.lit(default))
    return judged.select(*keep, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__match.rule").alias("rule"), verdict.alias("verdict"))


#: The rules that the query applies, as given.
RULES = [Rule(ALLOW, "org/"), Rule(BLOCK, "example.org/es/"), Rule(BLOCK, "example.org/en/1"), Rule(ALLOW, "com/fr/"), Rule(BLOCK, "com/de/")]

_SQL_ADDRESS = r"""CASE WHEN contains({u}, '://') THEN regexp_replace(regexp_replace(translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^www\.', '')
    || regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '/+$', '') || coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_extract({u}, '(?s)^[^#?]*\?([^#]*)', 1), '&'),
    lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|gclid|fbclid)=')), '&'), ''), '') END"""

ORACLE = r"""
WITH RECURSIVE rules(verdict, rule) AS (VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')),
p AS (
    SELECT page_id, url, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, @page AS address FROM pages
), ruled AS (
    SELECT p.*, (SELECT arg_max((r.rule, r.verdict), length(r.rule)) FROM rules r
                 WHERE (host = split_part(r.rule, '/', 1) OR ends_with(host, '.' || split_part(r.rule, '/', 1))) AND starts_with(path, r.rule[length(split_part(r.rule, '/', 1)) + 1:])) AS m FROM p
), tags AS (
    SELECT url, path, address, unnest(list_concat(regexp_extract_all(html, '(?is)<link\b[^>]*'), regexp_extract_all(html, '(?is)<meta\b[^>]*'))) AS tag FROM p
), found AS (
    SELECT url, path, address, unnest(regexp_extract_all(CASE
        WHEN regexp_matches(tag, '(?is)^<link\b.*\brel[\s\v]*=[\s\v]*["'']?canonical\b') THEN regexp_extract(tag, '(?is)^.*\bhref[\s\v]*=[\s\v]*["'']?([^"''>\s\v]+)', 1)
        WHEN regexp_matches(tag, '(?is)^<meta\b.*\bhttp-equiv[\s\v]*=[\s\v]*["'']?refresh\b')
        THEN regexp_extract(tag, '(?is)^.*\bcontent[\s\v]*=[\s\v]*["'']?[\s\v]*[\d.]*[\s\v]*[;,][\s\v]*url[\s\v]*=[\s\v]*["'']?([^"''>\s\v]+)', 1) END, '(?s)^.+$')) AS raw FROM tags
), coded AS (
    SELECT *, list_transform(regexp_extract_all(raw, '(?s)&#?[0-9A-Za-z]+;|[^&]+|&'), lambda x: {'part': x, 'code': TRY_CAST(CASE
        WHEN regexp_matches(x, '^&#[xX][0-9A-Fa-f]{1,8};$') THEN '0x' || x[4:-2] WHEN regexp_matches(x, '^&#[0-9]{1,9};$') THEN x[3:-2] END AS BIGINT)}) AS parts FROM found
), decoded AS (
    SELECT url, path, address, array_to_string(list_transform(parts, lambda x: CASE x.part WHEN '&amp;' THEN '&' WHEN '&lt;' THEN '<' WHEN '&gt;' THEN '>' WHEN '&quot;' THEN '"' WHEN '&apos;' THEN chr(39)
        ELSE CASE WHEN x.code BETWEEN 1 AND 55295 OR x.code BETWEEN 57344 AND 1114111 THEN chr(x.code::INTEGER) ELSE x.part END END), '') AS target FROM coded
), resolved AS (
    SELECT address AS src, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target WHEN starts_with(target, '//') THEN 'http:' || target
        WHEN starts_with(target, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || target
        ELSE regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || regexp_extract(path, '(?s)^(.*)/[^/]*$', 1) || '/' || target END AS dst FROM decoded
), edges AS (
    SELECT src, @dst AS dst FROM resolved
), near(a, b) AS (
    SELECT DISTINCT address, address FROM p WHERE address IS NOT NULL
    UNION SELECT n.a, e.y FROM near n JOIN (SELECT src AS x, dst AS y FROM edges UNION ALL SELECT dst, src FROM edges) e ON e.x = n.b
), spread AS (
    SELECT n.a, bool_or(r.m[2] = 'allow') AS allowed, bool_or(r.m[2] = 'block') AS blocked FROM near n JOIN ruled r ON r.address = n.b WHERE r.m IS NOT NULL GROUP BY n.a
)
SELECT page_id, host, path, r.m[1] AS rule, coalesce(r.m[2], CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' END, 'allow') AS verdict
FROM ruled r LEFT JOIN spread s ON s.a = r.address
""".replace("@page", _SQL_ADDRESS.format(u="url")).replace("@dst", _SQL_ADDRESS.format(u="dst"))
