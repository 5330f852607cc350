"""URL rules and redirect equivalence, in DataFrame operations only.

A url is judged by the longest rule that fits it: a rule fits its host and all
subdomains if the path starts with the rule's. Pages that name another url as
their own (canonical link, og:url, meta refresh) give edges between urls;
their connected components are aliases. Where no rule fits a url itself, an
alias that a rule allows makes it allowed, else an alias that a rule blocks
makes it blocked, else it is allowed.

Null urls and urls without `://` have empty host and path, fit no rule and are
no alias of anything: allowed. Null html gives no edges. Repeated rows are
judged alike; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from .components import components


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


def lower_az(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return lower_az(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)


def ruled(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fitting rule's string and verdict, or nulls; allow wins among equals."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.verdict == "allow")):
        fits = _fits(r, host, path)
        text, verdict = F.when(fits, r.host + r.path).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def _resolved(target: Column, host: Column, path: Column) -> Column:
    """An absolute url for what a page links to."""
    return (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(F.lit("http://"), host, target))
        .when(target != "", F.concat(F.lit("http://"), host, F.regexp_replace(path, "[^/]*$", ""), target))
    )


def _node(url: Column) -> Column:
    """What makes two urls one: host, path and query, not scheme or fragment."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1), F.lit(""))
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(path_of(url) == "", "/").otherwise(path_of(url)), query))


_ATTR = r"""(?is)\b%s\s*=\s*["']?([^"'>\s]+)"""


def _once(df: DataFrame, *cols: str) -> DataFrame:
    """df's columns, computed once: later expressions on them aren't merged with what makes them."""
    return df.select(F.explode(F.array(F.struct(*cols))).alias("r")).select("r.*")


def alias_edges(pages: DataFrame) -> DataFrame:
    """url and the url that its page names as its own, where it does."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    tag = F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0)))
    tags = pages.where(F.col("html").rlike(r"(?i)canonical|og:url|http-equiv\s*=\s*.?refresh")).select("url", host.alias("h"), path.alias("p"), tag.alias("tag"))
    tags = tags.where(F.col("tag").rlike(r"(?i)canonical|og:url|refresh"))
    t = F.col("tag")
    refresh = F.regexp_extract(t, r"""(?is)\bcontent\s*=\s*(?:"[^"]*?|'[^']*?|[^"'>\s]*?)url\s*=\s*["']?([^"'>\s]+)""", 1)
    target = (
        F.when(t.rlike(r"""(?is)^<link\b.*\brel\s*=\s*["']?canonical\b"""), F.regexp_extract(t, _ATTR % "href", 1))
        .when(t.rlike(r"""(?is)^<meta\b.*\bproperty\s*=\s*["']?og:url\b"""), F.regexp_extract(t, _ATTR % "content", 1))
        .when(t.rlike(r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?refresh\b"""), refresh)
    )
    targets = _once(tags.select("url", "h", "p", F.regexp_replace(target, "&amp;", "&").alias("target")), "url", "h", "p", "target").where("target is not null")
    named = _once(targets.select("url", _resolved(F.col("target"), F.col("h"), F.col("p")).alias("named")), "url", "named").where("named is not null")
    return named.select(_node(F.col("url")).alias("x"), _node(F.col("named")).alias("y")).where("x is not null and y is not null and x <> y").distinct()


def judge(pages: DataFrame, rules: list[Rule], edges: DataFrame | None = None, id_col: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict, decided_by (rule, alias or default). edges: further redirects, columns x and y of host/path?query."""
    pages = pages.select(F.col(id_col).alias("page_id"), "url", "html")
    links = alias_edges(pages)
    links = tables.cut(links if edges is None else links.unionByName(edges.select("x", "y")).distinct())
    rule, verdict = ruled(rules, F.col("host"), F.col("path"))
    rows = _once(pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), "page_id", "url", "host", "path")
    rows = rows.select("page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("own"))
    if links.take(1):
        nodes = links.select(F.col("x").alias("u")).union(links.select(F.col("y").alias("u"))).distinct()
        label = components(links)
        full = F.concat(F.lit("http://"), F.col("u"))
        judged = nodes.select("u", host_of(full).alias("host"), path_of(full).alias("path"))
        _, v = ruled(rules, F.col("host"), F.col("path"))
        judged = judged.select("u", v.alias("v")).join(label, F.col("u") == F.col("node"), "left").select("u", "v", F.coalesce("component", "u").alias("c"))
        judged = tables.cut(judged)
        of = tables.cut(judged.where("v is not null").groupBy("c").agg(F.min("v").alias("of")))  # 'allow' < 'block'
        passed = tables.cut(judged.join(of, "c").select("u", "of"))
        rows = rows.withColumn("u0", _node(F.col("url"))).join(passed, F.col("u0") == F.col("u"), "left")
    else:
        rows = rows.withColumn("of", F.lit(None).cast("string"))
    by = F.when(F.col("own").isNotNull(), "rule").when(F.col("of").isNotNull(), "alias").otherwise("default")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("own", "of", F.lit("allow")).alias("verdict"), by.alias("decided_by"))


RULES = [
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(tables.table(spark, sf_dir, "pages"), RULES)


#: For tables whose pages name no other url as their own, as the given ones; aliases are tested against brute force.
SQL = r"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (SELECT page_id, host, path, (SELECT struct_pack(rule := h || p, verdict := verdict) FROM r
      WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC LIMIT 1) AS b FROM u)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict, CASE WHEN b IS NULL THEN 'default' ELSE 'rule' END AS decided_by FROM m
"""
