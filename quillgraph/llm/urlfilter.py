"""Op 2: URL filters over redirect equivalence. DataFrame functions only.

A rule (host, path) fits a page if the page's host is the rule's or a subdomain of it and the page's path starts with
the rule's path; the longest rule wins. Pages without a rule inherit: redirects (meta refresh, or rows the caller
brings) and canonical links are undirected edges between addresses, and every page of a connected component that
holds an address that a rule blocks, page or not, is blocked unless a rule of its own allows it. All other pages are
allowed. The SQL seeds from pages only, so it agrees where no blocked target is missing from pages.

An address is scheme-less, with a lower-case host and without fragment, so http/https and fragments are one node.
Components are distributed (quillgraph.graph.components); nothing is collected. Rules are the caller's short list.

Defined cases: null urls and urls without "://" have empty host and path, fit no rule and have no edges, so they are
allowed; null or broken html has no edges; targets that are no page connect pages and are judged; repeated pages are judged
alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.graph.components import connected_components
from quillgraph.llm.tables import table
from quillgraph.session import cut

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def address(url: Column) -> Column:
    """The node of an absolute url; null for others."""
    host, _ = host_and_path(url)
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(host != "", F.concat(host, F.regexp_extract(rest, "^[^/?#]*([^#]*)", 1)))


def resolved(target: Column, base: Column) -> Column:
    """An absolute url for a link target that may be relative to `base`."""
    scheme, site = F.regexp_extract(base, "^([^:]*):", 1), F.regexp_extract(base, r"^([^:]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([^:]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (
        F.when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target != "", F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), target))
    )


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst) between addresses: canonical links and meta refreshes of pages that have such a tag."""
    rows = pages.select(F.col(url).alias("url"), F.regexp_extract(html, CANONICAL, 0).alias("link"), F.regexp_extract(html, REFRESH, 0).alias("meta"))
    rows = rows.where("link <> '' or meta <> ''")
    targets = F.array(F.regexp_extract("link", HREF, 1), F.regexp_extract("meta", REFRESH_URL, 1))
    rows = rows.select("url", F.explode(targets).alias("to")).where("to <> ''")
    return rows.select(address(F.col("url")).alias("src"), address(resolved(F.col("to"), F.col("url"))).alias("dst")).where("src is not null and dst is not null and src <> dst")


def own_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict, inherited) of every page; redirects(src, dst) are further urls that redirect."""
    host, path = host_and_path(F.col(url_col))
    edges = link_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(address(F.col("src")).alias("src"), address(F.col("dst")).alias("dst")))
    component = connected_components(edges)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumns({"host": host, "path": path})
    rows = rows.withColumn("own", own_rule(F.col("host"), F.col("path"), rules)).withColumn("node", address(F.col("url"))).drop("url")
    rows = cut(rows.join(component.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").drop("of"))
    # every address of a component is judged, also those that are no page
    node_rule = own_rule(*host_and_path(F.concat(F.lit("http://"), F.col("node"))), rules)
    bad = component.where(node_rule["verdict"] == "block").select("component").distinct().withColumn("bad", F.lit(True))
    rows = rows.join(bad.withColumnRenamed("component", "of"), F.col("component") == F.col("of"), "left")
    inherited = F.col("own").isNull() & F.coalesce("bad", F.lit(False))
    verdict = F.when(inherited, "block").otherwise(F.coalesce("own.verdict", F.lit("allow")))
    return rows.select("id", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"), inherited.alias("inherited"))


def op2_url_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return filter_urls(pages).withColumnRenamed("id", "page_id")


ORACLE = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, html, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail FROM p),
n AS (SELECT *, CASE WHEN host <> '' THEN host || tail END AS node,
        CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
             WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
             WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
             WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM h),
t AS (SELECT node, url, regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS target FROM n
      UNION ALL
      SELECT node, url, regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) FROM n),
a AS (SELECT node, CASE WHEN strpos(target, '://') > 0 THEN target WHEN starts_with(target, '//') THEN split_part(url, ':', 1) || ':' || target
        WHEN starts_with(target, '/') THEN regexp_extract(url, '^([^:]*://[^/?#]*)', 1) || target END AS goal FROM t WHERE target <> ''),
b AS (SELECT node AS src, translate(regexp_extract(substr(goal, strpos(goal, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
        || regexp_extract(substr(goal, strpos(goal, '://') + 3), '^[^/?#]*([^#]*)', 1) AS dst FROM a WHERE goal IS NOT NULL),
e AS (SELECT src, dst FROM b WHERE src IS NOT NULL UNION SELECT dst, src FROM b WHERE src IS NOT NULL),
reach(node) AS (SELECT node FROM n WHERE rule IN ('net/', 'example.com/de/') UNION SELECT e.dst FROM reach JOIN e ON reach.node = e.src),
i AS (SELECT n.*, rule IS NULL AND node IS NOT NULL AND node IN (SELECT node FROM reach WHERE node IS NOT NULL) AS inherited FROM n)
SELECT page_id, host, path, rule, CASE WHEN inherited OR rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict, inherited FROM i"""
