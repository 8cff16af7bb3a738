"""URL filters: longest-match rules, and block decisions carried over redirect and canonical-link edges.

Defined results: a null url, or one without ://, has an empty host and path and fits no rule. A page with a rule of its own
keeps that rule's verdict. Without one, the pages and link targets that redirects and canonical links connect to it decide:
an explicit allow anywhere among them allows, else an explicit block blocks, else the page is allowed. Repeated rows each
give a row; an empty table gives none; extra columns are ignored; html may be absent or null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import LOWER, UPPER, ascii_lower, stored, table
from cellweave.llm.components import components


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str = "/"


RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
_HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_META = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, _PARTS, 1)), F.regexp_extract(url, _PARTS, 2)


def matched(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> tuple[Column, Column]:
    """rule and verdict of the longest rule that fits; null if none does. The rules are a parameter, hence literals."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.host + r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule = F.when(fits, F.lit(r.host + r.path)).otherwise(rule)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def node(url: Column) -> Column:
    """The url that stands for a page: without its fragment, scheme and host in lower case."""
    whole = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^#]*", 0)
    head = F.regexp_extract(whole, r"(?s)^[^/]*://[^/?]*", 0)
    return F.concat(ascii_lower(head), F.substring(whole, F.length(head) + 1, F.length(whole)))


def link_edges(pages: DataFrame) -> DataFrame:
    """a, b: page and target of each canonical link and refresh redirect in the html."""
    html = F.col("html").cast("string") if "html" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col("url").cast("string").alias("url"), html.alias("html")).filter(F.col("html").rlike("(?i)canonical|refresh") & F.col("url").contains("://"))
    tags = F.concat(
        F.transform(F.regexp_extract_all("html", F.lit(_LINK), F.lit(0)), lambda t: F.regexp_extract(t, _HREF, 1)),
        F.transform(F.regexp_extract_all("html", F.lit(_META), F.lit(0)), lambda t: F.regexp_extract(t, _URL, 1)),
    )
    found = rows.select("url", F.explode(tags).alias("to")).filter("to <> ''").withColumn("to", F.replace("to", F.lit("&amp;"), F.lit("&")))
    site = F.regexp_extract("url", r"(?s)^[^/]*://[^/?#]*", 0)
    to = F.when(F.col("to").startswith("//"), F.concat(F.regexp_extract("url", r"(?s)^[^/]*:", 0), F.col("to")))
    to = to.when(F.col("to").startswith("/"), F.concat(site, F.col("to"))).when(F.col("to").contains("://"), F.col("to"))
    return found.select(node(F.col("url")).alias("a"), node(to).alias("b")).filter("b <> '' AND a <> b")


def judged(pages: DataFrame, edges: DataFrame | None = None, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages. edges (a, b: urls) adds redirects known from elsewhere."""
    url = F.col("url").cast("string")
    host, path = host_and_path(url)
    rows = pages.select("page_id", url.alias("_url"), host.alias("host"), path.alias("path"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("_own", verdict).withColumn("_node", node(F.col("_url")))
    links = link_edges(pages)
    if edges is not None:
        links = links.union(edges.select(node(F.col("a")), node(F.col("b"))))
    links = stored(links.distinct())
    out = ["page_id", "host", "path", "rule"]
    if links.isEmpty():
        return rows.select(*out, F.coalesce("_own", F.lit("allow")).alias("verdict"))
    members = stored(components(links))
    host, path = host_and_path(F.col("node"))
    decided = members.withColumn("_own", matched(host, path, rules)[1]).groupBy("component")
    decided = decided.agg(F.max(F.col("_own") == "allow").alias("allow"), F.max(F.col("_own") == "block").alias("block"))
    alias = F.when(F.col("allow"), "allow").when(F.col("block"), "block")
    aliases = members.join(decided, "component").select(F.col("node").alias("_node"), alias.alias("_alias"))
    return rows.join(aliases, "_node", "left").select(*out, F.coalesce("_own", "_alias", F.lit("allow")).alias("verdict"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))


QUERIES = {"op3_url_filters": op3_url_filters}


def _oracle() -> str:
    def match(host: str, path: str, what: str) -> str:
        ordered = sorted(RULES, key=lambda r: (len(r.host + r.path), r.host + r.path), reverse=True)
        return "CASE " + " ".join(f"WHEN ({host} = '{r.host}' OR ends_with({host}, '.{r.host}')) AND starts_with({path}, '{r.path}') THEN '{r.host + r.path if what == 'rule' else r.verdict}'" for r in ordered) + " END"

    def low(x: str) -> str:
        return f"translate({x}, '{UPPER}', '{LOWER}')"

    def as_node(u: str) -> str:
        whole = f"regexp_extract({u}, '(?s)^[^#]*')"
        head = f"regexp_extract({whole}, '(?s)^[^/]*://[^/?]*')"
        return f"{low(head)} || substr({whole}, length({head}) + 1)"

    q = lambda pattern: pattern.replace("'", "''")
    return rf"""
WITH RECURSIVE p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
h AS (SELECT *, {low(f"regexp_extract(url, '{_PARTS}', 1)")} AS host, regexp_extract(url, '{_PARTS}', 2) AS path, {as_node("url")} AS node FROM p),
t AS (SELECT url, unnest(list_concat(list_transform(regexp_extract_all(html, '{q(_LINK)}'), lambda x: regexp_extract(x, '{q(_HREF)}', 1)),
                                     list_transform(regexp_extract_all(html, '{q(_META)}'), lambda x: regexp_extract(x, '{q(_URL)}', 1)))) AS raw
      FROM p WHERE contains(url, '://') AND regexp_matches(html, '(?i)canonical|refresh')),
f AS (SELECT url, replace(raw, '&amp;', '&') AS raw FROM t WHERE raw <> ''),
a AS (SELECT url, CASE WHEN starts_with(raw, '//') THEN regexp_extract(url, '(?s)^[^/]*:') || raw WHEN starts_with(raw, '/') THEN regexp_extract(url, '(?s)^[^/]*://[^/?#]*') || raw
                       WHEN contains(raw, '://') THEN raw END AS to_url FROM f),
e AS (SELECT {as_node("url")} AS a, {as_node("to_url")} AS b FROM a WHERE to_url IS NOT NULL),
s AS (SELECT a, b FROM e WHERE a <> b AND b <> '' UNION SELECT b, a FROM e WHERE a <> b AND b <> ''),
reach(a, b) AS (SELECT a, a FROM s UNION SELECT r.a, s.b FROM reach r JOIN s ON r.b = s.a),
n AS (SELECT a, b, {low(f"regexp_extract(b, '{_PARTS}', 1)")} AS host, regexp_extract(b, '{_PARTS}', 2) AS path FROM reach),
v AS (SELECT a, {match("host", "path", "verdict")} AS verdict FROM n),
g AS (SELECT a AS node, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' WHEN bool_or(verdict = 'block') THEN 'block' END AS alias FROM v GROUP BY a)
SELECT page_id, host, path, {match("host", "path", "rule")} AS rule, coalesce({match("host", "path", "verdict")}, g.alias, 'allow') AS verdict
FROM h LEFT JOIN g USING (node)"""


ORACLE = {"op3_url_filters": _oracle()}
