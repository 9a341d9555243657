"""URL filters with redirect equivalence (operator 2), in DataFrame functions only.

A page's own rule decides it. Pages without one follow their aliases: pages are tied by canonical
links and by redirects in their html, connected components of these ties are found by rounds of joins,
and a component with a blocked member is blocked, unless an explicit allow rule fits one of its urls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsline.llm.common import connected_components, materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct (rule, action), or null. A rule fits its host and all subdomains."""
    every = F.array(*[
        F.struct(F.lit(len(name + start)).alias("size"), F.lit(name + start).alias("rule"), F.lit(action).alias("action"),
                 F.lit(name).alias("name"), F.lit("." + name).alias("below"), F.lit(start).alias("start"))
        for action, name, start in rules])
    return F.array_max(F.filter(every, lambda r: ((host == r["name"]) | host.endswith(r["below"])) & path.startswith(r["start"])))


def with_normal_url(df: DataFrame, source: str, name: str) -> DataFrame:
    """Adds the form in which urls are compared: host lower-cased, no fragment; null without ://.

    In steps, so that no long expression is repeated inside another.
    """
    plain = df.withColumn(name, F.regexp_replace(F.trim(source), r"(?s)#.*$", ""))
    head = plain.withColumn("head_of_url", F.regexp_extract(name, r"(?s)^(.*?://[^/?]*)", 1))
    whole = F.concat(F.translate("head_of_url", UPPER, LOWER), F.substring(name, F.length("head_of_url") + 1, F.length(name)))
    return head.withColumn(name, F.when(F.contains(name, F.lit("://")), whole)).drop("head_of_url")


def with_absolute(df: DataFrame, base: str, link: str, name: str) -> DataFrame:
    """Adds a page's link as an absolute url."""
    parts = df.withColumns({
        "scheme_": F.regexp_extract(base, r"(?s)^(.*?:)//", 1), "site_": F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1),
        "folder_": F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)", 1)})
    at = F.col(link)
    folder = F.when(F.col("folder_").endswith("/"), F.col("folder_")).otherwise(F.concat("folder_", F.lit("/")))
    return parts.withColumn(name, F.when(at.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), at).when(at.startswith("//"), F.concat("scheme_", link))
                            .when(at.startswith("/"), F.concat("site_", link)).otherwise(F.concat(folder, at))).drop("scheme_", "site_", "folder_")


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): a page's url and what its canonical link or refresh redirect points to."""
    held = pages.filter(F.col("html").rlike(r"(?i)<(?:link|meta)\b[^>]*(?:canonical|refresh)")).filter(F.col("url").isNotNull())
    tags = held.select("url", F.explode(F.expr(r"regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>', 0)")).alias("tag"))
    quoted = r"""\s*=\s*["']?\s*([^"'>\s]+)"""
    target = F.when(F.col("tag").rlike(r"""(?is)<link\b.*\brel\s*=\s*["']?[^"'>]*\bcanonical\b"""),
                    F.regexp_extract("tag", r"(?is)\bhref" + quoted, 1)).when(
        F.col("tag").rlike(r"""(?is)<meta\b.*\bhttp-equiv\s*=\s*["']?\s*refresh\b"""),
        F.regexp_extract("tag", r"""(?is)\burl\s*=\s*["']?\s*([^"'>\s]+)""", 1))
    links = tags.select("url", target.alias("target")).filter("target <> ''")
    ends = with_normal_url(with_normal_url(with_absolute(links, "url", "target", "whole"), "url", "a"), "whole", "b")
    # Written first: a filter would be pushed down, and repeat the expressions above for each of its terms.
    return materialise(ends.select("a", "b").distinct()).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, edges: DataFrame | None = None,
          default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict: one row for each page.

    ``edges`` (a, b) adds redirects known from elsewhere. Null urls, and those without ://, have empty
    host and path and take ``default``. Pages with one url share its verdict. Null html has no links.
    An empty table gives an empty result. Other columns are not read.
    """
    ties = alias_edges(pages)
    if edges is not None:
        known = with_normal_url(with_normal_url(edges.select(F.col("a").alias("x"), F.col("b").alias("y")), "x", "a"), "y", "b")
        ties = ties.unionByName(known.select("a", "b")).distinct()
    parts = connected_components(ties)
    action = match_rule(host_of(F.col("node")), path_of(F.col("node")), rules)["action"]
    blocked = (
        parts.withColumn("action", action).groupBy("component")
        .agg(F.bool_or(F.col("action") == "block").alias("block"), F.bool_or(F.col("action") == "allow").alias("allow"))
        .filter(F.col("block") & ~F.coalesce("allow", F.lit(False))).select("component")
    )
    aliases = materialise(parts.join(blocked, "component").select(F.col("node").alias("key"), F.lit("block").alias("alias")))
    own = with_normal_url(pages.select("page_id", F.col("url").alias("u")), "u", "key").select(
        "page_id", "key", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    ruled = own.withColumn("fit", match_rule(F.col("host"), F.col("path"), rules))
    return ruled.join(aliases, "key", "left").select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.action", "alias", F.lit(default)).alias("verdict"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP2_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    regexp_replace(trim(url), '(?s)#.*$', '') AS plain
  FROM pages),
n AS (SELECT *, CASE WHEN plain LIKE '%://%' THEN
    translate(regexp_extract(plain, '(?s)^(.*?://[^/?]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || substr(plain, length(regexp_extract(plain, '(?s)^(.*?://[^/?]*)', 1)) + 1) END AS key FROM p),
r(action, name, start) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
t AS (SELECT key AS a, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag, url FROM n WHERE html IS NOT NULL AND key IS NOT NULL),
g AS (SELECT a, url, CASE WHEN regexp_matches(tag, '(?is)<link\b.*\brel\s*=\s*["'']?[^"''>]*\bcanonical\b') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?\s*([^"''>\s]+)', 1)
    WHEN regexp_matches(tag, '(?is)<meta\b.*\bhttp-equiv\s*=\s*["'']?\s*refresh\b') THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?\s*([^"''>\s]+)', 1) END AS target FROM t),
f AS (SELECT a, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target
    WHEN target LIKE '//%' THEN regexp_extract(url, '(?s)^(.*?:)//', 1) || target
    WHEN target LIKE '/%' THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || target
    ELSE rtrim(regexp_extract(url, '(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)', 1), '/') || '/' || target END AS b FROM g WHERE target <> ''),
e AS (SELECT a, regexp_replace(b, '(?s)#.*$', '') AS b FROM f),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(src, dst) AS (SELECT a, b FROM both_ways UNION SELECT reach.src, both_ways.b FROM reach JOIN both_ways ON reach.dst = both_ways.a),
urls AS (SELECT DISTINCT dst AS key, translate(regexp_extract(dst, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(dst, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM reach),
fit AS (SELECT key, arg_max(action, length(name || start)) AS action FROM urls JOIN r
    ON (host = name OR host LIKE '%.' || name) AND starts_with(path, start) GROUP BY key),
alias AS (SELECT src AS key FROM reach JOIN fit ON reach.dst = fit.key GROUP BY src
    HAVING bool_or(action = 'block') AND NOT bool_or(action = 'allow')),
own AS (SELECT page_id, arg_max(action, length(name || start)) AS action, arg_max(name || start, length(name || start)) AS rule
    FROM n JOIN r ON (host = name OR host LIKE '%.' || name) AND starts_with(path, start) GROUP BY page_id)
SELECT n.page_id, n.host, n.path, own.rule,
  coalesce(own.action, CASE WHEN alias.key IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM n LEFT JOIN own ON own.page_id = n.page_id LEFT JOIN alias ON alias.key = n.key
"""
