"""URL filtering with redirect equivalence.

Rules are (host, path, verdict); a rule fits its host and all subdomains where
the URL's path starts with the rule's, and the longest rule that fits decides.
For other URLs the redirects and canonical links found in the pages decide:
URLs joined by such links, directly or by a chain, are aliases of one another.
A block by a rule on any alias blocks every alias without a rule of its own; an
explicit allow of a URL's own rule stands against any block that reaches it.
What no block reaches is allowed.

Links are the page's <link rel=canonical>, its refresh <meta>, and, where
given, further edges (from_url, to_url) as of a crawl's redirect log.  A node is
a URL without fragment, scheme and host in lower case, so that URLs which
differ in nothing else are one node; relative targets are resolved against the
page's URL.  A URL without '://' has neither host nor path, fits no rule, has
no aliases, and is allowed.  Null html has no links.  Repeated rows are judged
each for themselves, an empty table gives an empty one, and further columns are
not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.llm.shared import connected_components, materialise

#: The rules of the query.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return _lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null.  Of
    equally long ones an allow goes first, then the lesser in code points."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "allow", r[0] + r[1]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for h, p, _ in ordered]
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for fit, (h, p, v) in reversed(list(zip(fits, ordered, strict=True))):
        out = F.when(fit, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))).otherwise(out)
    return out


def without_dots(path: Column) -> Column:
    """A path without its `.` and `..` segments."""

    def step(kept: Column, part: Column) -> Column:
        up = F.when(F.size(kept) > 1, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)
        return F.when(part == ".", kept).when(part == "..", up).otherwise(F.concat(kept, F.array(part)))

    # A last segment of dots is a folder.
    parts = F.split(F.regexp_replace(path, r"(?s)(/\.\.?)$", "$1/"), "/")
    return F.when(path.rlike(r"(?s)/\.\.?(?:/|$)"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")).otherwise(path)


def node_of(url: Column) -> Column:
    """The URL, with no fragment and no dot segments, as a node of the link graph; null without '://'."""
    plain = F.regexp_replace(url, r"(?s)#.*$", "")
    scheme = F.regexp_extract(plain, r"(?s)^(.*?://)", 1)
    query = F.regexp_extract(plain, r"(?s)^.*?://[^/?#]*[^?]*(.*)$", 1)
    return F.when(scheme != "", F.concat(_lower(scheme), host_of(plain), without_dots(path_of(plain)), query))


def resolve(base: Column, target: Column) -> Column:
    """A link target against the URL of its page; null for one of another kind than `//`, as mailto:."""
    page = F.regexp_extract(base, r"(?s)^([^?#]*)", 1)
    scheme = F.regexp_extract(base, r"(?s)^(.*?:)//", 1)
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(target.startswith("?") | target.startswith("#"), F.concat(page, target))
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(target.startswith("/"), F.concat(origin, target))
        .when(target == "", F.lit(None))
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), target))
    )


#: Comments, scripts and styles, in which nothing is a tag.
UNSEEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(from_url, to_url): the canonical link and the refresh target of each page."""
    html = F.regexp_replace(html_col, UNSEEN, " ")
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    tag = F.explode(F.filter(tags, lambda t: t.rlike(r"(?i)canonical|refresh")))
    found = pages.where(F.col(html_col).rlike(r"(?i)canonical|http-equiv")).select(F.col(url_col).alias("from_url"), tag.alias("tag"))
    canonical = F.when(
        F.col("tag").rlike(r"(?is)^<link\b.*\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"),
        F.regexp_extract("tag", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1),
    )
    refresh = F.when(
        F.col("tag").rlike(r"(?is)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?refresh"),
        F.regexp_extract("tag", r"(?is)\bcontent\s*=\s*[\"']?\s*[\d.]*\s*[;,]\s*url\s*=\s*[\"']?([^\"'\s>]+)", 1),
    )
    target = F.regexp_replace(F.coalesce(canonical, refresh), "&amp;", "&")
    return found.select("from_url", resolve(F.col("from_url"), target).alias("to_url")).where("to_url IS NOT NULL")


def judge(pages: DataFrame, *, rules: tuple[tuple[str, str, str], ...] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page.

    Only URLs without a rule of their own look at their component, and only
    blocked components are kept for that: the table joined to the pages has a
    row for each alias of a blocked URL.
    """
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("from_url", "to_url"))
    links = materialise(links, "links")
    edges = links.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b"))
    found = connected_components(edges).select("node", "component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
    own = rule_of(F.col("host"), F.col("path"), rules)
    members = materialise(found.select("node", "component", own["verdict"].eqNullSafe("block").alias("blocked")), "aliases")
    judged = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node")
    ).withColumn("own", own)
    blocked = members.where("blocked").select("component").distinct()
    aliases = members.join(blocked, "component", "left_semi").select(F.col("node").alias("alias"))
    out = judged.join(aliases, F.col("node") == F.col("alias"), "left")
    verdict = F.coalesce("own.verdict", F.when(F.col("alias").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql_lower(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _sql_host(url: str) -> str:
    return _sql_lower(f"coalesce(regexp_extract({url}, '^.*?://([^/?#]*)', 1, 's'), '')")


def _sql_path(url: str) -> str:
    return f"coalesce(regexp_extract({url}, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '')"


def _sql_node(url: str) -> str:
    scheme = f"regexp_extract({url}, '^([^#]*?://)', 1, 's')"
    path, query = _sql_path(url), f"regexp_extract({url}, '^.*?://[^/?#]*[^?#]*([^#]*)', 1, 's')"
    parts = f"list_transform(string_split(regexp_replace({path}, '(/\\.\\.?)$', '\\1/', 's'), '/'), lambda p: [p])"
    step = "lambda kept, part: CASE WHEN part[1] = '.' THEN kept WHEN part[1] = '..' THEN CASE WHEN len(kept) > 1 THEN kept[1:len(kept) - 1] ELSE kept END ELSE list_concat(kept, part) END"
    plain = f"CASE WHEN regexp_matches({path}, '/\\.\\.?(?:/|$)', 's') THEN array_to_string(list_reduce({parts}, {step}), '/') ELSE {path} END"
    return f"CASE WHEN {scheme} <> '' THEN {_sql_lower(scheme)} || {_sql_host(url)} || {plain} || {query} END"


def _sql_fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR host LIKE '%.{host}') AND path LIKE '{path}%')"


_SQL_RULE, _SQL_VERDICT = (
    "CASE "
    + " ".join(f"WHEN {_sql_fits(h, p)} THEN '{v if verdict else h + p}'" for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
    + " END"
    for verdict in (False, True)
)
#: The pages' links come from html by the same patterns; chains by a recursive union.
OP7_SQL = rf"""
WITH RECURSIVE parts AS (
  SELECT page_id, url, html, {_sql_host("url")} AS host, {_sql_path("url")} AS path, {_sql_node("url")} AS node FROM pages
), tags AS (
  SELECT url, unnest(regexp_extract_all(regexp_replace(html, '{UNSEEN.replace("(?is)", "")}', ' ', 'gis'), '<(?:link|meta)\b[^>]*>', 0, 'is')) AS tag FROM pages
), targets AS (
  SELECT url, replace(CASE
    WHEN regexp_matches(tag, '^<link\b.*\brel\s*=\s*["'']?[^"''>]*\bcanonical\b', 'is') THEN regexp_extract(tag, '\bhref\s*=\s*["'']?([^"''\s>]+)', 1, 'is')
    WHEN regexp_matches(tag, '^<meta\b.*\bhttp-equiv\s*=\s*["'']?refresh', 'is')
      THEN regexp_extract(tag, '\bcontent\s*=\s*["'']?\s*[\d.]*\s*[;,]\s*url\s*=\s*["'']?([^"''\s>]+)', 1, 'is') END, '&amp;', '&') AS target,
    regexp_extract(url, '^(.*?:)//', 1, 's') AS scheme, regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') AS origin,
    regexp_extract(url, '^(.*?://[^/?#]*(?:/[^?#]*/|/)?)', 1, 's') AS folder
  FROM tags
), links AS (
  SELECT url, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(target, '?') OR starts_with(target, '#') THEN regexp_extract(url, '^([^?#]*)', 1, 's') || target WHEN starts_with(target, '//') THEN scheme || target WHEN starts_with(target, '/') THEN origin || target
    WHEN target <> '' THEN folder || CASE WHEN ends_with(folder, '/') THEN '' ELSE '/' END || target END AS link
  FROM targets
), pairs AS (
  SELECT {_sql_node("url")} AS a, {_sql_node("link")} AS b FROM links
), edges AS (
  SELECT a, b FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL
), nodes AS (
  SELECT node, {_sql_host("node")} AS host, {_sql_path("node")} AS path FROM (SELECT DISTINCT a AS node FROM edges)
), reached AS (
  SELECT node FROM nodes WHERE {_SQL_VERDICT} = 'block'
  UNION
  SELECT e.b FROM reached r JOIN edges e ON r.node = e.a
)
SELECT page_id, host, path, {_SQL_RULE} AS rule,
  coalesce({_SQL_VERDICT}, CASE WHEN node IN (SELECT node FROM reached) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts
"""
