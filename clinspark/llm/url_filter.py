"""URL rules by host and path prefix, and their spread over redirect and canonical-link edges.

Every page's own rule comes first. Pages without one take the decision of their alias class, the connected component of
their URL over redirects (meta refresh) and canonical links: an explicit allow in the class wins, then a block, else the
page is allowed. Rules match exactly by host suffix and path prefix, the longest one first.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinspark.llm.common import written
from clinspark.llm.components import connected_components


class Rule(NamedTuple):
    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values of op10's contract.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without one."""
    return F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, as struct<name, action>, or null; of equally long ones an allow, then the first."""
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.action != "allow"))
    out = F.lit(None).cast("struct<name:string,action:string>")
    for r in reversed(ranked):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.action).alias("action"))).otherwise(out)
    return out


def folded(path: Column) -> Column:
    """A path with its dot segments folded, a slash for an empty one."""
    step = lambda a, x: F.when(x == "..", F.regexp_replace(a, "/[^/]*\\z", "")).when(x == ".", a).otherwise(F.concat(a, F.lit("/"), x))
    walked = F.aggregate(F.split(F.substr(path, F.lit(2)), "/"), F.lit(""), step)
    slash = F.when(path.rlike("/\\.\\.?\\z"), "/").otherwise("")
    return F.when(path == "", "/").when(F.contains(path, F.lit("/.")), F.concat(walked, slash)).otherwise(path)


def node_of(url: Column) -> Column:
    """The name under which a URL takes part in edges: no scheme, no fragment, host in lower case, dot segments folded. Empty without host."""
    query = F.regexp_extract(url, "(?s)^.*?://[^/?#]*[^?#]*([^#]*)", 1)
    return F.when(url.rlike("(?s)^.*?://[^/?#]"), F.concat(host_of(url), folded(path_of(url)), query)).otherwise("")


def resolve(base: Column, link: Column) -> Column:
    """The absolute URL of a link on a page: absolute (a scheme at its very start), scheme-relative, root-relative, query, or relative to the folder.

    Links of schemes without a host (``mailto:``), to a fragment alone and empty ones lead nowhere: empty.
    """
    origin = F.regexp_extract(base, "(?s)^.*?://[^/?#]*", 0)
    return (
        F.when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.lit("http:"), link))
        .when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:|^#"), "")
        .when(F.startswith(link, F.lit("/")), F.concat(origin, link))
        .when(F.startswith(link, F.lit("?")), F.concat(origin, path_of(base), link))
        .when(F.length(link) > 0, F.concat(origin, F.when(F.contains(path_of(base), F.lit("/")), F.regexp_replace(path_of(base), "[^/]*\\z", "")).otherwise("/"), link))
        .otherwise("")
    )


_TAG = "(?is)<(?:link|meta)\\b[^>]*>"
_COMMENT = "(?s)<!--.*?(?:-->|\\z)"
_AMPERSAND = "(?i)&(?:amp|#38|#x26);"


def targets(html: Column) -> Column:
    """Links of canonical ``link`` tags and of refreshing ``meta`` tags, in the order of the page; none from comments."""
    tags = F.when(html.rlike("(?i)canonical|http-equiv"), F.regexp_extract_all(F.regexp_replace(html, _COMMENT, ""), F.lit(_TAG), F.lit(0)))

    def link(tag: Column) -> Column:
        href = F.regexp_extract(tag, "(?is)\\bhref\\s*=\\s*[\"']?([^\"'\\s>]*)", 1)
        url = F.regexp_extract(tag, "(?is)\\bcontent\\s*=\\s*[\"']?[^\"'>]*?\\burl\\s*=\\s*[\"']?([^\"'\\s>]*)", 1)
        return (
            F.when(tag.rlike("(?is)^<link\\b.*\\brel\\s*=\\s*[\"']?canonical\\b"), href)
            .when(tag.rlike("(?is)^<meta\\b.*\\bhttp-equiv\\s*=\\s*[\"']?refresh\\b"), url)
            .otherwise("")
        )

    return F.transform(F.filter(F.transform(tags, link), lambda x: x != ""), lambda x: F.regexp_replace(x, _AMPERSAND, "&"))


def edges_of(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """src, dst: 64-bit node hashes of the alias edges of all pages."""
    found = pages.select(F.col(url).alias("url"), F.explode(targets(F.col(html))).alias("link"))
    ends = found.select(node_of(F.col("url")).alias("from"), resolve(F.col("url"), F.trim("link")).alias("to")).select("from", node_of(F.col("to")).alias("to"))
    return _hashed(ends)


def _hashed(ends: DataFrame) -> DataFrame:
    return ends.where("`to` <> '' AND `from` <> ''").select(F.xxhash64("from").alias("src"), F.xxhash64("to").alias("dst"))


def judge(spark: SparkSession, pages: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "page_id", edges: DataFrame | None = None) -> DataFrame:
    """key, host, path, rule and verdict of every row of ``pages``; repeated rows are kept, other columns don't matter.

    A null URL, or one without ``://``, has an empty host and path, no rule and no aliases: it is allowed. A null or empty
    page has no links. Of rules that fit, the longest wins; of equally long ones an allow. Pages may be of any length.
    ``edges`` (src_url, dst_url) adds redirects that are known from elsewhere, such as a crawl log.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select(F.col(key).alias(key), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), F.xxhash64(node_of(F.col("url"))).alias("node"))
    rows = rows.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    links = edges_of(pages)
    if edges is not None:
        links = links.union(_hashed(edges.select(node_of(F.col("src_url")).alias("from"), node_of(F.col("dst_url")).alias("to"))))
    links, _ = written(spark, links, "alias-edges")
    classes, _ = written(spark, connected_components(spark, links), "alias-classes")
    # Only nodes of some edge have a class; their decisions meet there, pre-aggregated.
    ruled = rows.where("own IS NOT NULL AND host <> ''").groupBy("node").agg(F.max(F.col("own.action") == "allow").alias("allowed"), F.max(F.col("own.action") == "block").alias("blocked"))
    decided = classes.join(ruled, "node").groupBy("component").agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked"))
    spread = classes.join(decided, "component").select("node", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("spread"))
    out = rows.join(spread, "node", "left")
    verdict = F.coalesce(F.col("own.action"), F.when(F.col("host") != "", F.col("spread")), F.lit("allow"))
    return out.select(key, "host", "path", F.col("own.name").alias("rule"), verdict.alias("verdict"))


def op10(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    return judge(spark, pages)


_HOST = f"translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')"
_RULED = " ".join(
    f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}'" for r in sorted(RULES, key=lambda r: (-len(r.name), r.action != "allow"))
)
_ACTION = " ".join(f"WHEN '{r.name}' THEN '{r.action}'" for r in RULES)


def _fold(path: str) -> str:
    step = "CASE x WHEN '..' THEN regexp_replace(a, '/[^/]*$', '') WHEN '.' THEN a ELSE a || '/' || x END"
    walked = f"list_reduce(list_prepend('', string_split(substr({path}, 2), '/')), lambda a, x: {step})"
    return f"CASE WHEN {path} = '' THEN '/' WHEN contains({path}, '/.') THEN {walked} || CASE WHEN regexp_matches({path}, '/\\.\\.?$') THEN '/' ELSE '' END ELSE {path} END"


_PATH = "regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_NODE = f"{_HOST} || {_fold(_PATH)} || regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*([^#]*)', 1)"
_SCHEME = "^[a-zA-Z][a-zA-Z0-9+.-]*:"
#: The same rows, with the classes by a recursive query from every linked URL.
ORACLE = f"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, coalesce({_HOST}, '') AS host, coalesce({_PATH}, '') AS path,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*', 0), '') AS origin,
         CASE WHEN {_HOST} <> '' THEN {_NODE} ELSE '' END AS node FROM pages
), ruled AS (SELECT *, CASE {_RULED} END AS rule FROM p),
judged AS (SELECT *, CASE rule {_ACTION} END AS own FROM ruled),
tags AS (SELECT node, origin, path, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?(?:-->|\\z)', '', 'g'), '(?is)<(?:link|meta)\\b[^>]*>')) AS tag FROM p WHERE regexp_matches(html, '(?i)canonical|http-equiv')),
links AS (
  SELECT node, origin, path, regexp_replace(trim(CASE WHEN regexp_matches(tag, '(?is)^<link\\b.*\\brel\\s*=\\s*["'']?canonical\\b') THEN regexp_extract(tag, '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]*)', 1)
    WHEN regexp_matches(tag, '(?is)^<meta\\b.*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b') THEN regexp_extract(tag, '(?is)\\bcontent\\s*=\\s*["'']?[^"''>]*?\\burl\\s*=\\s*["'']?([^"''\\s>]*)', 1) END), '(?i)&(?:amp|#38|#x26);', '&', 'g') AS link FROM tags
), absolute AS (
  SELECT node, CASE WHEN regexp_matches(link, '{_SCHEME}//') THEN link WHEN starts_with(link, '//') THEN 'http:' || link WHEN regexp_matches(link, '{_SCHEME}|^#') THEN '' WHEN starts_with(link, '/') THEN origin || link
    WHEN starts_with(link, '?') THEN origin || path || link ELSE origin || CASE WHEN contains(path, '/') THEN regexp_replace(path, '[^/]*$', '') ELSE '/' END || link END AS url FROM links WHERE link <> ''
), edges AS (
  SELECT DISTINCT node AS a, {_NODE} AS b FROM absolute WHERE node <> '' AND {_HOST} <> ''
), ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (SELECT a, a FROM ways UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a),
spread AS (SELECT r.a AS node, bool_or(j.own = 'allow') AS allowed, bool_or(j.own = 'block') AS blocked FROM reach r JOIN judged j ON j.node = r.b WHERE j.own IS NOT NULL GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN host <> '' THEN CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' END END, 'allow') AS verdict
FROM judged LEFT JOIN spread USING (node)
"""
