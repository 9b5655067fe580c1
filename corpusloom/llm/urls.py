"""URL filters with redirect equivalence (operator 5).

Rules (host, path) say allow or block. A page's own rule decides: the longest that fits its host,
or a parent domain, and the beginning of its path. Other pages take their verdict from the pages
that they are the same as: a url's canonical key (no scheme, www., m., fragment, tracking
parameters, .html or closing slash), the canonical link and the refresh target in its html, and
given redirects are edges; within a connected component an explicit allow comes before a block,
and a block before the default, allow. Targets that are no pages of the table count with the rule
they would have. All of it is DataFrame operations.

Defined cases: a null url or one without :// has empty host and path, no rule, no edges, and the
default verdict. Of rules alike in length allow wins, then the first by name. Null or empty html
has no links; a link that is neither absolute nor begins with / or a letter says nothing. Repeated
rows stay. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .components import components

#: verdict, host, path
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that name a way in, not a page.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def own_rule(host_: Column, path_: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r))
    found = [F.when(((host_ == h) | host_.endswith("." + h)) & path_.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in ordered]
    return F.coalesce(*found) if found else F.lit(None).cast("struct<rule:string,verdict:string>")


def with_rule(rows: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """rows (host, path) with _own, the rule that decides.

    A few rules are a list and are matched row by row. Any number of them is a table (verdict, host,
    path): each host and its parent domains are joined to it, and the longest match is an aggregate.
    """
    if not isinstance(rules, DataFrame):
        return rows.withColumn("_own", own_rule(F.col("host"), F.col("path"), rules))
    parts = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    # pages of one host and path are asked for once
    asked = rows.where("host <> ''").select("host", "path").distinct().select("host", "path", F.explode(ends).alias("_end"))
    named = rules.select("verdict", F.col("host").alias("_end"), F.col("path").alias("_begin"))
    hits = asked.join(named, "_end").where(F.col("path").startswith(F.col("_begin")))
    # of equal lengths allow comes first, then the first by name
    rank = F.struct((-F.length(F.concat("_end", "_begin"))).alias("n"), (F.col("verdict") != "allow").alias("b"), F.col("_end").alias("e"), F.col("_begin").alias("p"), F.struct(F.concat("_end", "_begin").alias("rule"), "verdict").alias("own"))
    best = hits.groupBy("host", "path").agg(F.min(rank).alias("_best"))
    return rows.join(best, ["host", "path"], "left").withColumn("_own", F.col("_best.own")).drop("_best")


def alias_key(url: Column) -> Column:
    """What all spellings of a page's url have in common; null for a null url or one without ://."""
    rest = F.regexp_replace(F.regexp_extract(url, "://[^/?#]*[^?#]*\\??([^#]*)", 1), f"(^|&)(?:{TRACKING})=[^&]*", "")
    rest = F.regexp_replace(rest, "^&", "")
    short_host = F.regexp_replace(host(url), "^(?:www|m)\\.", "")
    short_path = F.regexp_replace(F.regexp_replace(path(url), "/+$", ""), "\\.html?$", "")
    key = F.concat(short_host, short_path, F.when(rest != "", F.concat(F.lit("?"), rest)).otherwise(F.lit("")))
    return F.when(F.contains(url, F.lit("://")), key)


def _resolved(link: Column, base: Column) -> Column:
    """An absolute url for a link on a page."""
    link = F.trim(link)
    root = F.regexp_extract(base, "^([^:]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, "^([^:]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(link.startswith("//"), F.concat(F.regexp_extract(base, "^([^:]*:)", 1), link)).when(link.startswith("/"), F.concat(root, link)).when(link.rlike("^[A-Za-z0-9]"), F.concat(folder, F.when(folder.endswith("/"), F.lit("")).otherwise(F.lit("/")), link))


def html_links(url: Column, html: Column) -> Column:
    """Absolute urls of the canonical link and the refresh target, as an array."""
    quoted = "\\s*=\\s*[\"']?"
    canonical = F.regexp_extract(html, f"(?i)<link\\b(?=[^>]*\\brel{quoted}canonical)[^>]*\\bhref{quoted}([^\"'>\\s]+)", 1)
    refresh = F.regexp_extract(html, f"(?i)<meta\\b(?=[^>]*\\bhttp-equiv{quoted}refresh)[^>]*\\bcontent{quoted}[^\"'>]*?url\\s*=\\s*([^\"'>\\s]+)", 1)
    return F.filter(F.array(_resolved(canonical, url), _resolved(refresh, url)), lambda x: x.isNotNull())


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """pages (page_id, url, html) with host, path, rule, verdict and decided_by (rule, alias or default); html goes.

    rules: a list, or a table of any length. redirects: further edges, source and target urls.
    """
    rows = pages.select("page_id", "url", html_links(F.col("url"), F.coalesce("html", F.lit(""))).alias("_links"))
    rows = with_rule(rows.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), alias_key(F.col("url")).alias("_key"), "_links"), rules)
    rows = written(rows, "urls")
    edges = rows.select(F.col("_key").alias("a"), F.explode("_links").alias("url"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(alias_key(F.col("source")).alias("a"), F.col("target").alias("url")))
        ends = redirects.select(F.explode(F.array("source", "target")).alias("url"))
    edges = edges.select("a", "url", alias_key(F.col("url")).alias("b"))
    targets = edges.select("url") if redirects is None else edges.select("url").unionByName(ends)
    targets = with_rule(targets.select(alias_key(F.col("url")).alias("_key"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path")), rules).select("_key", "_own")
    known = rows.select("_key", "_own").unionByName(targets).where(F.col("_key").isNotNull())
    # what the spellings of one key say, combined before the shuffle
    keys = known.groupBy("_key").agg(F.max((F.col("_own.verdict") == "allow").cast("int")).alias("_allow"), F.max((F.col("_own.verdict") == "block").cast("int")).alias("_block"))
    linked = components(edges, "a", "b", "url-links")
    keys = keys.join(linked, keys["_key"] == linked["node"], "left").select("_key", "_allow", "_block", F.coalesce("component", "_key").alias("_root"))
    roots = keys.groupBy("_root").agg(F.max("_allow").alias("_any_allow"), F.max("_block").alias("_any_block")).where("_any_allow = 1 or _any_block = 1")
    said = keys.join(roots, "_root").select("_key", F.when(F.col("_any_allow") == 1, "allow").otherwise("block").alias("_said"))
    # rows without a key have no alias: they are not shuffled to one task
    keyless = rows.where(F.col("_key").isNull()).withColumn("_said", F.lit(None).cast("string"))
    out = rows.where(F.col("_key").isNotNull()).join(said, "_key", "left").unionByName(keyless)
    verdict = F.coalesce("_own.verdict", "_said", F.lit("allow"))
    by = F.when(F.col("_own").isNotNull(), "rule").when(F.col("_said").isNotNull(), "alias").otherwise("default")
    return out.select("page_id", "url", "host", "path", F.col("_own.rule").alias("rule"), verdict.alias("verdict"), by.alias("decided_by"), F.col("_key").alias("alias_key"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    return judged(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("url", "alias_key")
