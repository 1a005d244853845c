"""URL filters with redirect equivalence, in DataFrame operations only.

Rules are joined on host suffixes. Redirects and canonical links make URLs aliases of one another; block
decisions spread over connected components of aliases, and an allowed alias takes precedence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import written
from themeloom.llm.components import components

_AFTER = "(?s)^.*?://"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://`` or for null."""
    host = F.regexp_extract(url, _AFTER + "([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, _AFTER + "[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, action) of each distinct host and path of ``urls`` that a rule fits; the longest rule wins.

    ``rules`` has host, path, action. A rule fits its host and all subdomains if the path starts with its
    path. Length is that of host and path together; of equally long rules a block wins, then the first in
    code-point order. Every host is looked up by each of its suffixes, so the work doesn't grow with the
    number of rules, and repeated URLs are looked up once.
    """
    distinct = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    looked_up = distinct.withColumn("_suffix", F.explode(suffix))
    named = rules.select(F.col("host").alias("_suffix"), F.col("path").alias("_start"), "action")
    met = looked_up.join(named, "_suffix").filter(F.startswith("path", "_start"))
    rule = F.concat("_suffix", "_start")
    best = F.max_by(F.struct(rule.alias("rule"), "action"), F.struct(F.length(rule), F.col("action") == "block", F.hash(rule)))
    return met.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.*")


def resolved(target: Column, base: Column) -> Column:
    """The absolute URL that ``target`` means in a page at ``base``; null for fragments, other schemes and without a base.

    ``&amp;`` is read as ``&``. A target without a host is taken against the base's scheme, host or folder; dot
    segments stay as written.
    """
    target = F.replace(target, F.lit("&amp;"), F.lit("&"))
    site = F.regexp_extract(base, r"(?s)^([^:/?#]+://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"(?s)^([^?#]*)", 1)
    folder = F.concat(site, F.regexp_extract(F.substr(page, F.length(site) + 1), r"(?s)^(.*/|)", 1))
    folder = F.when(folder == site, F.concat(site, F.lit("/"))).otherwise(folder)
    within = (
        F.when(F.startswith(target, F.lit("//")), F.concat(F.substring_index(base, "://", 1), F.lit(":"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(site, target))
        .when(F.startswith(target, F.lit("?")), F.concat(page, target))
        .otherwise(F.concat(folder, target))
    )
    return (
        F.when(F.contains(target, F.lit("://")), target)
        .when((target == "") | F.startswith(target, F.lit("#")) | F.regexp_like(target, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), F.lit(None))
        .when(site != "", within)
    )


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): a page's URL and the URL it redirects to (meta refresh) or names as canonical, relative ones resolved."""
    tag = lambda name: rf"(?is)<{name}\b[^>]*>"
    links = F.filter(F.regexp_extract_all(html, F.lit(tag("link")), F.lit(0)), lambda t: F.regexp_like(t, F.lit(r"""(?is)\brel\s*=\s*["']?canonical\b""")))
    metas = F.filter(F.regexp_extract_all(html, F.lit(tag("meta")), F.lit(0)), lambda t: F.regexp_like(t, F.lit(r"""(?is)\bhttp-equiv\s*=\s*["']?refresh\b""")))
    canonical = F.transform(links, lambda t: F.regexp_extract(t, r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", 1))
    redirect = F.transform(metas, lambda t: F.regexp_extract(t, r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)""", 1))
    likely = pages.filter(F.regexp_like(html, F.lit("(?i)canonical|refresh")))
    found = likely.select(F.col(url).alias("a"), F.explode(F.concat(canonical, redirect)).alias("_target"))
    return found.select("a", resolved(F.col("_target"), F.col("a")).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")


def judge(pages: DataFrame, rules: DataFrame, edges: DataFrame, url: str = "url") -> DataFrame:
    """Add host, path, rule (null if none fits) and verdict to ``pages``.

    The verdict is the rule's action. Where no rule fits it is block if an alias, over any number of
    ``edges`` (a, b), is blocked and none is allowed; else allow. Null URLs have an empty host and path and
    no aliases. Columns host, path, rule and verdict are replaced.
    """
    rows = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    edges = written(edges.select("a", "b").distinct())
    known = rows.select(F.col(url).alias("_url"), "host", "path")
    linked = edges.select(F.col("a").alias("_url")).unionByName(edges.select(F.col("b").alias("_url"))).distinct()
    linked = linked.withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))})
    matched = written(match_rules(known.select("host", "path").unionByName(linked.select("host", "path")), rules))
    actions = linked.join(matched, ["host", "path"]).select(F.col("_url").alias("node"), "action")
    members = written(components(edges))
    spread = members.join(actions, "node").groupBy("root").agg(F.bool_or(F.col("action") == "allow").alias("_allowed"))
    aliases = members.join(spread.filter(~F.col("_allowed")).select("root"), "root").select(F.col("node").alias(url)).distinct().withColumn("_alias", F.lit(True))
    judged = rows.join(matched.withColumnRenamed("action", "_action"), ["host", "path"], "left").join(aliases, url, "left")
    verdict = F.when(F.col("_action").isNotNull(), F.col("_action")).when(F.col("_alias"), "block").otherwise("allow")
    return judged.withColumn("verdict", verdict).drop("_action", "_alias")
