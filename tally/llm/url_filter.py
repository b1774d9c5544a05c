"""URL filters with redirect equivalence.

Rules block or allow a host (with all its subdomains) below a path.  A page
whose own URL has no rule takes the decision of its aliases: URLs tied to it
by canonical links and redirects.  Aliases are the connected components of
those edges, computed by distributed union-find; a component is blocked when
one of its URLs is blocked by a rule and none is allowed by one.  A URL's own
rule always comes first, and among a component's rules an explicit allow
takes precedence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty
from .components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str]  # (verdict, "host/path")


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """A URL as a graph node: host, path (``/`` if none) and query, without scheme and
    fragment.  NULL without ``://``."""
    tail = F.regexp_extract(_rest(url), "^[^/?#]*([^#]*)", 1)
    tail = F.when(tail.startswith("/"), tail).otherwise(F.concat(F.lit("/"), tail))
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), tail))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits (allow before block at equal length) and its verdict; else NULLs."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "allow")):
        name, _, below = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + below)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _attribute(tag: Column, name: str) -> Column:
    pattern = r"(?is)\b%s\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))" % name
    found = F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])
    return F.trim(F.replace(found, F.lit("&amp;"), F.lit("&")))


def _resolve(url: Column, ref: Column) -> Column:
    """An absolute URL for a link found on the page ``url`` (dot segments are kept)."""
    site = F.concat(F.lit("x://"), host_of(url))
    folder = F.regexp_replace(path_of(url), "[^/]*$", "")
    return (F.when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), ref)
            .when(ref.startswith("//"), F.concat(F.lit("x:"), ref))
            .when((F.instr(url, "://") == 0) | (ref == "") | ref.startswith("#")
                  | ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
            .when(ref.startswith("/"), F.concat(site, ref))
            .when(ref.startswith("?"), F.concat(site, path_of(url), ref))
            .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), ref)))


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(src, dst)`` nodes of canonical links and meta redirects, read from the pages' markup
    (comments and scripts aside)."""
    source = pages.select(F.col(f"`{url}`").alias("url"), text_or_empty(F.col(f"`{html}`")).alias("html"))
    marked = source.where(F.col("url").isNotNull() & F.col("html").rlike("(?i)canonical|refresh"))
    bare = F.regexp_replace("html", "(?is)<!--.*?-->|<script\\b.*?</script>", "")
    tags = marked.select("url", F.explode(F.regexp_extract_all(
        bare, F.lit("(?is)<(?:link|meta)\\b[^>]*>"), F.lit(0))).alias("tag"))
    read = tags.where(F.col("tag").rlike("(?i)canonical|refresh")).withColumns(
        {"rel": F.lower(_attribute(F.col("tag"), "rel")), "href": _attribute(F.col("tag"), "href"),
         "equiv": F.lower(_attribute(F.col("tag"), "http-equiv")), "content": _attribute(F.col("tag"), "content")})
    refs = read.withColumn("ref", F.when(
        F.col("tag").rlike("(?i)^<link") & F.col("rel").rlike(r"(^|\s)canonical($|\s)"), F.col("href")).when(
        F.col("tag").rlike("(?i)^<meta") & (F.col("equiv") == "refresh"),
        F.trim(F.regexp_extract("content", "(?is)url\\s*=\\s*['\"]?([^'\"]*)", 1)))).where("ref is not null")
    full = refs.withColumn("target", _resolve(F.col("url"), F.col("ref")))
    return (full.select(node_of(F.col("url")).alias("src"), node_of(F.col("target")).alias("dst"))
            .where("src is not null and dst is not null"))


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", html: str = "html",
          edges: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` are ``("block" | "allow", "host/path")`` pairs, compiled into the
    plan (a few thousand at most).  ``edges`` (``src``, ``dst`` URLs of a crawl's
    redirects) are added to those found in the pages.  NULL or malformed URLs
    have an empty host and path, fit no rule, have no aliases and are allowed;
    repeated pages are judged alike; URLs and pages are read whole, however long.
    Kept columns of the four names are replaced.  An empty table gives no rows.
    """
    cols = [c for c in (pages.columns if keep is None else keep) if c not in ("host", "path", "rule", "verdict")]
    graph = alias_edges(pages, url, html)
    if edges is not None:
        graph = graph.union(edges.select(node_of(F.col("src")), node_of(F.col("dst"))))
    comp = connected_components(graph)
    name = F.substring_index("node", "/", 1)
    _, own = rule_for(name, F.regexp_extract(F.substr("node", F.length(name) + 1), "^([^?#]*)", 1), rules)
    ruled = materialize(comp.withColumn("own", own), "url-rules")
    decided = ruled.groupBy("component").agg(
        F.max((F.col("own") == "allow").cast("int")).alias("a"), F.max((F.col("own") == "block").cast("int")).alias("b"))
    blocked = decided.where("b = 1 and coalesce(a, 0) = 0").select("component")
    aliases = ruled.join(blocked, "component").select(F.col("node").alias("__node"), F.lit("block").alias("__alias"))
    aliases = materialize(aliases, "url-aliases")
    u = F.col(f"`{url}`")
    rule, verdict = rule_for(F.col("__host"), F.col("__path"), rules)
    out = (pages.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(cols)], host_of(u).alias("__host"),
                        path_of(u).alias("__path"), node_of(u).alias("__url"))
           .withColumns({"__rule": rule, "__own": verdict}))
    if aliases.isEmpty():
        out = out.withColumn("__alias", F.lit(None).cast("string"))
    else:
        out = out.join(aliases, F.col("__url") == F.col("__node"), "left")
    return out.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(cols)], F.col("__host").alias("host"),
                      F.col("__path").alias("path"), F.col("__rule").alias("rule"),
                      F.coalesce("__own", "__alias", F.lit("allow")).alias("verdict"))
