"""URL filters with redirect equivalence: block decisions spread over aliases, an explicit allow goes first.

Aliases are urls joined by redirect edges (a table of the caller's, and ``<meta http-equiv=refresh>``
in the html) and canonical-link edges (``<link rel=canonical>``), all that a page has. Their targets are resolved
against the page's own url (``<base>`` is not read). A node is a url without its
fragment, host in lower case; connected components of these edges are formed by joins. A url's own
rule decides first (the longest that fits). Else its component does: allow if any of its urls has an
allow rule, block if any has a block rule, allow otherwise.

A url that very many pages have, and all pages that ask no component, are dealt to several tasks by page_id.

DataFrame functions only. The rules are a short list of the caller's and become literals. Defined
cases: a null url or one without ``://`` has an empty host and path, no rule, no aliases and is
allowed; null html has no edges; html is read whole and in time that grows with its length (a tag ends at its first
``>``, one in which another ``<`` stands is none); links in comments and scripts are none, and an unclosed comment or
script goes on to the end; repeated pages are judged row by row; of rules of one length the later in (verdict, host, path) order decides; an
empty table or an empty rule list is fine; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.combine import spread_join
from sparkloom.operators.components import connected_components
from sparkloom.plans.storage import materialise

#: (verdict, host, path): a rule fits its host and all subdomains if the path starts with the rule's.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_VALUE = r"""[\s"']%s\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
_TAG = r"(?is)<(?:link|meta)\b[^<>]*>"
_UNSEEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script|\z)"
_REFRESH = r"""(?is)^<meta\b.*[\s"']http-equiv\s*=\s*["']?\s*refresh\b"""


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node(url: Column) -> Column:
    """A url's name in the graph; null without ``://``."""
    scheme = F.translate(F.substring_index(url, "://", 1), _UPPER, _LOWER)
    tail = F.regexp_extract(_rest(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(F.locate("://", url) > 0, F.concat(scheme, F.lit("://"), host(url), tail))


def _without_dots(p: Column) -> Column:
    """A path (and what follows it) with its . and .. segments taken out."""
    body = F.regexp_extract(p, r"^([^?#]*)", 1)
    parts = F.split(body, "/")
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.array_append(done, x))
    kept = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(body.contains("/."), F.concat(kept, F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise(""), F.substring(p, F.length(body) + F.lit(1), F.length(p)))).otherwise(p)


def resolve(target: Column, base: Column) -> Column:
    """A link's target as a whole url; null where it leads to no other page (fragments, mailto: and the like)."""
    t = F.regexp_replace(target, r"(?i)&(amp|#0*38|#x0*26);", "&")
    scheme = F.concat(F.substring_index(base, "://", 1), F.lit(":"))
    site = F.concat(scheme, F.lit("//"), host(base))
    folder = F.concat(F.lit("/"), F.regexp_extract(path(base), r"^/(.*/)?", 1))
    return (
        F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t)
        .when(t.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:|#|$)"), F.lit(None).cast("string"))
        .when(t.startswith("//"), F.concat(scheme, t))
        .when(t.startswith("/"), F.concat(site, _without_dots(t)))
        .when(t.startswith("?"), F.concat(site, path(base), t))
        .otherwise(F.concat(site, _without_dots(F.concat(folder, t))))
    )


def rule_of(h: Column, p: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits; nulls if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rh, rp in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest is asked first, as the outermost
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(rp)
        text, verdict = F.when(fits, rh + rp).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def link_target(tag: Column) -> Column:
    """What a canonical link or a refresh names, as written but for quotes; the empty text for any other tag."""
    rels = F.when(tag.rlike(r"(?i)^<link\b"), F.regexp_extract_all(tag, F.lit("(?is)" + _VALUE % "rel"), F.lit(1)))
    canonical = F.exists(rels, lambda rel: rel.rlike(r"(?i)\bcanonical\b"))
    refresh = F.regexp_extract(F.regexp_extract(tag, "(?is)" + _VALUE % "content", 1), r"(?is)\burl\s*=\s*(.*)$", 1)
    found = F.when(canonical, F.regexp_extract(tag, "(?is)" + _VALUE % "href", 1)).when(tag.rlike(_REFRESH), refresh).otherwise("")
    return F.regexp_replace(found, r"""^[\s"']+|[\s"']+$""", "")


def alias_edges(pages: DataFrame) -> DataFrame:
    """Edges (u, v) between nodes: a page and its canonical links and refresh targets."""
    html = F.coalesce("html", F.lit(""))
    marked = pages.where(html.rlike(r"(?i)canonical|refresh") & (F.locate("://", F.col("url")) > 0))
    seen = F.regexp_replace(html, _UNSEEN, "")
    tags = marked.select("url", F.explode(F.regexp_extract_all(seen, F.lit(_TAG), F.lit(0))).alias("tag"))
    linked = tags.select("url", link_target(F.col("tag")).alias("t"))
    return linked.select(node(F.col("url")).alias("u"), node(resolve(F.col("t"), F.col("url"))).alias("v")).where("v is not null")


def url_filters(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages; redirects: a table (source, target) of urls."""
    url = F.col("url")
    edges = alias_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(node(F.col("source")).alias("u"), node(F.col("target")).alias("v")))
    edges = materialise(edges, "aliases")  # html is read for links once
    groups = materialise(connected_components(edges), "groups", instead_of=(edges,))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    inside = groups.withColumn("host", host(F.col("node"))).withColumn("path", path(F.col("node"))).withColumn("own", verdict)
    said = inside.groupBy("component").agg(F.max(F.col("own") == "allow").alias("any_allow"), F.max(F.col("own") == "block").alias("any_block"))
    said = said.withColumn("spread", F.when(F.col("any_allow"), "allow").when(F.col("any_block"), "block")).where("spread is not null").select("component", "spread")
    by_node = materialise(spread_join(groups, said, ["component"], by="node").select("node", "spread"), "verdicts", instead_of=(groups,))
    judged = pages.select("page_id", url, host(url).alias("host"), path(url).alias("path")).withColumn("rule", text).withColumn("own", verdict)
    # only pages without a rule of their own ask their component; all others have no key and are dealt evenly
    asking = judged.select("page_id", "host", "path", "rule", "own", F.when(F.col("own").isNull(), node(url)).alias("node"))
    joined = spread_join(asking, by_node, ["node"], by="page_id", how="left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("own", "spread", F.lit("allow")).alias("verdict"))
