"""URL rules whose block decisions reach aliases through redirects and canonical links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.components import connected_components

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"
#: Rules become one expression; a longer list belongs into a table.
MAX_RULES = 10_000


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))


def _lower(host: Column) -> Column:
    return F.translate(host, UPPER, UPPER.lower())


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return _lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """Host, path and query: one name for all schemes and fragments of an address. Null without ``://``."""
    rest = F.regexp_extract(_rest(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), rest))


def resolved(link: Column, host: Column, path: Column) -> Column:
    """A link's target as an absolute address: absolute, scheme-relative, rooted or relative links."""
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    folder = F.regexp_extract(path, r"^(.*/)?", 1)
    return (
        F.when(F.instr(link, "://") > 0, link)
        .when(link.startswith("//"), F.concat(F.lit("x:"), link))
        .when(link.startswith("/"), F.concat(F.lit("x://"), host, link))
        .otherwise(F.concat(F.lit("x://"), host, F.when(folder == "", "/").otherwise(folder), link))
    )


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct ``rule, verdict`` of the longest fitting rule, else null.

    A rule (host, path, verdict) fits its host and all subdomains if the path starts with
    the rule's. Among rules of one length the last by text counts.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    fits = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for h, p, v in rules
    ]
    return F.array_max(F.array(*fits))


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``node, alias`` for every canonical link and redirect in a page's markup."""
    u, h = F.col(url), F.col(html)

    def targets(tag: str, target: str) -> Column:
        tags = F.regexp_extract_all(h, F.lit(tag), F.lit(0))
        return F.transform(tags, lambda t: F.regexp_extract(t, target, 1))

    links = F.concat(targets(CANONICAL, HREF), targets(REFRESH, REFRESH_URL))
    found = pages.where(node_of(u).isNotNull() & h.isNotNull()).select(
        node_of(u).alias("node"), host_of(u).alias("host"), path_of(u).alias("path"), F.explode(links).alias("link")
    )
    return found.where(F.col("link") != "").select(
        "node", node_of(resolved(F.col("link"), F.col("host"), F.col("path"))).alias("alias")
    )


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    redirects: DataFrame | None = None,
    page_id: str = "page_id",
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages`` (page_id, url, html).

    A page with a fitting rule gets that rule's verdict. Any other page gets a verdict from
    its aliases, the pages and link targets that a chain of redirects and canonical links
    (in either direction) connects with it: ``allow`` if a rule allows one of them, else
    ``block`` if a rule blocks one, else ``allow``. ``redirects`` (src, dst addresses)
    adds edges from a crawl log.

    Null addresses or markup and addresses without ``://`` have no aliases, and empty host
    and path. Repeated rows are judged each. All steps are joins and aggregates: decisions
    are combined per component before they are joined to pages, so no group of aliases is
    gathered anywhere.
    """
    url = F.col("url")
    rows = pages.select(
        F.col(page_id).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node")
    )
    edges = alias_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("src")), node_of(F.col("dst"))))
    parts = connected_components(edges, "node", "alias")
    address = F.concat(F.lit("x://"), F.col("node"))
    said = matched_rule(host_of(address), path_of(address), rules)["verdict"]
    decided = (
        parts.withColumn("said", said)
        .groupBy("component")
        .agg(F.max(F.col("said") == "allow").alias("allow"), F.max(F.col("said") == "block").alias("block"))
    )
    shared = parts.join(decided, "component").select(
        "node", F.when(F.col("allow"), "allow").when(F.col("block"), "block").alias("shared")
    )
    own = matched_rule(F.col("host"), F.col("path"), rules)
    return rows.join(shared, "node", "left").select(
        "page_id",
        "host",
        "path",
        own["rule"].alias("rule"),
        F.coalesce(own["verdict"], "shared", F.lit("allow")).alias("verdict"),
    )
