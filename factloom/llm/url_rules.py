"""URL block and allow rules that also hold for aliases.

A page's aliases are the urls that it redirects to or names as canonical, and so on along such
links: the connected components of the link graph.  A url without a rule of its own is blocked
if a url of its component is blocked by a rule, unless the component has one that is allowed
explicitly; otherwise it is allowed.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components


class Rule(NamedTuple):
    verdict: str  # allow or block
    rule: str  # host and the path's beginning, like ``example.org/es/``


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no ``://``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule as struct(rule, verdict); null if none fits.  An equally long block loses to an allow."""
    order = sorted(rules, key=lambda r: (-len(r.rule), r.verdict != "allow", r.rule))
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in reversed(order):
        name, slash, start = rule.partition("/")
        inside = (host == name) | host.endswith("." + name)
        fits = F.when(inside & path.startswith(slash + start), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def _node(url: Column) -> Column:
    """A url without its fragment, its host lower-cased: what is fetched."""
    host, _ = host_and_path(url)
    bare = F.regexp_replace(url, r"#.*$", "")
    at = F.locate("://", bare)
    return F.when(at > 0, F.concat(F.lower(F.substr(bare, F.lit(1), at + 2)), host, F.substr(bare, at + 3 + F.length(host))))


_TAG = r"(?is)<{0}\b[^>]*>"


def links(pages: DataFrame) -> DataFrame:
    """src, dst: the canonical links and immediate redirects that each page's html names.

    ``<link rel="canonical" href>`` and ``<meta http-equiv="refresh" content="n;url=">`` with an
    absolute url, or one relative to the host's root; attributes that only end in these names
    (``data-href``) do not count.  Urls relative to the page's folder, and ``<base>``, are left
    out: what they name is on the same host, so its own rule says the same but for its path.
    Columns redirect_url and canonical_url of ``pages``, where they exist as strings, give links too.
    """
    url = F.col("url")
    root = F.concat(F.substr(url, F.lit(1), F.locate("://", url) + 2), host_and_path(url)[0])

    def whole(target: Column) -> Column:
        target = F.trim(F.replace(target, F.lit("&amp;"), F.lit("&")))
        return F.when(target.startswith("//"), F.concat(F.regexp_extract(url, r"^([^:]*:)//", 1), target)).when(target.startswith("/"), F.concat(root, target)).when(F.locate("://", target) > 0, target)

    def tags(name: str, must: str) -> Column:
        return F.filter(F.regexp_extract_all("html", F.lit(_TAG.format(name)), F.lit(0)), lambda tag: tag.rlike(must))

    canonical = F.transform(tags("link", r"(?i)\srel\s*=\s*[\"']?canonical\b"), lambda tag: F.regexp_extract(tag, r"(?is)\shref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    refresh = F.transform(tags("meta", r"(?i)\shttp-equiv\s*=\s*[\"']?refresh\b"), lambda tag: F.regexp_extract(tag, r"(?is)[\"';,\s]url\s*=\s*[\"']?([^\"'\s>]+)", 1))
    named = [F.array(F.col(c)) for c in ("redirect_url", "canonical_url") if (c, "string") in pages.dtypes]
    targets = F.concat(*(F.coalesce(c, F.array().cast("array<string>")) for c in (canonical, refresh, *named)))
    found = pages.where(F.locate("://", url) > 0).select("url", F.explode(targets).alias("to"))
    return found.select(_node(url).alias("src"), _node(whole(F.col("to"))).alias("dst")).where("dst IS NOT NULL AND src <> dst").distinct()


def judge(pages: DataFrame, rules: list[Rule], *, default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, via_alias.

    The verdict is that of the longest fitting rule, else the aliases' (``via_alias`` is then
    true), else ``default``.  Null urls, and such without ``://``, have empty host and path, fit
    no rule and have no aliases.  Repeated rows and null ids pass through; null html has no
    links; an empty table gives no rows.
    """
    host, path = host_and_path(F.col("url"))
    edges = links(pages)
    component = connected_components(edges)  # node, component; nodes with a link only
    node_host, node_path = host_and_path(F.col("node"))
    decided = component.select("component", longest_rule(node_host, node_path, rules)["verdict"].alias("verdict"))
    spread = decided.groupBy("component").agg(F.bool_or(F.col("verdict") == "allow").alias("allowed"), F.bool_or(F.col("verdict") == "block").alias("blocked"))
    passed = component.join(spread.where("blocked AND NOT coalesce(allowed, false)"), "component").select(F.col("node").alias("alias"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), longest_rule(host, path, rules).alias("own"), _node(F.col("url")).alias("alias"))
    return rows.join(passed.withColumn("aliased", F.lit(True)), "alias", "left").select(
        "page_id", "host", "path", F.col("own.rule").alias("rule"),
        F.coalesce("own.verdict", F.when(F.col("aliased"), "block"), F.lit(default)).alias("verdict"),
        (F.col("own").isNull() & F.coalesce("aliased", F.lit(False))).alias("via_alias"),
    )
