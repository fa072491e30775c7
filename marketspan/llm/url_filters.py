"""URL block lists that see through redirects and canonical links.

A page's own rule decides first: of the rules whose host is the url's host or a
parent domain of it and whose path begins the url's path, the longest wins.
Pages without a rule take the decision of their aliases: pages that redirects
(meta refresh) and canonical links connect, directly or through others, which
are connected components over those links.  If any alias is allowed by a rule the
page is allowed; else if any is blocked it is blocked; else it is allowed.

Only DataFrame functions are used.  Links in comments, scripts and styles don't
count.  Targets are resolved against their page: absolute, from the scheme, from the root, beside
the page (with ``.`` and ``..``), or its query only; a target that is empty or a
fragment only is the page itself.  Urls are compared without their fragment, with dot
segments removed and an empty path as ``/``.  Pages are read whole.
Nulls: a null url, or one without ``://``, has an empty host and path, no rule
and no aliases, and is allowed; a null html has no links.  Repeated urls are
aliases of each other; repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
_TAGS = r"(?is)<(?:link|meta)\s[^>]*>"
_CANONICAL = r"(?is)\srel\s*=\s*[\"']?canonical[\"'\s>/]"
_REFRESH = r"(?is)\shttp-equiv\s*=\s*[\"']?refresh[\"'\s>/]"
_HREF = r"(?is)\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\"'\s>]+))"
_TARGET = r"(?is)url\s*=\s*[\"']?([^\"'>\s]+)"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.contains(url, F.lit("://")), ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    """What stands after the host up to ``?``, ``#`` or the end; else empty."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does.  Rules are (verdict, host, path)."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    ranked = sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r[0] == "allow"))
    for verdict, rule_host, rule_path in ranked:  # the longest is asked first, so it comes last here
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def link_targets(html: Column) -> Column:
    """All canonical and refresh targets in a page, as they are written."""
    tags = F.regexp_extract_all(F.regexp_replace(html, _HIDDEN, " "), F.lit(_TAGS), F.lit(0))
    canonical = F.transform(F.filter(tags, lambda t: t.rlike(_CANONICAL)), lambda t: F.concat(F.regexp_extract(t, _HREF, 1), F.regexp_extract(t, _HREF, 2), F.regexp_extract(t, _HREF, 3)))
    refresh = F.transform(F.filter(tags, lambda t: t.rlike(_REFRESH)), lambda t: F.regexp_extract(t, _TARGET, 1))
    return F.filter(F.transform(F.concat(canonical, refresh), lambda t: F.regexp_replace(F.trim(t), "&(?:amp|#38|#x26);", "&")), lambda t: t != "")


def absolute(target: Column, url: Column) -> Column:
    """A target as a url: absolute, from the scheme, from the host's root, beside the page, or the page with another query or none."""
    scheme = F.regexp_extract(url, r"(?s)^([^:/?#]*)://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.regexp_replace(path_of(url), r"[^/]*$", "")
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .when(target.startswith("?"), F.concat(root, path_of(url), target))
        .when(target.startswith("#"), url)
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), target))
    )


def without_dots(path: Column) -> Column:
    """A path whose ``.`` and ``..`` segments are carried out; empty becomes ``/``."""
    closed = F.when(path.rlike(r"/\.\.?$"), F.concat(path, F.lit("/"))).otherwise(path)
    step = lambda kept, x: F.when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(x == ".", kept).otherwise(F.array_append(kept, x))
    parts = F.slice(F.split(closed, "/"), F.lit(2), F.greatest(F.size(F.split(closed, "/")) - 1, F.lit(0)))
    walked = F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.expr("cast(array() as array<string>)"), step), "/"))
    return F.when(path == "", "/").when(path.contains("/."), walked).otherwise(path)


def node_of(url: Column) -> Column:
    """A url without its fragment, with a lower-cased scheme and host and without dot segments."""
    bare = F.regexp_extract(url, r"(?s)^([^#]*)", 1)
    query = F.regexp_extract(bare, r"(?s)^[^?]*(\?.*)$", 1)
    return F.concat(ascii_lower(F.regexp_extract(bare, r"(?s)^([^:/?#]*)://", 1)), F.lit("://"), host_of(bare), without_dots(path_of(bare)), query)


def page_links(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """(a, b): nodes that are aliases; ``redirects`` may add (from_url, to_url) pairs from a crawl log."""
    has_link = F.col("html").rlike("(?i)canonical|refresh")
    rows = pages.select(F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).where(has_link & F.col("url").contains("://"))
    found = rows.select("url", F.explode(link_targets(F.col("html"))).alias("target")).select("url", absolute(F.col("target"), F.col("url")).alias("target"))
    if redirects is not None:
        found = found.union(redirects.select("from_url", "to_url").where("contains(from_url, '://') and contains(to_url, '://')"))
    return found.select(node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b")).where("a <> b").distinct()


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]], *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, alias_of): alias_of names the component of a page that has aliases."""
    url = F.col("url")
    judged = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    judged = judged.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.when(url.contains("://"), node_of(url)).alias("node"))
    judged = judged.withColumn("own", matching_rule(F.col("host"), F.col("path"), rules))
    aliases = stored(connected_components(stored(page_links(pages, url_col=url_col, html_col=html_col, redirects=redirects))))
    # targets that are no page of the table count with their own rule too
    decided = aliases.withColumn("own", matching_rule(host_of(F.col("node")), path_of(F.col("node")), rules))
    votes = decided.groupBy("root").agg(F.max(F.coalesce(F.col("own.verdict") == "allow", F.lit(False))).alias("allowed"), F.max(F.coalesce(F.col("own.verdict") == "block", F.lit(False))).alias("blocked"))
    of_node = aliases.join(votes, "root").select("node", F.col("root").alias("alias_of"), F.when(~F.col("allowed") & F.col("blocked"), "block").otherwise("allow").alias("shared"))
    joined = judged.join(of_node, "node", "left")
    verdict = F.coalesce(F.col("own.verdict"), F.col("shared"), F.lit("allow"))
    return joined.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.col("own.rule").alias("rule"), verdict.alias("verdict"), "alias_of")
