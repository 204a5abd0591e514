"""URL filters with redirect equivalence (native: DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Splits a url at the first "://" into host and path.
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Up to so many rules are one expression; more are a joined table.
FEW_RULES = 64


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#``; A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, SPLIT, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, SPLIT, 2), F.lit(""))


def node_of(url: Column) -> Column:
    """The resource a url names: host, path and query, without scheme and fragment; null without host."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), F.coalesce(query, F.lit(""))))


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule as struct(rule, verdict), else null.

    ``rules``: (verdict, "host/path"). A rule fits its host and all subdomains if the path starts
    with the rule's path. Equal lengths: allow goes first. One expression, so no shuffle and no join.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "allow")):
        name, slash, rest = rule.partition("/")
        fits = (F.concat(F.lit("."), host).endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def joined_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path, hit`` of the distinct ``urls(host, path)`` that one of ``rules(verdict, rule)`` fits, however many.

    A host's suffixes meet the hosts of rules; those that do, their path's beginnings of the lengths that
    rules of that host have. So a url makes a row per label and per length, never per rule.
    """
    name = F.substring_index("rule", "/", 1)
    parted = rules.select(name.alias("name"), F.col("rule").substr(F.length(name) + 1, F.length("rule")).alias("prefix"), "rule", "verdict")
    known = parted.groupBy("name", "prefix", "rule").agg(F.min("verdict").alias("verdict"))
    hosts = known.groupBy("name").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    most = known.agg(F.max(F.size(F.split("name", r"\."))).alias("n")).first().n or 1
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))), lambda i: F.array_join(F.slice(labels, -i, i), "."))
    met = urls.select("host", "path").distinct().withColumn("name", F.explode(suffixes)).join(hosts, "name")
    begins = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.col("path").substr(F.lit(1), n))
    fits = met.withColumn("prefix", F.explode(begins)).join(known, ["name", "prefix"])
    best = F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.col("verdict") == "allow", "rule"))
    return fits.groupBy("host", "path").agg(best.alias("hit"))


def _with_hits(urls: DataFrame, rules: Sequence[tuple[str, str]] | DataFrame) -> DataFrame:
    """``urls(host, path, ...)`` with ``hit``, the longest fitting rule or null."""
    if not isinstance(rules, DataFrame):
        if len(rules) <= FEW_RULES:
            return urls.withColumn("hit", match_rule(F.col("host"), F.col("path"), rules))
        rules = urls.sparkSession.createDataFrame(list(rules), "verdict string, rule string")
    return urls.join(joined_rules(urls, rules), ["host", "path"], "left")


def link_targets(html: Column, url: Column) -> Column:
    """Absolute targets of canonical links and of meta refreshes, as an array (empty without any)."""
    tags = F.filter(
        F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0)),
        lambda t: t.rlike(r"(?is)rel\s*=\s*[\"']?canonical\b|http-equiv\s*=\s*[\"']?refresh\b"),
    )
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.regexp_replace(path_of(url), r"[^/]*$", "")

    def absolute(tag: Column) -> Column:
        raw = F.trim(F.regexp_extract(tag, r"(?is)(?:href\s*=\s*[\"']?|url\s*=\s*[\"']?)([^\"'>\s]+)", 1))
        return (
            F.when(raw == "", None)
            .when(raw.contains("://"), raw)
            .when(raw.startswith("//"), F.concat(scheme, F.lit(":"), raw))
            .when(raw.startswith("/"), F.concat(root, raw))
            .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), raw))
        )

    return F.filter(F.transform(tags, absolute), lambda t: t.isNotNull())


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] | DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Judge every row of ``pages(page_id, url, html)``: ``page_id, host, path, rule, verdict, component``.

    A url that a rule fits has the rule's verdict. Any other takes that of its redirect class: urls
    that canonical links, meta refreshes or ``redirects(src_url, dst_url)`` connect, whether or not
    the target is a page here. A class with an explicitly allowed url is allowed, else one with a
    blocked url is blocked, else (and without links) the url is allowed. ``component`` is the class's
    least url form, null for urls without links.

    ``rules``: pairs or a table of (verdict, rule); more than a few are joined, see ``joined_rules``.

    Null or empty url or html, no ``://``: host and path empty, no rule, allow. Repeated rows are
    judged alike, each once. Other columns are ignored. An empty table gives no rows. The html column
    is read once, for the links alone; what is joined and shuffled is urls.
    """
    links = pages.select("url", F.explode(link_targets(F.col("html"), F.col("url"))).alias("dst")).select(
        node_of(F.col("url")).alias("src"), node_of(F.col("dst")).alias("dst")
    )
    if redirects is not None:
        links = links.union(redirects.select(node_of(F.col("src_url")), node_of(F.col("dst_url"))))
    links = materialize(links.where("src is not null and dst is not null").distinct(), "links")
    classes = connected_components(links)
    as_url = F.concat(F.lit("x://"), F.col("node"))
    judged = _with_hits(classes.withColumns({"host": host_of(as_url), "path": path_of(as_url)}), rules).withColumn("said", F.col("hit.verdict"))
    of_class = judged.groupBy("component").agg(
        F.coalesce(F.bool_or(F.col("said") == "allow"), F.lit(False)).alias("any_allow"),
        F.coalesce(F.bool_or(F.col("said") == "block"), F.lit(False)).alias("any_block"),
    )
    known = classes.join(of_class, "component").select("node", "component", (F.col("any_block") & ~F.col("any_allow")).alias("barred"))
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    rows = _with_hits(rows, rules)
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("barred"), "block").otherwise("allow"))
    return rows.join(known, "node", "left").select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "component")
