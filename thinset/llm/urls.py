"""URL verdicts from host and path rules, carried over redirects to aliases.

Urls that redirect to one another or name the same canonical address are one class
(connected components over the edges).  A url's own rule decides first; a url without a
rule is allowed if its class holds an explicitly allowed url, else blocked if the class
holds a blocked one, else allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thinset.llm.components import components
from thinset.llm.tables import stored

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
RULE_BYTES = 32 << 20   # rules that the tasks may carry
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TAG = r"(?is)<(link|meta)\b([^>]*)>"


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """The address a site redirects variants to: https, no www. or m., no fragment, no
    tracking or session parameters, no index page, closing slash or .html.

    An address without "://" stands for itself.
    """
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(/index)?(\.html?)?/*$", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (F.length(p) > 0) & ~p.rlike(r"(?i)^(utm_[a-z]+|ref|fbclid|gclid|sessionid)=")))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(url.contains("://"), F.concat(F.lit("https://"), host, path, query)).otherwise(url)


def without_dots(path: Column) -> Column:
    """A path that begins with "/", its segments "." and ".." carried out.

    Its cost grows with the square of the segments, for paths that hold such ones only.
    """
    parts = F.slice(F.split(path, "/", -1), 2, 1 << 30)
    dots = F.element_at(parts, -1).isin(".", "..")

    def step(kept: Column, part: Column) -> Column:
        return (F.when(part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))
                .when(part == ".", kept).otherwise(F.concat(kept, F.array(part))))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    kept = F.when(dots, F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.rlike(r"(?s)/\.\.?(/|\z)"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def resolved(base: Column, target: Column) -> Column:
    """The address ``target`` names on a page at ``base``; null if it is none of the web.

    Absolute; of the same scheme ("//h/x"); from the root ("/x"); from the page's folder
    ("x", "../x"); a query ("?x") or a fragment ("#x") of the page itself.
    """
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(base))
    path = path_of(base)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    folder = F.regexp_extract(path, r"(?s)^(.*/)", 1)
    query = F.regexp_extract(base, r"(?s)^[^?#]*(\?[^#]*)", 1)
    way, tail = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    full = (F.when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
            .when(target.startswith("/"), F.concat(root, without_dots(way), tail))
            .when(target.startswith("?"), F.concat(root, path, target))
            .when(target.startswith("#") | (target == ""), F.concat(root, path, query, target))
            .otherwise(F.concat(root, without_dots(F.concat(folder, way)), tail)))
    return (F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
            .when(~target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") & (scheme != ""), full))


def html_edges(pages: DataFrame) -> DataFrame:
    """(a, b): a page's url and the address its canonical link or refresh names.

    Relative addresses are resolved against the page's first base tag, which itself may
    be relative, or else against its url.
    """
    tags = F.regexp_extract_all(F.col("html").cast("string"), F.lit(TAG), F.lit(0))
    wanted = F.filter(tags, lambda t: t.rlike(r"""(?i)rel\s*=\s*["']?canonical|http-equiv\s*=\s*["']?refresh"""))
    base = F.regexp_extract(F.col("html").cast("string"), r"""(?is)<base\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
    rows = pages.where(F.col("html").rlike("(?i)canonical|http-equiv")).select(
        F.col("url").cast("string").alias("url"), base.alias("base"), F.explode(wanted).alias("tag"))
    link = F.regexp_extract("tag", r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
    jump = F.regexp_extract("tag", r"""(?is)\bcontent\s*=\s*["']?\s*[0-9.]+\s*;\s*url\s*=\s*["']?([^"'>]+)""", 1)
    target = F.trim(F.when(F.lower("tag").startswith("<link"), link).otherwise(jump))
    url = F.col("url")
    rows = rows.withColumn("target", target).where("target <> ''")
    rows = rows.withColumn("base", F.when(F.col("base") == "", url).otherwise(
        F.coalesce(resolved(url, F.col("base")), url)))
    return rows.select(url.alias("a"), resolved(F.col("base"), F.col("target")).alias("b")).where(
        "a IS NOT NULL AND b IS NOT NULL")


def _judge(rules: tuple[tuple[str, str, str], ...]):
    """The longest rule that fits (host, path), as "rule verdict", or null."""
    if sum(len(h) + len(p) + 16 for h, p, _ in rules) > RULE_BYTES:
        raise ValueError("too many rules for one pass; judge the table in parts")
    by_host: dict[str, list[tuple[str, str]]] = {}
    for host, path, verdict in rules:
        by_host.setdefault(host, []).append((path, verdict))

    def one(host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[int, str, str] | None = None
        labels = host.split(".")
        for i in range(len(labels)):
            suffix = ".".join(labels[i:])
            for start, verdict in by_host.get(suffix, ()):
                # Of equally long rules the more special host wins, then allow.
                if path.startswith(start) and (best is None or len(suffix) + len(start) > best[0] or (
                        len(suffix + start) == best[0] and suffix + start == best[1] and verdict == "allow")):
                    best = len(suffix) + len(start), suffix + start, verdict
        return (best[1], best[2]) if best else (None, None)

    @F.pandas_udf("struct<rule: string, verdict: string>")
    def judge(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in pairs:
            yield pd.DataFrame([one(h, p) for h, p in zip(hosts, paths)], columns=["rule", "verdict"])

    return judge


def judge_urls(pages: DataFrame, edges: DataFrame | None = None,
               rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, url_class) per row of ``pages`` (page_id, url, html).

    A rule (host, path, verdict) fits its host and all subdomains where the path starts
    with the rule's; the longest wins.  ``edges`` (a, b) adds redirects known elsewhere
    to those the pages tell: canonical links, refreshes, and the redirect of a url's
    variants to its canonical form.  A null url or one without "://" has an empty host
    and path and fits no rule; a null url has no aliases and is allowed.  Repeated rows
    are judged each, other columns are not read, an empty table gives no rows.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    rows = rows.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = stored(rows.withColumn("own", _judge(tuple(rules))("host", "path")), "judged")
    found = rows.where("url IS NOT NULL").select(F.col("url").alias("a"), canonical(F.col("url")).alias("b"))
    found = found.union(html_edges(pages))
    if edges is not None:
        found = found.union(edges.select(F.col("a").cast("string"), F.col("b").cast("string")))
    # The addresses are worked out once: each later use would repeat their expressions.
    found = stored(found, "aliases")
    # A target's own variants redirect too.
    found = found.union(found.select(F.col("b").alias("a"), canonical(F.col("b")).alias("b")))
    classes = stored(components(found.where("a <> b")), "classes")
    joined = rows.join(classes.withColumnRenamed("node", "url"), "url", "left").select(
        "page_id", "host", "path", "own", F.coalesce("component", "url").alias("url_class"))
    joined = stored(joined, "classed")
    told = joined.where("own.verdict IS NOT NULL AND url_class IS NOT NULL").groupBy("url_class").agg(
        F.min("own.verdict").alias("told"))  # "allow" sorts before "block"
    return joined.join(told, "url_class", "left").select(
        "page_id", "host", "path", F.col("own.rule").alias("rule"),
        F.coalesce("own.verdict", "told", F.lit("allow")).alias("verdict"), "url_class")
