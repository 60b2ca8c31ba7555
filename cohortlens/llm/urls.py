"""URL filter with redirect equivalence.

Rules decide by host and path.  Pages without a rule take the decision of
their aliases: addresses that differ in form only, and addresses joined by
redirect or canonical-link edges, whose connected components are found on the
cluster.  An allow among the aliases wins over any block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.session import written

from .components import components
from .exprs import clear_of, set_apart

#: Fixed values of the task: host, path and verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Query parameters that name a visit and not a page.
VISIT_PARAMETERS = r"(?:utm_[a-z]+|ref|fbclid|gclid)"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """An address without what does not change the page: scheme, ``www.``,
    fragment, visit parameters, index file and last slash; null if it has no host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/index\.html?$", "/"), r"/+$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^{VISIT_PARAMETERS}(?:=|$)")))
    return F.when(host != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))
                                                           ).otherwise("")))


def link_targets(url: Column, html: Column) -> Column:
    """Addresses that a page names as its canonical one or sends its reader to."""
    attribute = r"""\bhref\s*=\s*["']?([^"'\s>]+)"""
    link = F.regexp_extract(html, r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", 0)
    refresh = F.regexp_extract(html, r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", 0)
    found = F.array(F.regexp_extract(link, f"(?is){attribute}", 1),
                    F.regexp_extract(refresh, r"""(?is)\burl\s*=\s*["']?([^"'\s>;]+)""", 1))
    origin = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    full = F.transform(found, lambda t: F.when(t.startswith("//"), F.concat(F.lit("http:"), t)).when(
        t.startswith("/"), F.concat(origin, t)).otherwise(t))
    return F.filter(full, lambda t: t.contains("://"))


def match_rules(pages: DataFrame, rules: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The longest rule of each page: columns ``keys``, ``rule``, ``rule_verdict``.

    An equi join of a page's host suffixes and path starts with the rules, so a
    long list of rules costs no more per page.  Of equally long rules an allow
    wins, then the longer host.  Runs a small job for the distinct lengths of
    the rules' paths.
    """
    lengths = sorted(r[0] for r in rules.select(F.length("rule_path").alias("n")).distinct().collect())
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.array_compact(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]))
    tried = pages.where("host <> ''").select(*keys, "path", F.explode(suffixes).alias("rule_host"), starts.alias("_starts"))
    tried = tried.select(*keys, "rule_host", F.explode("_starts").alias("rule_path"))
    strength = F.struct(F.length(F.concat("rule_host", "rule_path")), F.col("verdict") == "allow", F.length("rule_host"))
    hit = tried.join(rules, ["rule_host", "rule_path"])
    return hit.groupBy(*keys).agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"),
                                                    F.col("verdict").alias("rule_verdict")), strength).alias("r")
                                  ).select(*keys, "r.*")


def filter_urls(pages: DataFrame, rules: DataFrame | None = None, links: DataFrame | None = None,
                url: str = "url", html: str = "html") -> DataFrame:
    """Every column of ``pages`` but the markup, ``host``, ``path``, ``rule``,
    ``verdict`` and ``component``.

    ``rules`` has ``rule_host``, ``rule_path`` and ``verdict`` (default: RULES);
    ``links`` further edges ``(src, dst)`` of addresses, such as a log of
    redirects.  The longest rule decides; a page without one takes allow if any
    page of its component is allowed by a rule, else block if any is blocked,
    else allow.  A null address or one without ``://`` has no host, no aliases
    and the verdict allow.  Repeated rows are kept.  Columns with the added
    names are replaced.  Runs the jobs of ``components`` while it is built.
    """
    spark = pages.sparkSession
    if rules is None:
        rules = spark.createDataFrame([(h, p, v) for h, p, v in RULES], "rule_host string, rule_path string, verdict string")
    pages, at, restored = set_apart(clear_of(pages, ["host", "path", "rule", "verdict", "component"]))
    marked_up = html in restored
    u, m = F.col(at(url)), F.col(at(html)) if marked_up else F.lit(None).cast("string")
    base = pages.withColumns({"host": host_of(u), "path": path_of(u), "_node": canonical(u), "_to": F.transform(
        F.coalesce(link_targets(u, m), F.array().cast("array<string>")), canonical)})
    base = written(base.drop(at(html)) if marked_up else base, "pages")
    edges = base.select(F.col("_node").alias("a"), F.explode("_to").alias("b"))
    if links is not None:
        edges = edges.union(links.select(canonical(F.col("src")), canonical(F.col("dst"))))
    groups = components(edges.where("a IS NOT NULL AND b IS NOT NULL"))
    # Rules see only host and path: each pair is matched once, however many pages share it.
    matched = match_rules(base.select("host", "path").distinct(), rules, ["host", "path"])
    judged = base.drop("_to").join(matched, ["host", "path"], "left").join(
        groups.withColumnRenamed("node", "_node"), "_node", "left").withColumn(
        "component", F.coalesce("component", "_node"))
    spread = judged.where("rule_verdict IS NOT NULL AND component IS NOT NULL").groupBy("component").agg(
        F.max(F.col("rule_verdict") == "allow").alias("_allowed"))
    inherited = F.when(F.col("_allowed"), "allow").when(~F.col("_allowed"), "block").otherwise("allow")
    kept = [c for name, c in restored.items() if name != html]
    return judged.join(spread, "component", "left").select(
        *kept, "host", "path", "rule", F.coalesce("rule_verdict", inherited).alias("verdict"), "component")
