"""URL verdicts by listed rules and, where none fits, by path templates.

1. A url gives a host and a path. A rule fits its host and all subdomains if the path
   starts with the rule's; the longest rule that fits decides.
2. Urls that a rule decides are the labels. Urls are counted once by host and path shape:
   numbers and long codes in a segment become a wildcard.
3. Per host, and once more per domain over all its hosts, the shapes form a tree, grown
   segment by segment. Children of a node that are many and rare are a variable segment and
   become one wildcard ``*``. Of the others, those that resemble their siblings merge into
   one branch ``~``: what follows them is of the same kinds as often (a chi-squared test),
   and their labels, if they have any, are blocked as often (a test of proportions). So an
   unlabelled branch joins the labelled ones that it looks like.
4. A template is a path from the root. Its purity is the share of blocks among its labels,
   smoothed towards its parent, and so on through the host and the domain to all labels.
5. A template with labels enough judges by its purity; else the domain's template of the
   same url does, with the host's few labels added. Where neither has labels enough there
   is no evidence, and the url is allowed.

Only Spark SQL functions are used. Pages meet the tree through one join on (host, shape).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..session import write_out


@dataclass(frozen=True)
class Templates:
    """``depth``: segments with a branch of their own; what follows them is one last segment.
    ``least``: labels that a template must have to judge."""

    depth: int = 5
    many: int = 20
    rare: float = 2.0
    z: float = 1.96
    smoothing: float = 4.0
    reject: float = 0.8
    least: int = 3


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)://(.*)$", 1)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)://(.*)$", 1)
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule as a struct (size, rule, verdict), or null; of equally long
    ones the last in code point order. Rules are (``host/path``, verdict) and part of the plan."""
    fits = []
    for rule, verdict in rules:
        name, slash, rest = rule.partition("/")
        ok = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        fits.append(F.when(ok, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    if not fits:
        return F.lit(None).cast("struct<size: int, rule: string, verdict: string>")
    return fits[0] if len(fits) == 1 else F.greatest(*fits)


def domain_of(host: Column) -> Column:
    """The last two labels of a host; there is no list of public suffixes here."""
    return F.substring_index(host, ".", -2)


def shape_of(path: Column, depth: int) -> Column:
    """The path's segments, numbers and codes as wildcards, all behind ``depth`` in one."""

    def general(s: Column) -> Column:
        code = F.regexp_replace(s, r"[0-9A-Fa-f-]{16,}", "{code}")
        return F.regexp_replace(code, r"[0-9]+", "{n}")

    parts = F.transform(F.split(path, "/"), general)
    head, tail = F.slice(parts, 2, depth), F.slice(parts, depth + 2, 1 << 30)
    return F.when(F.size(tail) > 0, F.concat(head, F.array(F.array_join(tail, "/")))).otherwise(head)


def kind_of(segment: Column) -> Column:
    """What a segment is like: words as ``w``, runs of words as one, the end of a path as ``$``."""
    words = F.regexp_replace(segment, r"\p{L}+", "w")
    return F.coalesce(F.regexp_replace(words, r"w([-_+. ]w)+", "w-w"), F.lit("$"))


def _alike(rows: DataFrame, level: int, how: Templates) -> DataFrame:
    """(owner, template, segment, labelled, blocked, base, name): the children of a level by name."""
    node, sums = ["owner", "template"], [F.sum(c).alias(c) for c in ("urls", "labelled", "blocked")]
    kinds = rows.where("segment is not null").groupBy(*node, "segment", kind_of(F.get("shape", F.lit(level))).alias("kind")).agg(
        *sums, F.max("purity").alias("base")
    )
    # Shares of kinds and of blocks in the node as a whole.
    whole = kinds.groupBy(*node, "kind").agg(F.sum("urls").alias("all_urls"))
    total = kinds.groupBy(*node).agg(
        F.countDistinct("segment").alias("children"), F.countDistinct("kind").alias("freedom"), F.sum("urls").alias("node_urls"),
        F.sum("labelled").alias("node_labelled"), F.sum("blocked").alias("node_blocked"),
    )
    # Sum over kinds of (seen - expected)^2 / expected = sum of seen^2 / expected - all seen.
    share = F.col("all_urls") / F.col("node_urls")
    child = kinds.join(whole, [*node, "kind"]).join(total, node).groupBy(*node, "segment").agg(
        *sums, F.max("base").alias("base"), F.sum(F.col("urls") * F.col("urls") / share).alias("squares"),
        *[F.max(c).alias(c) for c in ("children", "freedom", "node_urls", "node_labelled", "node_blocked")],
    )
    free = F.col("freedom") - 1
    same_kinds = F.col("squares") / F.col("urls") - F.col("urls") <= free + how.z * F.sqrt(2 * free) + 1e-9
    blocks = F.col("node_blocked") / F.nullif(F.col("node_labelled"), F.lit(0))
    error = F.sqrt(blocks * (1 - blocks) / F.nullif(F.col("labelled"), F.lit(0)))
    apart = F.abs(F.col("blocked") / F.nullif(F.col("labelled"), F.lit(0)) - blocks) > how.z * error + 1e-12
    variable = (F.col("children") > how.many) & (F.col("node_urls") / F.col("children") <= how.rare)
    name = F.when(variable, F.lit("*")).when(same_kinds & ~F.coalesce(apart, F.lit(False)), F.lit("~")).otherwise(F.col("segment"))
    return child.select(*node, "segment", "labelled", "blocked", "base", name.alias("name"))


def template_tree(shapes: DataFrame, how: Templates) -> DataFrame:
    """(owner, shape, template, purity, labelled, blocked) from (owner, shape, urls, labelled,
    blocked, purity), one row for each shape; purity comes in as the root's. The counts that
    come out are the template's."""
    rows = shapes.withColumn("template", F.lit(""))
    for level in range(1, how.depth + 2):
        rows = rows.withColumn("segment", F.get("shape", F.lit(level - 1)))
        named = _alike(rows, level, how)
        groups = named.groupBy("owner", "template", "name").agg(
            F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.max("base").alias("base")
        ).select("owner", "template", "name", ((F.col("b") + how.smoothing * F.col("base")) / (F.col("l") + how.smoothing)).alias("pure"))
        step = named.select("owner", "template", "segment", "name").join(groups, ["owner", "template", "name"])
        ended = F.col("segment").isNull()
        rows = rows.join(step, ["owner", "template", "segment"], "left").select(
            "owner", "shape", "urls", "labelled", "blocked",
            F.when(ended, F.col("template")).otherwise(F.concat_ws("/", "template", "name")).alias("template"),
            F.when(ended, F.col("purity")).otherwise(F.col("pure")).alias("purity"),
        )
        rows = write_out(rows, "templates")
    counts = rows.groupBy("owner", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    return rows.select("owner", "shape", "template", "purity").join(counts, ["owner", "template"])


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], url_col: str = "url", how: Templates = Templates()) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``template``, ``purity``, ``labels`` and ``verdict``.

    ``labels`` is the number of labels that the judging template has: the host's, or the
    domain's where the host has too few. A null url and one without "://" have an empty host
    and path; they meet the tree like any other, and so do very long urls. Without rules or
    labels every template is allowed. Repeated rows agree, an empty table stays empty, and
    columns of ``pages`` named like a new one are replaced.
    """
    new = ["host", "path", "rule", "template", "purity", "labels", "verdict"]
    url = F.col(url_col).cast("string")
    kept = [c for c in pages.columns if c not in new]
    parts = pages.select(*[F.col(c).alias(f"_{c}") for c in kept], host_of(url).alias("host"), path_of(url).alias("path"))
    rows = parts.withColumn("_hit", rule_for(F.col("host"), F.col("path"), rules)).withColumn("_shape", shape_of(F.col("path"), how.depth))
    shapes = write_out(
        rows.groupBy("host", F.col("_shape").alias("shape")).agg(
            F.count("*").alias("urls"), F.count("_hit").alias("labelled"), F.count_if(F.col("_hit.verdict") == "block").alias("blocked")
        ),
        "shapes",
    )
    labels = shapes.agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("b")).first()
    prior = labels["b"] / labels["n"] if labels["n"] else 0.0

    def smooth(base: Column | float) -> Column:
        return (F.col("blocked") + how.smoothing * base) / (F.col("labelled") + how.smoothing)

    sums = [F.sum(c).alias(c) for c in ("urls", "labelled", "blocked")]
    domain = F.concat(F.lit("."), domain_of(F.col("host"))).alias("domain")
    hosts = shapes.groupBy("host").agg(*sums).withColumn("domain", domain)
    domains = hosts.groupBy("domain").agg(*sums).select("domain", smooth(prior).alias("base"))
    roots = hosts.join(domains, "domain").select(F.col("host").alias("owner"), smooth(F.col("base")).alias("purity")).unionByName(
        domains.select(F.col("domain").alias("owner"), F.col("base").alias("purity"))
    )
    by_domain = shapes.groupBy(domain.alias("owner"), "shape").agg(*sums)
    owned = shapes.withColumnRenamed("host", "owner").unionByName(by_domain).join(roots, "owner")
    grown = write_out(template_tree(write_out(owned, "owned"), how), "grown")

    own = grown.select(F.col("owner").alias("host"), "shape", "template", "purity", "labelled", "blocked")
    above = grown.select(F.col("owner").alias("domain"), "shape", F.col("purity").alias("wide"), F.col("labelled").alias("wide_labelled"))
    known = own.join(shapes.select("host", "shape", domain), ["host", "shape"]).join(above, ["domain", "shape"], "left")
    few = F.col("labelled") < how.least
    known = known.select(
        "host", F.col("shape").alias("_shape"), "template", F.when(few & (F.col("wide_labelled") >= how.least), smooth(F.col("wide"))).otherwise(F.col("purity")).alias("purity"),
        F.when(few, F.greatest("labelled", "wide_labelled")).otherwise(F.col("labelled")).alias("labels"),
    )
    rejected = (F.col("purity") >= how.reject) & (F.col("labels") >= how.least)
    verdict = F.coalesce(F.col("_hit.verdict"), F.when(rejected, "block").otherwise("allow"))
    return rows.join(known, ["host", "_shape"], "left").select(
        *[F.col(f"_{c}").alias(c) for c in kept], "host", "path", F.col("_hit.rule").alias("rule"), "template", "purity", "labels", verdict.alias("verdict")
    )
