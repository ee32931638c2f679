"""URL filters by rules and by a path-template tree (operator 2), in DataFrame functions only.

Each host has a tree of path segments. From the top down, the children of a node become one wildcard if they are many, or
if nearly all hold digits. Then siblings are merged into branches: from the lowest rate of blocked labels up, a node joins
the branch before it unless its rate differs significantly from the pooled one. The purity of a branch is its share of
blocked labels, smoothed towards its parent's branch, and so on up to the host and the table's share of blocked rows. A template is rejected
if the purity of its deepest branch is at least one half. The labels are the rules' verdicts; a node without labels has its
parent's purity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_side, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Children of a node beyond which they are one wildcard; how many make one if the given share of them holds digits.
FAN, FEW, DIGITS = 32, 4, 0.9
#: Levels of the tree: deeper segments are one segment together.
DEPTH = 16
#: Weight of a parent's purity in a branch's and of the table's in a host's; the significance of a difference.
TEMPLATE_PRIOR, HOST_PRIOR, Z = 4, 2, 1.96


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path without query and fragment; both empty if the url is null or has no `://`."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls. A rule is (verdict, host/path): it fits the host and its subdomains."""
    rule = verdict = F.lit(None).cast("string")
    for v, text in sorted(rules, key=lambda r: (len(r[1]), len(r[1].partition("/")[0]), r[1])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """The path's segments, an empty one first; slashes at the end don't count."""
    parts = F.split(F.regexp_replace(path, "/+$", ""), "/")
    return F.when(F.size(parts) <= DEPTH + 1, parts).otherwise(F.concat(F.slice(parts, 1, DEPTH), F.array(F.array_join(F.slice(parts, DEPTH + 1, 1 << 30), "/"))))


def templates(counts: DataFrame, depth: int) -> DataFrame:
    """counts(host, path, labelled, blocked) with `segments`, in which variable ones are wildcards: level by level, node by node."""
    out = counts.withColumn("segments", segments(F.col("path")))
    for level in range(1, depth + 1):
        node, own = F.array_join(F.slice("segments", 1, level), "/"), F.get("segments", F.lit(level))
        at = out.withColumn("node", node).withColumn("own", own)
        fan = at.filter("own is not null").groupBy("host", "node", "own").agg(F.lit(1).alias("one")).groupBy("host", "node").agg(F.count("*").alias("fan"), F.count_if(F.col("own").rlike("[0-9]")).alias("digits"))
        wild = stored(fan.filter((F.col("fan") > FAN) | ((F.col("fan") >= FEW) & (F.col("digits") >= DIGITS * F.col("fan")))).select("host", "node", F.lit(True).alias("wild")), "wild")
        changed = F.transform("segments", lambda s, i: F.when((i == F.lit(level)) & F.col("wild"), F.lit("*")).otherwise(s))  # noqa: B023
        out = at.join(small_side(wild, 50_000), ["host", "node"], "left").withColumn("wild", F.coalesce("wild", F.lit(False))).withColumn("segments", changed).drop("node", "own", "wild")
    return out


def _levels(tree: DataFrame, *columns: str) -> DataFrame:
    """Each row of tree(host, segments, ...) once for each level: its node there and the node above."""
    up = lambda i: F.array_join(F.slice("segments", 1, i), "/")
    rows = tree.select("host", "segments", *columns, F.explode(F.sequence(F.lit(0), F.size("segments") - 1)).alias("level"))
    return rows.select("host", "level", up(F.col("level") + 1).alias("node"), F.when(F.col("level") > 0, up(F.greatest("level", F.lit(1)))).alias("parent"), *columns)


def branches(tree: DataFrame) -> DataFrame:
    """(host, level, node, branch, labelled, blocked): of each node with labels, the branch that it is merged into and the branch's sums."""
    nodes = _levels(tree, "labelled", "blocked").groupBy("host", "level", "node", "parent").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")).filter("labelled > 0")
    rate = lambda b, n: (b + 0.5) / (n + 1)
    spread = lambda b, n: rate(b, n) * (1 - rate(b, n)) / (n + 1)
    one = F.struct(rate(F.col("blocked"), F.col("labelled")).alias("rate"), "node", "labelled", "blocked")
    siblings = nodes.groupBy("host", "level", "parent").agg(F.array_sort(F.collect_list(one)).alias("siblings"))  # at most FAN of them

    def step(acc: Column, x: Column) -> Column:
        n, b = acc["labelled"], acc["blocked"]
        apart = (x["rate"] - rate(b, n)) > Z * F.sqrt(spread(b, n) + spread(x["blocked"], x["labelled"]))
        start = apart | (acc["branch"] < 0)
        branch = F.when(start, acc["branch"] + 1).otherwise(acc["branch"])
        member = F.struct(x["node"].alias("node"), branch.alias("branch"), x["labelled"].alias("labelled"), x["blocked"].alias("blocked"))
        return F.struct(
            F.when(start, x["labelled"]).otherwise(n + x["labelled"]).alias("labelled"),
            F.when(start, x["blocked"]).otherwise(b + x["blocked"]).alias("blocked"),
            branch.alias("branch"), F.concat(acc["members"], F.array(member)).alias("members"),
        )

    zero = F.struct(F.lit(0).cast("long").alias("labelled"), F.lit(0).cast("long").alias("blocked"), F.lit(-1).alias("branch"), F.lit([]).cast("array<struct<node:string,branch:int,labelled:bigint,blocked:bigint>>").alias("members"))
    members = siblings.select("host", "level", "parent", F.explode(F.aggregate("siblings", zero, step)["members"]).alias("m")).select("host", "level", "parent", "m.node", "m.branch", "m.labelled", "m.blocked")
    sums = members.groupBy("host", "level", "parent", "branch").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"), F.collect_list("node").alias("nodes"))
    return sums.select("host", "level", F.explode("nodes").alias("node"), "branch", "labelled", "blocked")


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Each row of pages(page_id, url) with host, path, rule, verdict, template and purity.

    The rule's verdict stands; other urls get `block` if their template's purity is at least one half, else `allow`. Null,
    empty and odd urls have an empty host or path and are judged as such. Without any label nothing is blocked.
    """
    host, path = host_and_path()
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, said = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), said.alias("said"))
    counts = stored(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("said").alias("labelled"), F.count_if(F.col("said") == "block").alias("blocked")), "counts")
    everything, blocked, longest = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0)), F.max(F.size(segments(F.col("path"))))).first()
    base = blocked / everything if everything else 0.0  # of all rows, so that rules that only block don't block whatever they leave open
    named = stored(templates(counts, (longest or 1) - 1).withColumn("template", F.array_join("segments", "/")), "named")
    tree = stored(named.groupBy("host", "segments", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")), "tree")
    above = _levels(tree, "template").join(branches(tree), ["host", "level", "node"])
    above = above.groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct("level", "labelled", "blocked"))).alias("above"))  # a row a level

    def smoothed(purity: Column, x: Column) -> Column:
        weight = F.when(x["level"] == 0, F.lit(float(HOST_PRIOR))).otherwise(F.lit(float(TEMPLATE_PRIOR)))
        return (x["blocked"] + weight * purity) / (x["labelled"] + weight)

    purity = stored(tree.select("host", "template").join(above, ["host", "template"], "left").select("host", "template", F.aggregate(F.coalesce("above", F.lit([]).cast("array<struct<level:int,labelled:bigint,blocked:bigint>>")), F.lit(float(base)), smoothed).alias("purity")), "purity")
    verdicts = stored(named.select("host", "path", "template").join(small_side(purity, 50_000), ["host", "template"]), "verdicts")
    out = rows.join(small_side(verdicts, 50_000), ["host", "path"], "left")
    verdict = F.coalesce("said", F.when(F.col("purity") >= 0.5, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", F.round("purity", 6).alias("purity"))


def allowed(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """pages without the rows whose url is judged `block`; all columns stay. Urls are judged once each."""
    bad = judged(pages.select(F.col("url").alias("page_id"), "url").distinct(), rules).filter("verdict = 'block'").select(F.col("page_id").alias("url"))
    return pages.join(bad, pages["url"].eqNullSafe(bad["url"]), "left_anti")
