"""Facets, retrieval metrics, metadata filters, reconciliation, manifests, retention, document joins."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def facet_field(matches: DataFrame, field: str) -> DataFrame:
    """(value, n, missing): counts of the field's values over all matches, the largest first, then by value; null is the missing row. Array fields count each element."""
    value = F.col(field)
    if isinstance(matches.schema[field].dataType.typeName(), str) and matches.schema[field].dataType.typeName() == "array":
        value = F.explode_outer(field)
    return matches.select(value.cast("string").alias("value")).groupBy("value").agg(F.count("*").alias("n")).select("value", "n", F.col("value").isNull().alias("missing"))


def facet_range(matches: DataFrame, field: str, start: float, end: float, gap: float) -> DataFrame:
    """(slot, lo, n): counts of [lo, lo + gap) from start to end, with slots `before`, `after` and `missing`."""
    v = F.col(field)
    lo = F.floor((v - start) / gap) * gap + start
    slot = F.when(v.isNull(), "missing").when(v < start, "before").when(v >= end, "after").otherwise("range")
    return matches.select(slot.alias("slot"), F.when(slot == "range", lo.cast("double")).alias("lo")).groupBy("slot", "lo").agg(F.count("*").alias("n"))


def facet_query(matches: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """(query, n): how many matches meet each condition, in one pass."""
    counts = matches.agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])
    return counts.unpivot([], [*conditions], "query", "n") if len(conditions) > 1 else counts.select(F.lit(next(iter(conditions))).alias("query"), F.col(next(iter(conditions))).alias("n"))


def metadata_filter(condition: Column, negate: bool = False) -> Column:
    """A filter on metadata is two-valued: a missing value doesn't match, so its negation keeps rows without one."""
    known = F.coalesce(condition, F.lit(False))
    return ~known if negate else known


_CLAUSE = re.compile(r"^(-?)([A-Za-z_]\w*):(.+)$")


def parse_filters(text: str, schema: Sequence[str]) -> tuple[str, list[Column]]:
    """The text without its filters, and these: `field:a,b`, `-field:a`, `field:lo..hi`, `field:>=x` and the other comparisons; only for fields of the schema."""
    rest, out = [], []
    for part in text.split():
        m = _CLAUSE.match(part)
        if not m or m[2] not in schema:
            rest.append(part)
            continue
        c, v = F.col(m[2]), m[3]
        if r := re.fullmatch(r"(.*)\.\.(.*)", v):
            cond = F.lit(True)
            if r[1]:
                cond = cond & (c >= F.lit(r[1]).cast("double"))
            if r[2]:
                cond = cond & (c <= F.lit(r[2]).cast("double"))
        elif r := re.fullmatch(r"(>=|<=|>|<)(.+)", v):
            x = F.lit(r[2]).cast("double")
            cond = {">=": c >= x, "<=": c <= x, ">": c > x, "<": c < x}[r[1]]
        else:
            cond = c.cast("string").isin(*v.split(","))
        out.append(metadata_filter(cond, bool(m[1])))
    return " ".join(rest), out


def ranking_metrics(ranked: DataFrame, k: int) -> DataFrame:
    """ranked(query, rank, gain) to (query, hit, mrr, ndcg): of the first k ranks; the ideal order re-sorts the whole list given."""
    relevant = F.col("gain") > 0
    ideal = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("gain"), "rank"))
    r = ranked.withColumn("ideal", ideal)
    cut = lambda place: F.when(F.col(place) <= k, F.col("gain") / F.log2(F.col(place) + 1.0)).otherwise(F.lit(0.0))
    out = r.groupBy("query").agg(F.max(F.when(relevant & (F.col("rank") <= k), 1).otherwise(0)).alias("hit"), F.min(F.when(relevant, F.col("rank"))).alias("first"), F.sum(cut("rank")).alias("dcg"), F.sum(cut("ideal")).alias("best"))
    return out.select("query", "hit", F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), F.when(F.col("best") > 0, F.col("dcg") / F.col("best")).otherwise(F.lit(0.0)).alias("ndcg"))


def containment(answer: Column, text: Column) -> Column:
    """The share of the answer's distinct tokens that the text holds; null for an answer without tokens."""
    return F.when(F.size(answer) > 0, F.size(F.array_intersect(answer, text)) / F.size(F.array_distinct(answer)))


def reconcile(old: DataFrame, new: DataFrame, key: Sequence[str], owned: Column) -> DataFrame:
    """The table after a full snapshot of the owned rows: rows of `new` replace or join, owned rows that it lacks go, the others stay. `action` says which."""
    a, b = old.withColumn("__own", owned).alias("a"), new.alias("b")
    values = [c for c in old.columns if c not in key]
    joined = a.join(b, list(key), "full")
    there, here = F.col("a.__own").isNotNull(), F.coalesce(*[F.col(f"b.{c}").cast("string") for c in values]).isNotNull()
    same = F.lit(True)
    for c in values:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    action = F.when(~there, "insert").when(here & same, "keep").when(here, "update").when(F.col("a.__own"), "delete").otherwise("other")
    return joined.select(*key, action.alias("action"), *[F.when(here, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in values])


def manifest_diff(remote: DataFrame, local: DataFrame, key: Sequence[str] = ("entity", "shard")) -> DataFrame:
    """Shards to fetch: (key..., version, hash, reason) for those missing here, older here, or of another content."""
    l = local.select(*key, F.col("version").alias("own_version"), F.col("hash").alias("own_hash"))  # noqa: E741
    why = F.when(F.col("own_version").isNull(), "missing").when(F.col("own_version") < F.col("version"), "older").when((F.col("own_version") == F.col("version")) & (F.col("own_hash") != F.col("hash")), "different")
    return remote.join(l, list(key), "left").withColumn("reason", why).filter("reason is not null").select(*key, "version", "hash", "reason")


def retained(shards: DataFrame, now: Column, keep_seconds: int) -> DataFrame:
    """shards(sealed, ts_to, ...) without sealed ones that end at or before now - keep_seconds; open ones always stay."""
    return shards.filter(~(F.col("sealed") & (F.unix_micros(F.col("ts_to").cast("timestamp")) <= F.unix_micros(now.cast("timestamp")) - keep_seconds * 1_000_000)))


def docs_in_range(telemetry: DataFrame, docs: DataFrame, covered: DataFrame) -> DataFrame:
    """telemetry joined to the documents that cover its bucket: an equi join on (entity, bucket), where a range join would compare all pairs."""
    return telemetry.join(covered.select("entity", "bucket", "id"), ["entity", "bucket"]).join(docs.select("id", "kind", "title"), "id")
