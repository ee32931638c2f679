"""Samples to one row for each entity and time bucket: profiles, set winners, sources, counts and derived events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clock import bucket_of
from tidemark.functions.fixed import from_fixed, out_of_range, to_fixed


def bucketed(samples: DataFrame, width: int) -> DataFrame:
    return samples.withColumn("bucket", bucket_of(F.col("ts"), width))


def profile(samples: DataFrame, width: int, scale: int = 2) -> DataFrame:
    """(entity, path, bucket, mean, min, max, last, count) of numeric samples.

    Sums are exact, in fixed point. The last value is that of the latest ts, then of the latest arrival (seq).
    """
    s = bucketed(samples, width).withColumn("fixed", to_fixed(F.col("num"), scale)).filter("fixed is not null")
    out = s.groupBy("entity", "path", "bucket").agg(F.sum("fixed").alias("total"), F.count("*").alias("count"), F.min("fixed").alias("lo"), F.max("fixed").alias("hi"), F.max_by("fixed", F.struct("ts", "seq")).alias("end"))
    value = lambda c: from_fixed(F.col(c), scale)
    return out.select("entity", "path", "bucket", (value("total") / F.col("count")).alias("mean"), value("lo").alias("min"), value("hi").alias("max"), value("end").alias("last"), "count", "total")


def set_winner(samples: DataFrame, width: int, priority: Sequence[str] = ()) -> DataFrame:
    """(entity, path, bucket, value) of string samples: the source that stands first in priority wins (one not in it ranks with the first), then the later ts, then the later arrival."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[x for i, p in enumerate(priority) for x in (F.lit(p), F.lit(i))]), F.col("source")), F.lit(0)) if priority else F.lit(0)
    s = bucketed(samples, width).filter("str is not null")
    return s.groupBy("entity", "path", "bucket").agg(F.max_by("str", F.struct(-rank, "ts", "seq")).alias("value"))


def source_sets(samples: DataFrame, width: int) -> DataFrame:
    """(entity, path, bucket, sources): the distinct sources, sorted."""
    return bucketed(samples, width).groupBy("entity", "path", "bucket").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def preferred_count(samples: DataFrame, width: int, priority: Sequence[str] = ()) -> DataFrame:
    """(entity, path, bucket, source, events): samples of the most preferred source alone; unlisted sources rank last, and of equals the first to arrive counts."""
    rank = F.lit(len(priority))
    for i, p in enumerate(priority):
        rank = F.when(F.col("source") == p, F.lit(i)).otherwise(rank)
    per = bucketed(samples, width).groupBy("entity", "path", "bucket", "source").agg(F.count("*").alias("events"), F.min("seq").alias("first"))
    best = per.withColumn("rank", rank).groupBy("entity", "path", "bucket").agg(F.min_by(F.struct("source", "events"), F.struct("rank", "first")).alias("b"))
    return best.select("entity", "path", "bucket", "b.source", "b.events")


def _before(column: str) -> Column:
    return F.lag(column).over(Window.partitionBy("entity", "path").orderBy("ts", "seq"))


def transitions(samples: DataFrame, width: int, state: str) -> DataFrame:
    """(entity, path, bucket, starts): changes of a string path into `state`, the first sample included."""
    s = bucketed(samples.filter("str is not null").withColumn("before", _before("str")), width)
    return s.filter((F.col("str") == state) & ((F.col("before") != state) | F.col("before").isNull())).groupBy("entity", "path", "bucket").agg(F.count("*").alias("starts"))


def rising_edges(samples: DataFrame, width: int, threshold: float = 0.0) -> DataFrame:
    """(entity, path, bucket, edges): numeric samples above the threshold after one that wasn't, or after none."""
    s = bucketed(samples.filter("num is not null").withColumn("before", _before("num")), width)
    return s.filter((F.col("num") > threshold) & ((F.col("before") <= threshold) | F.col("before").isNull())).groupBy("entity", "path", "bucket").agg(F.count("*").alias("edges"))


def raises(samples: DataFrame, width: int, calm: Sequence[str] = ("nominal", "normal")) -> DataFrame:
    """(entity, path, bucket, raises): changes of a string path from a calm state, or none, to another."""
    s = bucketed(samples.filter("str is not null").withColumn("before", _before("str")), width)
    quiet = F.col("before").isNull() | F.col("before").isin(*calm)
    return s.filter(quiet & ~F.col("str").isin(*calm)).groupBy("entity", "path", "bucket").agg(F.count("*").alias("raises"))


def skipped(samples: DataFrame, scale: int) -> DataFrame:
    """(entity, path, skipped, stored): finite values too large for the scale, and the others."""
    return samples.filter("num is not null").groupBy("entity", "path").agg(F.count_if(out_of_range(F.col("num"), scale)).alias("skipped"), F.count(to_fixed(F.col("num"), scale)).alias("stored"))


def wide(samples: DataFrame, width: int, scales: Mapping[str, int], sets: Sequence[str] = ()) -> DataFrame:
    """The telemetry table: entity, bucket, `path@mean/min/max/last/count` for numeric paths, a column for each set path, and `$source`.

    One aggregation over conditional columns, so each sample is shuffled at most once, as a partial result.
    """
    s = bucketed(samples, width)
    order = F.struct("ts", "seq")
    aggs: list[Column] = []
    for path, scale in scales.items():
        fixed = F.when(F.col("path") == path, to_fixed(F.col("num"), scale))
        n = F.count(fixed)
        aggs += [
            (from_fixed(F.sum(fixed), scale) / n).alias(f"{path}@mean"), from_fixed(F.min(fixed), scale).alias(f"{path}@min"), from_fixed(F.max(fixed), scale).alias(f"{path}@max"),
            from_fixed(F.max_by(fixed, F.when(fixed.isNotNull(), order)), scale).alias(f"{path}@last"), n.alias(f"{path}@count"),
        ]
    for path in sets:
        value = F.when(F.col("path") == path, F.col("str"))
        aggs.append(F.max_by(value, F.when(value.isNotNull(), order)).alias(path))
    aggs.append(F.array_sort(F.collect_set("source")).alias("$source"))
    return s.groupBy("entity", "bucket").agg(*aggs)


def sticky_paths(samples: DataFrame) -> DataFrame:
    """samples with `path` made type-stable: the first kind that an entity's path shows keeps the name, later kinds get path#2, path#3, in order of arrival."""
    kind = F.when(F.col("num").isNotNull(), "number").when(F.col("str").isNotNull(), "set")
    s = samples.withColumn("kind", kind).filter("kind is not null")
    firsts = s.groupBy("entity", "path", "kind").agg(F.min(F.struct("ts", "seq")).alias("first"))
    version = F.row_number().over(Window.partitionBy("entity", "path").orderBy("first", "kind"))  # at most two kinds
    names = firsts.select("entity", "path", "kind", F.when(version == 1, F.col("path")).otherwise(F.concat("path", F.lit("#"), version)).alias("stable"))
    return s.join(names, ["entity", "path", "kind"]).drop("path", "kind").withColumnRenamed("stable", "path")


def to_long(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Wide rows to (keys, path, num), nulls left out."""
    return df.unpivot([*keys], [*columns], "path", "num").filter("num is not null")


def to_wide(samples: DataFrame, keys: Sequence[str], paths: Sequence[str]) -> DataFrame:
    """Long rows to one column a path: the last value by (ts, seq)."""
    last = lambda p: F.max_by("num", F.when(F.col("path") == p, F.struct("ts", "seq")))
    return samples.filter(F.col("path").isin(*paths)).groupBy(*keys).agg(*[last(p).alias(p) for p in paths])


def fan_out(samples: DataFrame, stores: Mapping[str, tuple[str, int]]) -> dict[str, DataFrame]:
    """Each store's profile of the samples whose path matches its glob, at its own width."""
    return {name: profile(samples.filter(F.col("path").rlike(glob_regex(glob))), width) for name, (glob, width) in stores.items()}


def glob_regex(glob: str) -> str:
    """A path glob as an anchored regular expression: `*` is any run of characters, dots included."""
    return "^" + "".join(".*" if c == "*" else "\\" + c if not c.isalnum() else c for c in glob) + "$"


def entities(samples: DataFrame) -> DataFrame:
    """Catalog: (ord, urn, kind, first_seen, last_seen, samples), numbered by urn."""
    e = samples.groupBy("entity").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("samples"))
    n = F.row_number().over(Window.orderBy("entity")) - 1  # a row an entity
    return e.select(n.cast("long").alias("ord"), F.col("entity").alias("urn"), F.substring_index("entity", ".urn:", 1).alias("kind"), F.col("first_seen").cast("timestamp_ntz").alias("first_seen"), F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), "samples")


def paths(samples: DataFrame) -> DataFrame:
    """Catalog: (path, type, entities, samples, first_seen, last_seen)."""
    kind = F.when(F.count("num") > 0, "number").otherwise("set")
    return samples.groupBy("path").agg(kind.alias("type"), F.countDistinct("entity").alias("entities"), F.count("*").alias("samples"), F.min("ts").cast("timestamp_ntz").alias("first_seen"), F.max("ts").cast("timestamp_ntz").alias("last_seen"))


def shards(samples: DataFrame, width: int) -> DataFrame:
    """Catalog: (entity, shard, buckets, first_bucket, last_bucket): 65,536 buckets to a shard."""
    b = bucketed(samples, width).select("entity", "bucket").distinct()
    return b.groupBy("entity", F.shiftright("bucket", 16).alias("shard")).agg(F.count("*").alias("buckets"), F.min("bucket").alias("first_bucket"), F.max("bucket").alias("last_bucket"))
