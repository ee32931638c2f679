"""Runs of buckets in which a condition holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clock import bucket_start, duration_ns


def intervals(telemetry: DataFrame, predicate: Column, width: int, min_len: str = "0s", max_gap: str = "0s", entity: str | None = None, by: str = "entity") -> DataFrame:
    """(entity, start, end, buckets): runs of buckets where predicate is true; [start, end) half open.

    Runs whose gap is at most max_gap are one; then those shorter than min_len go. `buckets` leaves out what a gap
    bridged. telemetry holds (entity, bucket), one row each; a null predicate is not true.
    """
    gap, least, w_ns = duration_ns(max_gap), duration_ns(min_len), width * 10**9
    hits = telemetry.filter(predicate).select(by, "bucket")
    if entity is not None:
        hits = hits.filter(F.col(by) == entity)
    w = Window.partitionBy(by).orderBy("bucket")
    # (b - before - 1) * width > gap, in whole buckets
    starts = F.when(F.col("bucket") - F.lag("bucket").over(w) - 1 > gap // w_ns, 1).otherwise(0)
    runs = hits.withColumn("new", starts).withColumn("run", F.sum("new").over(w)).groupBy(by, "run").agg(F.min("bucket").alias("b0"), F.max("bucket").alias("b1"), F.count("*").alias("buckets"))
    runs = runs.filter(F.col("b1") - F.col("b0") + 1 >= -(-least // w_ns))
    return runs.select(by, bucket_start(F.col("b0"), width).alias("start"), bucket_start(F.col("b1") + 1, width).alias("end"), "buckets")


def episodes(telemetry: DataFrame, predicate: Column, width: int, hold: str, rule: str, message: Column, max_per_hour: int = 60) -> DataFrame:
    """Alert documents of a rule: (id, entity, kind, ts_start, ts_end, title, body).

    An episode is a run of adjacent true buckets; it opens once it has lasted `hold`. The message is that of the opening
    bucket. Within an hour of opening times the first max_per_hour episodes of all entities raise a document.
    """
    need = max(1, -(-duration_ns(hold) // (width * 10**9)))
    w = Window.partitionBy("entity").orderBy("bucket")
    hits = telemetry.filter(predicate).select("entity", "bucket", message.alias("message"))
    fresh = F.coalesce(F.col("bucket") - F.lag("bucket").over(w) > 1, F.lit(True))
    hits = hits.withColumn("fresh", fresh).withColumn("b0", F.max(F.when(F.col("fresh"), F.col("bucket"))).over(w))
    opening = F.max(F.when(F.col("bucket") == F.col("b0") + need - 1, F.col("message")))
    runs = hits.groupBy("entity", "b0").agg(F.max("bucket").alias("b1"), opening.alias("message"))
    opened = runs.filter(F.col("b1") - F.col("b0") + 1 >= need).withColumn("opening", F.col("b0") + need - 1)
    opened = opened.withColumn("at", bucket_start(F.col("opening"), width)).withColumn("nth", F.row_number().over(Window.partitionBy(F.date_trunc("hour", "at")).orderBy("opening", "entity")))
    shown = opened.filter(F.col("nth") <= max_per_hour)
    start = bucket_start(F.col("b0"), width)
    return shown.select(
        F.concat(F.lit(f"rules/{rule}/"), F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("id"), "entity", F.lit("alerts").alias("kind"), start.alias("ts_start"), bucket_start(F.col("b1") + 1, width).alias("ts_end"),
        F.lit(rule).alias("title"), F.col("message").alias("body"),
    )


def notifications(samples: DataFrame, calm: tuple[str, ...] = ("normal", "nominal")) -> DataFrame:
    """Alert documents of a state path: (id, entity, kind, ts_start, ts_end, states): from the first state that isn't calm to the next calm one.

    An escalation stays in its document; one that never calms has no end; one that calms within the second is a point.
    """
    w = Window.partitionBy("entity", "path").orderBy("ts", "seq")
    s = samples.filter("str is not null").withColumn("quiet", F.col("str").isin(*calm)).withColumn("before", F.coalesce(F.lag("quiet").over(w), F.lit(True)))
    s = s.withColumn("episode", F.sum(F.when(~F.col("quiet") & F.col("before"), 1).otherwise(0)).over(w)).filter((F.col("episode") > 0) & (~F.col("quiet") | ~F.col("before")))
    out = s.groupBy("entity", "path", "episode").agg(F.min("ts").alias("a"), F.max(F.when(F.col("quiet"), F.col("ts"))).alias("b"), F.count_if(~F.col("quiet")).alias("states"))
    start, end = F.date_trunc("second", "a"), F.date_trunc("second", "b")
    stamp = F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return out.select(F.concat(F.lit("notifications/"), "path", F.lit("/"), stamp).alias("id"), "entity", F.lit("alerts").alias("kind"), start.cast("timestamp_ntz").alias("ts_start"), F.when(end > start, end).cast("timestamp_ntz").alias("ts_end"), "states")


def counter_totals(points: DataFrame, keys: list[str]) -> DataFrame:
    """points(keys..., ts, start, value, delta) with `total`: cumulative counters as one growing number.

    A delta adds its value. A cumulative value counts from its own start; when the start changes, what was reached before
    is kept underneath. Rows with equal (ts, start, value) are retries and count once. A fall without a new start is an error.
    """
    p = points.dropDuplicates([*keys, "ts", "start", "value"])
    w = Window.partitionBy(*keys).orderBy("ts", "start")
    p = p.withColumn("reset", F.coalesce(~F.col("delta") & (F.col("start") != F.lag("start").over(w)), F.lit(False)))
    p = p.withColumn("grown", F.when(F.col("delta") | F.col("reset") | F.lag("value").over(w).isNull(), F.col("value")).otherwise(F.col("value") - F.lag("value").over(w)))
    bad = F.raise_error(F.lit("a counter fell without a new start")).cast("double")
    p = p.withColumn("grown", F.when(F.col("grown") < 0, bad).otherwise(F.col("grown")))
    return p.withColumn("total", F.sum("grown").over(w)).drop("reset", "grown")
