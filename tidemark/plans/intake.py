"""Queries of readers, backfill and keyed streams, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import duck_tokens
from tidemark.operators import knowledge, search
from tidemark.plans.live import finished
from tidemark.plans.telemetry import HOUR, duck_bucket, fx
from tidemark.scratch import scratch_path
from tidemark.sources import readers
from tidemark.sources import tables as t
from tidemark.sources.backfill import Backfill
from tidemark.sources.tables import DUCK_POSITIONS, DUCK_SAMPLES, DUCK_SECTIONS
from tidemark.streaming import live

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def naive(c: str) -> F.Column:
    return F.col(c).cast("timestamp_ntz").alias(c)


@query("""SELECT 'order' AS entity, o_orderstatus AS path, CAST(o_orderdate AS TIMESTAMP) AS ts, CAST(o_totalprice AS DOUBLE) AS num FROM orders WHERE o_totalprice IS NOT NULL""")
def mapped_long(spark, sf_dir):
    """Orders as a long table: a metric for each status, clocks in milliseconds."""
    o = t.table(spark, sf_dir, "orders").select(F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("at"), "o_orderstatus", "o_totalprice")
    return readers.mapped(o, "at", "ms", constant="order", metric="o_orderstatus", value="o_totalprice").select("entity", "path", naive("ts"), "num")


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS entity, p.path, CAST(l_shipdate AS TIMESTAMP) AS ts, p.num FROM lineitem, LATERAL (VALUES ('l_quantity', CAST(l_quantity AS DOUBLE)), ('l_tax', CAST(l_tax AS DOUBLE))) AS p(path, num) WHERE p.num IS NOT NULL""")
def mapped_wide(spark, sf_dir):
    """Line items as a wide table: two columns are metrics, one is left out."""
    li = t.table(spark, sf_dir, "lineitem").select("l_orderkey", F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("at"), "l_quantity", "l_tax", "l_linenumber")
    return readers.mapped(li, "at", "us", entity="l_orderkey", exclude=("l_linenumber",)).select("entity", "path", naive("ts"), "num")


@query(f"""WITH {DUCK_POSITIONS} SELECT entity, 'x' AS source, ts, 'pos.latitude' AS path, lat AS num FROM positions WHERE lat IS NOT NULL UNION ALL SELECT entity, 'x', ts, 'pos.longitude', lon FROM positions WHERE lat IS NOT NULL
UNION ALL SELECT entity, 'x', ts, 'pos', CAST(event_id AS DOUBLE) FROM positions WHERE lat IS NULL""")
def influx_points(spark, sf_dir):
    p = t.positions(spark, sf_dir).select(F.lit("pos").alias("measurement"), F.col("entity").alias("context"), F.lit("x").alias("source"), F.col("ts").alias("time"), F.col("event_id").cast("double").alias("value"), "lat", "lon")
    return readers.influx_points(p).select("entity", "source", "ts", "path", "num")


@query("""SELECT source || '/' || doc_id AS file, lang AS tag, chr(10) || chr(10) || chr(10) || chr(10) || text AS text FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND NOT starts_with(text, chr(10))""")
def frontmatter_blank(spark, sf_dir):
    """Documents behind a block of metadata, whose lines stay as blank ones."""
    d = t.table(spark, sf_dir, "documents").filter("text is not null and lang is not null and not startswith(text, '\\n')")
    f = d.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file"), F.concat(F.lit("---\nkind: page\ntag: "), "lang", F.lit("\n---\n"), "text").alias("text"))
    return readers.frontmatter(f).select("file", F.element_at("meta", "tag").alias("tag"), "text")


@query("""SELECT source || '/' || doc_id || '.' || lang AS path FROM documents WHERE lang IS NOT NULL AND NOT (lang = 'de' OR (source = 'src1' AND doc_id % 10 <> 7) OR (lang = 'fr' AND doc_id % 2 = 0 AND source <> 'src0'))""")
def ignored_paths(spark, sf_dir):
    """Ignore rules: by ending, by folder, and one that takes back."""
    d = t.table(spark, sf_dir, "documents").filter("lang is not null")
    p = d.select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang")).alias("path"))
    rules = ["*.de", "src1/", "!src1/*7.en", "!src1/*7.fr", "!src1/*7.es", *[f"*{k}.fr" for k in (0, 2, 4, 6, 8)], *[f"!src0/*{k}.fr" for k in (0, 2, 4, 6, 8)], *[f"src1/*{k}.fr" for k in (0, 1, 2, 3, 4, 5, 6, 8, 9)]]
    return p.filter(~readers.ignored(F.col("path"), rules))


@query("""SELECT 'otel.urn:' || event_type AS entity, date_trunc('second', ts) AS ts_start, 'login' AS title, 'user ' || user_id AS body, count(*) AS n FROM events GROUP BY ALL""")
def otlp_logs(spark, sf_dir):
    """Each event as an OTLP/JSON log record, and back."""
    e = t.table(spark, sf_dir, "events")
    text = lambda c: F.struct(c.alias("stringValue"))
    nanos = (F.unix_seconds(F.col("ts").cast("timestamp")) * 1_000_000_000).cast("string")
    record = F.struct(nanos.alias("timeUnixNano"), F.lit("login").alias("eventName"), text(F.concat(F.lit("user "), F.col("user_id").cast("string"))).alias("body"))
    who = F.struct(F.array(F.struct(F.lit("service.name").alias("key"), text(F.col("event_type")).alias("value"))).alias("attributes"))
    payload = F.struct(F.array(F.struct(who.alias("resource"), F.array(F.struct(F.array(record).alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs"))
    return readers.otlp_logs(e.select(F.to_json(payload).alias("value"))).groupBy("entity", naive("ts_start"), "title", "body").agg(F.count("*").alias("n"))


@query("""SELECT 'vessels.urn:' || event_type AS entity, ts, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 HOUR ELSE ts END AS taken, value AS num FROM events WHERE user_id % 2 = 0 AND NOT (user_id % 10 = 4)""")
def delta_rules(spark, sf_dir):
    """Deltas with clocks that are off, which the time of receipt replaces, and allowed and denied paths and sources."""
    e = t.table(spark, sf_dir, "events")
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    path = F.when(F.col("user_id") % 2 == 0, "nav.speed").otherwise("other.value")
    line = F.concat(F.lit('{"context":"urn:'), "event_type", F.lit('","updates":[{"$source":"s'), (F.col("user_id") % 10).cast("string"), F.lit('","timestamp":"'), stamp, F.lit('","values":[{"path":"'), path, F.lit('","value":'), F.col("value").cast("string"), F.lit("}]}]}"))
    received = F.when(F.col("event_id") % 3 == 0, F.col("ts").cast("timestamp") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("ts").cast("timestamp") + F.expr("INTERVAL 1 MINUTE"))
    d = readers.deltas(e.select(line.alias("value"), received.alias("at"), F.col("ts").alias("own")), F.col("at"), allow=("nav.**",), deny_sources=("s4",), keep=("own",))
    return d.select("entity", F.col("own").alias("ts"), F.col("ts").cast("timestamp_ntz").alias("taken"), "num")


@query(f"""WITH {DUCK_SECTIONS} SELECT id FROM sections WHERE list_contains({duck_tokens('body')}, 'le') AND list_contains({duck_tokens('body')}, 'une') AND n_chars > 500""")
def tag_pruned(spark, sf_dir):
    """Candidates that have both tags of a query."""
    s = t.sections(spark, sf_dir)
    tagged = knowledge.tag_by_table(s, spark.createDataFrame([("le", "LE"), ("une", "UNE"), ("der", "DER")], "phrase string, action string"))
    return knowledge.tag_pruned(s.filter("n_chars > 500").select("id"), tagged, ["LE", "UNE"])


@query()
def resolve_columns(spark, sf_dir):
    """Paths of a catalogue of parts for a phrase with a misspelt word."""
    c = t.table(spark, sf_dir, "part").select(F.concat_ws(".", "p_brand", F.col("p_partkey").cast("string")).alias("path"), F.col("p_name").alias("description"), F.col("p_type").alias("unit"))
    return knowledge.resolve("larg box", c).select("path", F.round("score", 6).alias("score"))


@query(f"""WITH {DUCK_SAMPLES}, s AS (SELECT entity, ts, seq, CASE WHEN CAST(ts AS DATE) = DATE '2024-01-05' THEN num + 1 ELSE num END AS num FROM samples WHERE path = 'value' AND num IS NOT NULL)
SELECT entity, {duck_bucket('ts', HOUR)} AS bucket, CAST(sum({fx()}) AS BIGINT) AS cents, count(*) AS n FROM s GROUP BY 1, 2""")
def backfill_changed(spark, sf_dir):
    """A folder of files is filled in, one file changes, and the second run reads that file alone."""
    s = t.samples(spark, sf_dir).filter("path = 'value'").withColumn("day", F.to_date("ts"))
    source, changed = scratch_path(spark, "files"), F.col("day") == "2024-01-05"
    s.filter(~changed).drop("day").repartition(4, "entity").write.parquet(source)
    s.filter(changed).drop("day").coalesce(1).write.mode("append").parquet(source)
    fill = Backfill(spark, source, scratch_path(spark, "backfill"), HOUR)
    first = fill.run()
    assert len(first) == readers.manifest(spark, source, "*.parquet").count() and fill.run() == []
    holds = spark.read.parquet(source).select(F.col("_metadata.file_path").alias("path"), F.to_date("ts").alias("day")).filter(changed).select("path").distinct()
    _replace(spark, source, [r.path for r in holds.collect()])
    assert set(fill.run()).isdisjoint(first)
    return spark.read.parquet(fill.table).select("entity", "bucket", F.col("total").alias("cents"), F.col("count").alias("n"))


def _replace(spark: SparkSession, source: str, paths: list[str]) -> None:
    """Writes the rows of files anew, each value greater by one on 2024-01-05, and deletes the files."""
    rows = spark.read.parquet(*paths)
    grown = rows.withColumn("num", F.when(F.to_date("ts") == "2024-01-05", F.col("num") + 1).otherwise(F.col("num")))
    grown.write.mode("append").parquet(source)
    fs = spark._jvm.org.apache.hadoop.fs
    for p in paths:
        place = fs.Path(p)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, False)


@query("""WITH p AS (SELECT event_type, event_id, value, CAST(date_trunc('week', ts) AS TIMESTAMP) AS start, ts FROM events WHERE value >= 0)
SELECT event_type AS series, event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id), 4) AS total FROM p""")
def stream_counters(spark, sf_dir):
    """Cumulative readings that start anew each week, as a stream: the growing total at each point."""
    from pyspark.sql import Window

    e = t.table(spark, sf_dir, "events").filter("value >= 0")
    e = e.withColumn("start", F.date_trunc("week", F.col("ts").cast("timestamp")))
    e = e.withColumn("value", F.sum("value").over(Window.partitionBy("event_type", "start").orderBy("ts", "event_id")))
    order = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id"))
    at = F.timestamp_micros(F.unix_micros(F.col("start")) + order.cast("long"))  # distinct clocks, in the same order
    points = e.select(F.col("event_type").alias("series"), at.alias("ts"), "start", "value", F.lit(False).alias("delta"), "event_id")
    path = scratch_path(spark, "points")
    points.drop("event_id").write.parquet(path)
    s = spark.readStream.schema(points.drop("event_id").schema).option("maxFilesPerTrigger", 1000).parquet(path)
    out = finished(spark, live.counter_totals(s), "totals")
    return out.join(points.select("series", "ts", "event_id"), ["series", "ts"]).select("series", "event_id", F.round("total", 4).alias("total"))
