"""Streaming queries, run to the end of their input, and queries through the SQL front end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import duck_tokens
from tidemark.operators import intervals
from tidemark.plans.sqlfront import Engine
from tidemark.plans.telemetry import DUCK_SAMPLES, HOUR, MATCH_TEXT, TEN, duck_bucket, duck_cover, duck_match, duck_runs, duck_start, duck_telemetry, fx, telemetry
from tidemark.plans.text import CLASSIC, duck_bm25, duck_question
from tidemark.plans.verify import differences
from tidemark.scratch import scratch_path
from tidemark.sources import tables as t
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


def stream(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    """The events' `value` samples as a file stream; with several files, dealt out so that each holds late samples."""
    s = t.samples(spark, sf_dir).filter("path = 'value'")
    path = scratch_path(spark, "arrivals")
    parts = files if files > 1 else 8  # one micro-batch of several files
    s.repartition(parts, F.pmod(F.xxhash64("seq"), F.lit(parts))).write.parquet(path)
    return spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1 if files > 1 else 1000).parquet(path)


def finished(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    out = scratch_path(spark, label)
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "commits")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@query(f"""WITH {DUCK_SAMPLES}, s AS (SELECT * FROM samples WHERE path = 'value' AND num IS NOT NULL), b AS (SELECT entity, {duck_start(duck_bucket('ts', TEN), TEN)} AS start, CAST(sum({fx()}) AS BIGINT) AS cents, min({fx()}) AS lo, max({fx()}) AS hi, count(*) AS n FROM s GROUP BY 1, 2)
SELECT * FROM b WHERE start + INTERVAL 10 MINUTES <= (SELECT max(ts) FROM s) - INTERVAL 30 SECONDS""")
def stream_tumbling(spark, sf_dir):
    """Buckets that the watermark has closed."""
    b = finished(spark, live.closed_buckets(stream(spark, sf_dir), TEN), "buckets")
    return b.select("entity", F.col("start").cast("timestamp_ntz").alias("start"), F.col("total").alias("cents"), "lo", "hi", "n")


@query(f"""WITH {DUCK_SAMPLES} SELECT entity, {duck_bucket('ts', HOUR)} AS bucket, CAST(sum({fx()}) AS BIGINT) AS cents, arg_max({fx()}, (epoch_us(ts), seq)) / 100.0 AS last, count(*) AS n FROM samples WHERE path = 'value' AND num IS NOT NULL GROUP BY 1, 2""")
def stream_late_rewrite(spark, sf_dir):
    """Four micro-batches, three of them late all over: the table is that of one ordered batch."""
    sink = live.LateRewrite(scratch_path(spark, "late"), HOUR)
    q = stream(spark, sf_dir, 4).writeStream.foreachBatch(sink).option("checkpointLocation", scratch_path(spark, "commits")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(sink.table).select("entity", "bucket", F.col("total").alias("cents"), "last", F.col("count").alias("n"))


@query(f"""WITH {DUCK_SAMPLES}, s AS (SELECT *, lag(num) OVER (PARTITION BY entity ORDER BY ts, seq) AS before FROM samples WHERE path = 'value' AND num IS NOT NULL) SELECT entity, ts FROM s WHERE num > 60 AND (before <= 60 OR before IS NULL)""")
def stream_rising_edges(spark, sf_dir):
    sink = live.RisingEdges(scratch_path(spark, "edges"), 60.0)
    q = stream(spark, sf_dir).writeStream.foreachBatch(sink).option("checkpointLocation", scratch_path(spark, "commits")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{sink.edges}/batch=*").select("entity", F.col("ts").cast("timestamp_ntz").alias("ts"))


def engine(spark, sf_dir, width) -> Engine:
    return Engine(spark, telemetry(spark, sf_dir, width), t.docs(spark, sf_dir), width, {"mean": 2, "hi": 2, "lo": 2, "last": 2}, positions=t.positions(spark, sf_dir))


@query(duck_runs(TEN, 2, 3))
def sql_intervals(spark, sf_dir):
    return engine(spark, sf_dir, TEN).sql("""SELECT entity, start, end, buckets FROM intervals('hi > 100.001', min_len => '25.5m', max_gap => '20m')""")


@query(f"""WITH {duck_telemetry(HOUR)}, {t.DUCK_DOCS}, {duck_cover(HOUR)}, hits AS (SELECT DISTINCT entity, bucket FROM cover WHERE kind = 'notes' AND {duck_match('body')})
SELECT t.entity, count(*) AS buckets, max(t.hi) AS hi FROM telemetry t JOIN hits USING (entity, bucket) WHERE t.hi > 20 GROUP BY 1""")
def sql_match(spark, sf_dir):
    return engine(spark, sf_dir, HOUR).sql(f"SELECT entity, count(*) AS buckets, max(hi) AS hi FROM telemetry WHERE match(notes, '{MATCH_TEXT}') AND hi > 20.001 GROUP BY entity")


@query(f"""WITH {t.DUCK_POSITIONS} SELECT entity, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n FROM positions WHERE lat BETWEEN -80 AND -35.5 AND (lon >= 150 OR lon <= -150) GROUP BY 1, 2""")
def sql_geo(spark, sf_dir):
    return engine(spark, sf_dir, HOUR).sql("SELECT entity, date_bin(INTERVAL '1' DAY, ts) AS day, count(*) AS n FROM positions WHERE in_bbox(-80, 150, -35.5, -150) AND within_nm(-60, 180, 10000) GROUP BY 1, 2")


@query(f"""WITH {duck_telemetry(HOUR)} SELECT entity, count(*) AS n FROM telemetry WHERE list_contains(sources, '7') AND mean >= 49.99 GROUP BY 1""")
def sql_membership(spark, sf_dir):
    return engine(spark, sf_dir, HOUR).sql("SELECT entity, count(*) AS n FROM telemetry AS x WHERE sources = '7' AND mean >= 49.98999 GROUP BY entity")


@query(f"""WITH {duck_telemetry(HOUR)} SELECT 'hi > 100.001' AS note, entity, count(*) AS n FROM telemetry WHERE hi > 100.0 AND hi BETWEEN 100.0 AND 140.12 AND mean NOT IN (50.0, 49.99) GROUP BY 2""")
def sql_quantized(spark, sf_dir):
    """Literals on either side, in BETWEEN and IN, are held to the column's digits; text in quotes isn't touched."""
    return engine(spark, sf_dir, HOUR).sql("SELECT 'hi > 100.001' AS note, entity, count(*) AS n FROM telemetry t WHERE 100.001 < t.hi AND hi BETWEEN 100.001 AND 140.1234 AND mean NOT IN (50.0049, 49.98999) GROUP BY entity")


@query(f"""WITH {t.DUCK_DOCS}, {duck_bm25(CLASSIC, 'docs', (('body', 1.0),), 'entity, kind', duck_question({'le': 1, 'der': 1}))}
SELECT d.kind, d.id, round(coalesce(s.score, 0.0), 6) AS score FROM docs d LEFT JOIN scored s ON s.entity = d.entity AND s.kind = d.kind AND s.id = d.id WHERE list_has_any({duck_tokens('body')}, ['le', 'der']) AND NOT list_has_any({duck_tokens('body')}, ['une', 'und']) AND d.kind <> 'alerts'""")
def sql_docs_match(spark, sf_dir):
    """match(body, ...) over documents with its score, and one that leaves documents out."""
    return engine(spark, sf_dir, HOUR).sql("SELECT d.kind, d.id, round(d.score, 6) AS score FROM docs AS d WHERE match(body, 'le OR der') AND NOT match(d.body, 'une und') AND kind <> 'alerts'")


@query(f"""WITH {duck_telemetry(HOUR)}, {t.DUCK_DOCS}, a AS (SELECT entity, count(*) AS buckets, min(bucket) AS first, max(bucket) AS last FROM telemetry GROUP BY 1), b AS (SELECT entity, count(*) AS documents FROM docs GROUP BY 1)
SELECT entity, coalesce(buckets, 0) AS buckets, first, last, coalesce(documents, 0) AS documents FROM a FULL JOIN b USING (entity)""")
def sql_status(spark, sf_dir):
    return engine(spark, sf_dir, HOUR).status()


@query()
def sql_schema(spark, sf_dir):
    return engine(spark, sf_dir, HOUR).schema()


@query(f"""WITH {duck_telemetry(HOUR)} SELECT entity, bucket, hi FROM telemetry WHERE entity = 'type.urn:view' AND hi > 120.5""")
def sql_placeholders(spark, sf_dir):
    """Values given apart from the text, by name."""
    return engine(spark, sf_dir, HOUR).sql("SELECT entity, bucket, hi FROM telemetry WHERE entity = :entity AND hi > :least", {"entity": "type.urn:view", "least": 120.5})


@query(f"""WITH {duck_telemetry(HOUR)} SELECT entity, bucket, 'hi' AS "column", count(*) AS n FROM telemetry WHERE bucket % 50 = 0 AND bucket % 70 <> 1 AND hi IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT entity, bucket, '(row)', 1 FROM telemetry WHERE bucket % 70 = 1""")
def golden_verify(spark, sf_dir):
    """Telemetry against a copy with values off by less than half a digit, values off by more, and rows left out."""
    golden = telemetry(spark, sf_dir, HOUR).select("entity", "bucket", "hi", "lo", "n")
    b = F.col("bucket")
    found = golden.filter(b % 70 != 1).withColumn("hi", F.when(b % 50 == 0, F.col("hi") + 0.02).otherwise(F.col("hi") + 0.004)).withColumn("lo", F.col("lo") - 0.003)
    d = differences(golden, found, ["entity", "bucket"], {"hi": 2, "lo": 2})
    return d.filter("column = '(row)' or bucket % 70 != 1").groupBy("entity", "bucket", "column").agg(F.count("*").alias("n"))


@query(f"""WITH {duck_telemetry(TEN)}, h AS (SELECT entity, bucket, CASE WHEN bucket - lag(bucket) OVER (PARTITION BY entity ORDER BY bucket) > 1 THEN 1 ELSE 0 END AS new FROM telemetry WHERE hi > 80),
r AS (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY bucket) AS run FROM h), e AS (SELECT entity, min(bucket) AS b0 FROM r GROUP BY entity, run),
n AS (SELECT *, row_number() OVER (PARTITION BY date_trunc('hour', {duck_start('b0', TEN)}) ORDER BY b0, entity) AS nth FROM e) SELECT entity, {duck_start('b0', TEN)} AS ts_start FROM n WHERE nth <= 2""")
def alert_cap(spark, sf_dir):
    """Two documents an hour at most, of all entities together."""
    return intervals.episodes(telemetry(spark, sf_dir, TEN), F.col("hi") > 80, TEN, "10m", "cap", F.lit("x"), max_per_hour=2).select("entity", F.col("ts_start").cast("timestamp_ntz").alias("ts_start"))
