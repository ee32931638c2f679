"""Samples, documents, positions and sections over the driver's tables, and the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATES = ((50, "low"), (100, "mid"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, path, source, ts, seq, num, str): a numeric path `value`, a numeric path `props.k` and a set path `state`."""
    e = table(spark, sf_dir, "events").select(
        F.concat(F.lit("type.urn:"), "event_type").alias("entity"), F.col("user_id").cast("string").alias("source"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
        F.col("value").alias("value"), F.get_json_object("props", "$.k").cast("double").alias("k"),
    )
    state = F.when(F.col("value") < 50, "low").when(F.col("value") < 100, "mid").otherwise("high")
    none = F.lit(None)
    parts = F.array(
        F.struct(F.lit("value").alias("path"), F.col("value").alias("num"), none.cast("string").alias("str")),
        F.struct(F.lit("props.k").alias("path"), F.col("k").alias("num"), none.cast("string").alias("str")),
        F.struct(F.lit("state").alias("path"), none.cast("double").alias("num"), state.alias("str")),
    )
    return e.select("entity", "source", "ts", "seq", F.explode(parts).alias("p")).select("entity", "p.path", "source", "ts", "seq", "p.num", "p.str")


#: DuckDB twins, as common table expressions.
DUCK_SAMPLES = """samples AS (
  SELECT 'type.urn:' || event_type AS entity, p.path AS path, CAST(user_id AS VARCHAR) AS source, ts, event_id AS seq, p.num AS num, p.str AS str
  FROM events, LATERAL (VALUES ('value', value, NULL),
    ('props.k', CAST(json_extract_string(props, '$.k') AS DOUBLE), NULL),
    ('state', NULL, CASE WHEN value < 50 THEN 'low' WHEN value < 100 THEN 'mid' ELSE 'high' END)) AS p(path, num, str))"""


def duck_bucket(ts: str, width: int) -> str:
    return f"((epoch_us({ts}) // 1000000 - 1577836800) // {width})"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, entity, kind, ts_start, ts_end, title, body): documents laid over the events' month by arithmetic on doc_id."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(hours=F.pmod(i, F.lit(700)).cast("int"))
    entity = F.element_at(F.array(*[F.lit(f"type.urn:{x}") for x in ("click", "error", "purchase", "signup", "view")]), (F.pmod(i, F.lit(5)) + 1).cast("int"))
    kind = F.element_at(F.array(F.lit("notes"), F.lit("logbook"), F.lit("alerts")), (F.pmod(i, F.lit(3)) + 1).cast("int"))
    end = F.when(i % 7 != 0, start + F.expr("INTERVAL 6 HOURS"))
    return d.select(i.alias("id"), entity.alias("entity"), kind.alias("kind"), start.alias("ts_start"), end.alias("ts_end"), F.substring("text", 1, 40).alias("title"), F.col("text").alias("body"))


DUCK_DOCS = """docs AS (
  SELECT doc_id AS id, 'type.urn:' || (['click','error','purchase','signup','view'])[CAST(doc_id % 5 + 1 AS INT)] AS entity,
    (['notes','logbook','alerts'])[CAST(doc_id % 3 + 1 AS INT)] AS kind,
    TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 700 AS INT)) AS ts_start,
    CASE WHEN doc_id % 7 <> 0 THEN TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 700 AS INT)) + INTERVAL 6 HOURS END AS ts_end,
    substr(text, 1, 40) AS title, text AS body
  FROM documents)"""


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, entity, ts, lat, lon): a place for each event by arithmetic on user_id; every 11th event has none."""
    e, u = table(spark, sf_dir, "events"), F.col("user_id")
    lat, lon = (u * 37) % 1700 / 10.0 - 85, (u * 71) % 3600 / 10.0 - 180
    gone = F.col("event_id") % 11 == 0
    return e.select("event_id", F.concat(F.lit("type.urn:"), "event_type").alias("entity"), "ts", F.when(~gone, lat).alias("lat"), F.when(~gone, lon).alias("lon"))


DUCK_POSITIONS = """positions AS (
  SELECT event_id, 'type.urn:' || event_type AS entity, ts,
    CASE WHEN event_id % 11 <> 0 THEN (user_id * 37) % 1700 / 10.0 - 85 END AS lat,
    CASE WHEN event_id % 11 <> 0 THEN (user_id * 71) % 3600 / 10.0 - 180 END AS lon
  FROM events)"""


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, file, title, line, body, lang, source, n_chars): documents as passages; the title is the first line."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file"), F.substring_index("text", "\n", 1).alias("title"), F.lit(1).cast("long").alias("line"), F.col("text").alias("body"), "lang", "source", "n_chars")


DUCK_SECTIONS = """sections AS (
  SELECT doc_id AS id, source || '/' || doc_id AS file, string_split(text, chr(10))[1] AS title, CAST(1 AS BIGINT) AS line, text AS body, lang, source, n_chars
  FROM documents)"""
