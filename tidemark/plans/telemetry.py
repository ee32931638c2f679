"""Queries over buckets, runs, places and documents, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import clock, geo
from tidemark.functions.fixed import quantized
from tidemark.operators import buckets, intervals, relations, search
from tidemark.sources import tables as t
from tidemark.sources.tables import DUCK_DOCS, DUCK_POSITIONS, DUCK_SAMPLES, duck_bucket

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

HOUR, TEN = 3600, 600
NTZ = "timestamp_ntz"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def fx(c: str = "num", scale: int = 2) -> str:
    return f"CAST(round({c} * {10**scale}) AS BIGINT)"


def telemetry(spark: SparkSession, sf_dir: str, width: int) -> DataFrame:
    """(entity, bucket, mean, lo, hi, last, n, state, sources) of the events."""
    s = t.samples(spark, sf_dir)
    w = buckets.wide(s, width, {"value": 2}, ["state"])
    return w.select("entity", "bucket", F.col("`value@mean`").alias("mean"), F.col("`value@min`").alias("lo"), F.col("`value@max`").alias("hi"), F.col("`value@last`").alias("last"), F.col("`value@count`").alias("n"), "state", F.col("`$source`").alias("sources"))


def duck_telemetry(width: int) -> str:
    return f"""{DUCK_SAMPLES}, telemetry AS (
  SELECT entity, {duck_bucket('ts', width)} AS bucket,
    CAST(sum({fx()}) FILTER (path = 'value') AS DOUBLE) / 100.0 / count(num) FILTER (path = 'value') AS mean,
    min({fx()}) FILTER (path = 'value') / 100.0 AS lo, max({fx()}) FILTER (path = 'value') / 100.0 AS hi,
    arg_max({fx()}, (epoch_us(ts), seq)) FILTER (path = 'value' AND num IS NOT NULL) / 100.0 AS last,
    count(num) FILTER (path = 'value') AS n,
    arg_max(str, (epoch_us(ts), seq)) FILTER (path = 'state') AS state,
    list_sort(list_distinct(list(source))) AS sources
  FROM samples GROUP BY ALL)"""


def duck_start(b: str, width: int) -> str:
    return f"make_timestamp(CAST(({b} * {width} + 1577836800) * 1000000 AS BIGINT))"


_PROFILE = f"""WITH {DUCK_SAMPLES} SELECT entity, path, {duck_bucket('ts', HOUR)} AS bucket,
  round(CAST(sum({fx()}) AS DOUBLE) / 100.0 / count(*), 6) AS mean, min({fx()}) / 100.0 AS lo, max({fx()}) / 100.0 AS hi,
  arg_max({fx()}, (epoch_us(ts), seq)) / 100.0 AS last, count(*) AS n
FROM samples WHERE num IS NOT NULL GROUP BY 1, 2, 3"""


@query(_PROFILE)
def bucket_profile(spark, sf_dir):
    p = buckets.profile(t.samples(spark, sf_dir), HOUR)
    return p.select("entity", "path", "bucket", F.round("mean", 6).alias("mean"), F.col("min").alias("lo"), F.col("max").alias("hi"), "last", F.col("count").alias("n"))


@query(f"""WITH {DUCK_SAMPLES} SELECT entity, {duck_bucket('ts', 86400)} AS bucket,
  arg_max({fx()}, (date_trunc('day', ts), seq)) / 100.0 AS last FROM samples WHERE path = 'value' AND num IS NOT NULL GROUP BY 1, 2""")
def bucket_last_ties(spark, sf_dir):
    """All samples of a day at one time: the last to arrive wins."""
    s = t.samples(spark, sf_dir).filter("path = 'value'").withColumn("ts", F.date_trunc("day", "ts"))
    return buckets.profile(s, 86400).select("entity", "bucket", "last")


@query(f"""WITH {DUCK_SAMPLES} SELECT entity, {duck_bucket('ts', HOUR)} AS bucket,
  arg_max(str, (CASE source WHEN '7' THEN 0 WHEN '11' THEN -1 WHEN '3' THEN -2 ELSE 0 END, epoch_us(ts), seq)) AS value
FROM samples WHERE str IS NOT NULL GROUP BY 1, 2""")
def set_winner(spark, sf_dir):
    return buckets.set_winner(t.samples(spark, sf_dir), HOUR, ("7", "11", "3")).select("entity", "bucket", "value")


@query(f"""WITH {DUCK_SAMPLES} SELECT entity, path, {duck_bucket('ts', HOUR)} AS bucket, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM samples GROUP BY 1, 2, 3""")
def source_sets(spark, sf_dir):
    return buckets.source_sets(t.samples(spark, sf_dir), HOUR).select("entity", "path", "bucket", F.array_join("sources", ",").alias("sources"))


@query(f"""WITH {DUCK_SAMPLES}, per AS (SELECT entity, {duck_bucket('ts', 86400)} AS bucket, source, count(*) AS events, min(seq) AS first FROM samples WHERE path = 'value' GROUP BY 1, 2, 3)
SELECT entity, bucket, arg_min(source, (CASE source WHEN '5' THEN 0 WHEN '9' THEN 1 ELSE 2 END, first)) AS source, arg_min(events, (CASE source WHEN '5' THEN 0 WHEN '9' THEN 1 ELSE 2 END, first)) AS events FROM per GROUP BY 1, 2""")
def event_count_preferred(spark, sf_dir):
    return buckets.preferred_count(t.samples(spark, sf_dir).filter("path = 'value'"), 86400, ("5", "9")).select("entity", "bucket", "source", "events")


@query(f"""WITH {DUCK_SAMPLES}, s AS (SELECT *, lag(str) OVER (PARTITION BY entity, path ORDER BY ts, seq) AS before FROM samples WHERE str IS NOT NULL)
SELECT entity, path, {duck_bucket('ts', HOUR)} AS bucket, count(*) AS starts FROM s WHERE str = 'high' AND (before <> 'high' OR before IS NULL) GROUP BY 1, 2, 3""")
def derived_transitions(spark, sf_dir):
    return buckets.transitions(t.samples(spark, sf_dir), HOUR, "high")


@query(f"""WITH {DUCK_SAMPLES}, s AS (SELECT *, lag(num) OVER (PARTITION BY entity, path ORDER BY ts, seq) AS before FROM samples WHERE num IS NOT NULL)
SELECT entity, path, {duck_bucket('ts', HOUR)} AS bucket, count(*) AS edges FROM s WHERE num > 60 AND (before <= 60 OR before IS NULL) GROUP BY 1, 2, 3""")
def derived_rising_edges(spark, sf_dir):
    return buckets.rising_edges(t.samples(spark, sf_dir), HOUR, 60.0)


@query(f"""WITH {DUCK_SAMPLES}, s AS (SELECT *, lag(str) OVER (PARTITION BY entity, path ORDER BY ts, seq) AS before FROM samples WHERE str IS NOT NULL)
SELECT entity, path, {duck_bucket('ts', HOUR)} AS bucket, count(*) AS raises FROM s WHERE str NOT IN ('low') AND (before IS NULL OR before = 'low') GROUP BY 1, 2, 3""")
def derived_raises(spark, sf_dir):
    return buckets.raises(t.samples(spark, sf_dir), HOUR, ("low",))


@query(f"""WITH {DUCK_SAMPLES}, s AS (SELECT entity, path, CASE WHEN seq % 10 = 0 THEN num * 1e17 ELSE num END AS num FROM samples WHERE num IS NOT NULL)
SELECT entity, path, count(*) FILTER (abs(round(num * 100)) >= 4611686018427387904.0) AS skipped, count(*) FILTER (abs(round(num * 100)) < 4611686018427387904.0) AS stored FROM s GROUP BY 1, 2""")
def skipped_magnitude(spark, sf_dir):
    s = t.samples(spark, sf_dir).withColumn("num", F.when(F.col("seq") % 10 == 0, F.col("num") * 1e17).otherwise(F.col("num")))
    return buckets.skipped(s, 2)


@query(f"""WITH {DUCK_SAMPLES} SELECT entity, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, arg_max(num, (epoch_us(ts), seq)) FILTER (path = 'value') AS value, arg_max(num, (epoch_us(ts), seq)) FILTER (path = 'props.k') AS k
FROM samples WHERE path IN ('value', 'props.k') GROUP BY 1, 2""")
def long_to_wide(spark, sf_dir):
    s = t.samples(spark, sf_dir).withColumn("day", F.date_trunc("day", "ts").cast(NTZ))
    return buckets.to_wide(s, ["entity", "day"], ["value", "props.k"]).select("entity", "day", "value", F.col("`props.k`").alias("k"))


@query("""SELECT p_partkey, x.path AS path, CAST(x.num AS DOUBLE) AS num FROM part, LATERAL (VALUES ('p_size', CAST(p_size AS DOUBLE)), ('p_retailprice', p_retailprice)) AS x(path, num) WHERE x.num IS NOT NULL""")
def wide_to_long(spark, sf_dir):
    p = t.table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return buckets.to_long(p, ["p_partkey"], ["p_size", "p_retailprice"])


@query(f"""WITH {DUCK_SAMPLES}, e AS (SELECT entity, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS samples FROM samples GROUP BY 1)
SELECT row_number() OVER (ORDER BY entity) - 1 AS ord, entity AS urn, string_split(entity, '.urn:')[1] AS kind, first_seen, last_seen, samples FROM e""")
def catalog_entities(spark, sf_dir):
    return buckets.entities(t.samples(spark, sf_dir))


@query(f"""WITH {DUCK_SAMPLES} SELECT path, CASE WHEN count(num) > 0 THEN 'number' ELSE 'set' END AS type, count(DISTINCT entity) AS entities, count(*) AS samples, min(ts) AS first_seen, max(ts) AS last_seen FROM samples GROUP BY 1""")
def catalog_paths(spark, sf_dir):
    return buckets.paths(t.samples(spark, sf_dir))


@query(f"""WITH {DUCK_SAMPLES}, b AS (SELECT DISTINCT entity, {duck_bucket('ts', 10)} AS bucket FROM samples)
SELECT entity, bucket >> 16 AS shard, count(*) AS buckets, min(bucket) AS first_bucket, max(bucket) AS last_bucket FROM b GROUP BY 1, 2""")
def catalog_shards(spark, sf_dir):
    return buckets.shards(t.samples(spark, sf_dir), 10)


@query("""SELECT event_id, 'props.' || k AS path, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events) WHERE json_extract_string(props, '$.' || k) IS NOT NULL""")
def json_flatten(spark, sf_dir):
    e = t.table(spark, sf_dir, "events").select("event_id", F.explode(F.map_entries(F.from_json("props", "map<string,string>"))).alias("p"))
    return e.select("event_id", F.concat(F.lit("props."), F.col("p.key")).alias("path"), F.col("p.value").alias("value")).filter("value is not null")


@query(f"""WITH {DUCK_SAMPLES}, s AS (SELECT entity, ts, seq, 'mixed' AS path, CASE WHEN seq % 3 = 0 THEN num END AS num, CASE WHEN seq % 3 <> 0 THEN 'x' END AS str FROM samples WHERE path = 'value'),
f AS (SELECT entity, CASE WHEN num IS NOT NULL THEN 'number' ELSE 'set' END AS kind, min((epoch_us(ts), seq)) AS first, count(*) AS n FROM s GROUP BY 1, 2)
SELECT entity, CASE WHEN row_number() OVER (PARTITION BY entity ORDER BY first) = 1 THEN 'mixed' ELSE 'mixed#' || row_number() OVER (PARTITION BY entity ORDER BY first) END AS path, kind, n FROM f""")
def sticky_types(spark, sf_dir):
    s = t.samples(spark, sf_dir).filter("path = 'value'").select("entity", "ts", "seq", F.lit("mixed").alias("path"), F.when(F.col("seq") % 3 == 0, F.col("num")).alias("num"), F.when(F.col("seq") % 3 != 0, F.lit("x")).alias("str"))
    s = buckets.sticky_paths(s)
    return s.groupBy("entity", "path", F.when(F.col("num").isNotNull(), "number").otherwise("set").alias("kind")).agg(F.count("*").alias("n"))


@query(f"""WITH {DUCK_SAMPLES} SELECT 'slow' AS store, entity, path, {duck_bucket('ts', 86400)} AS bucket, count(*) AS n FROM samples WHERE num IS NOT NULL GROUP BY 1, 2, 3, 4
UNION ALL SELECT 'props', entity, path, {duck_bucket('ts', HOUR)}, count(*) FROM samples WHERE num IS NOT NULL AND path LIKE 'props.%' GROUP BY 1, 2, 3, 4""")
def store_fan_out(spark, sf_dir):
    out = buckets.fan_out(t.samples(spark, sf_dir), {"slow": ("*", 86400), "props": ("props.*", HOUR)})
    parts = [d.select(F.lit(n).alias("store"), "entity", "path", "bucket", F.col("count").alias("n")) for n, d in out.items()]
    return parts[0].unionByName(parts[1])


# runs of buckets

def runs(spark, sf_dir, width, **how):
    x = telemetry(spark, sf_dir, width)
    return intervals.intervals(x, F.col("hi") > quantized(100.0, 2), width, **how)


def duck_runs(width: int, gap: int = 0, least: int = 0, where: str = "hi > 100") -> str:
    return f"""WITH {duck_telemetry(width)}, h AS (SELECT entity, bucket, CASE WHEN bucket - lag(bucket) OVER (PARTITION BY entity ORDER BY bucket) - 1 > {gap} THEN 1 ELSE 0 END AS new FROM telemetry WHERE {where}),
r AS (SELECT entity, bucket, sum(new) OVER (PARTITION BY entity ORDER BY bucket) AS run FROM h)
SELECT entity, {duck_start('min(bucket)', width)} AS start, {duck_start('(max(bucket) + 1)', width)} AS "end", count(*) AS buckets FROM r GROUP BY entity, run HAVING max(bucket) - min(bucket) + 1 >= {least}"""


@query(duck_runs(HOUR, 0, 2))
def flagship_runs(spark, sf_dir):
    """Runs of at least two hourly buckets whose largest value exceeds 100."""
    return runs(spark, sf_dir, HOUR, min_len="2h")


@query(duck_runs(TEN))
def intervals_basic(spark, sf_dir):
    return runs(spark, sf_dir, TEN)


@query(duck_runs(TEN, 2, 3))
def intervals_gap(spark, sf_dir):
    return runs(spark, sf_dir, TEN, max_gap="20m", min_len="25.5m")


@query(duck_runs(HOUR, 1, 0, "hi > 100 AND entity = 'type.urn:view'"))
def intervals_entity(spark, sf_dir):
    return runs(spark, sf_dir, HOUR, max_gap="1h", entity="type.urn:view")


@query(f"""WITH {duck_telemetry(HOUR)}, h AS (SELECT entity, bucket, 'max ' || hi AS message, CASE WHEN bucket - lag(bucket) OVER (PARTITION BY entity ORDER BY bucket) > 1 THEN 1 ELSE 0 END AS new FROM telemetry WHERE hi > 100),
r AS (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY bucket) AS run FROM h),
e AS (SELECT entity, min(bucket) AS b0, max(bucket) AS b1, list(message ORDER BY bucket) AS m FROM r GROUP BY entity, run HAVING max(bucket) - min(bucket) + 1 >= 2)
SELECT 'rules/high/' || strftime({duck_start('b0', HOUR)}, '%Y-%m-%dT%H:%M:%SZ') AS id, entity, 'alerts' AS kind, {duck_start('b0', HOUR)} AS ts_start, {duck_start('(b1 + 1)', HOUR)} AS ts_end, 'high' AS title, m[2] AS body FROM e""")
def alert_episodes(spark, sf_dir):
    """A rule that fires once the hourly maximum has exceeded 100 for two hours."""
    return intervals.episodes(telemetry(spark, sf_dir, HOUR), F.col("hi") > 100, HOUR, "2h", "high", F.concat(F.lit("max "), F.col("hi").cast("string")))


@query(f"""WITH {DUCK_SAMPLES}, s AS (SELECT entity, ts, seq, str = 'low' AS quiet, lag(str = 'low', 1, true) OVER (PARTITION BY entity ORDER BY ts, seq) AS before FROM samples WHERE path = 'state'),
e AS (SELECT *, sum(CASE WHEN NOT quiet AND before THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY ts, seq) AS episode FROM s),
g AS (SELECT entity, episode, min(ts) AS a, max(CASE WHEN quiet THEN ts END) AS b, count(*) FILTER (NOT quiet) AS states FROM e WHERE episode > 0 AND (NOT quiet OR NOT before) GROUP BY 1, 2)
SELECT 'notifications/state/' || strftime(date_trunc('second', a), '%Y-%m-%dT%H:%M:%SZ') AS id, entity, 'alerts' AS kind, CAST(date_trunc('second', a) AS TIMESTAMP) AS ts_start,
  CASE WHEN date_trunc('second', b) > date_trunc('second', a) THEN CAST(date_trunc('second', b) AS TIMESTAMP) END AS ts_end, states FROM g""")
def notification_docs(spark, sf_dir):
    return intervals.notifications(t.samples(spark, sf_dir).filter("path = 'state'"), ("low",))


@query("""SELECT event_type, event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id), 4) AS total FROM events WHERE value >= 0""")
def counter_totals(spark, sf_dir):
    """Cumulative readings that start anew each week, put together to one growing total."""
    from pyspark.sql import Window

    e = t.table(spark, sf_dir, "events").filter("value >= 0")
    week = F.date_trunc("week", F.col("ts").cast("timestamp"))
    e = e.withColumn("start", week).withColumn("reading", F.sum("value").over(Window.partitionBy("event_type", "start").orderBy("ts", "event_id")))
    order = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id"))
    at = F.timestamp_micros(F.unix_micros("start") + order.cast("long"))  # distinct clocks, in the same order
    c = intervals.counter_totals(e.select("event_type", "event_id", at.alias("ts"), "start", F.col("reading").alias("value"), F.lit(False).alias("delta")), ["event_type"])
    return c.select("event_type", "event_id", F.round("total", 4).alias("total"))


# strides of time

@query("""SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2024-01-01 01:00:00') AS bin, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1""")
def date_bin_origin(spark, sf_dir):
    b = clock.date_bin(F.col("ts"), 6 * HOUR, 1704070800)
    return t.table(spark, sf_dir, "events").groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


@query("""SELECT CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP) AS bin, count(*) AS n FROM orders GROUP BY 1""")
def date_bin_month(spark, sf_dir):
    return t.table(spark, sf_dir, "orders").groupBy(clock.month_bin(F.col("o_orderdate"), 3).alias("bin")).agg(F.count("*").alias("n"))


# places

def duck_distance(lat0: float, lon0: float) -> str:
    a = f"pow(sin(radians(lat - {lat0}) / 2), 2) + cos(radians(lat)) * cos(radians({lat0})) * pow(sin(radians(lon - {lon0}) / 2), 2)"
    return f"2 * 3440.065 * asin(sqrt(CASE WHEN {a} > 1 THEN 1.0 ELSE {a} END))"


@query(f"""WITH {DUCK_POSITIONS} SELECT event_id, round({duck_distance(-60.0, -150.0)}, 3) AS nm FROM positions WHERE round({duck_distance(-60.0, -150.0)}, 9) <= 1500""")
def within_nm(spark, sf_dir):
    p = t.positions(spark, sf_dir)
    return p.filter(geo.within_nm(F.col("lat"), F.col("lon"), -60.0, -150.0, 1500.0)).select("event_id", F.round(geo.distance_nm(F.col("lat"), F.col("lon"), -60.0, -150.0), 3).alias("nm"))


@query(f"""WITH {DUCK_POSITIONS} SELECT event_id, lat, lon FROM positions WHERE lat BETWEEN -80.0 AND -35.5 AND lon BETWEEN -170.0 AND 60.0""")
def bbox(spark, sf_dir):
    return t.positions(spark, sf_dir).filter(geo.in_bbox(F.col("lat"), F.col("lon"), -80.0, -170.0, -35.5, 60.0)).select("event_id", "lat", "lon")


@query(f"""WITH {DUCK_POSITIONS} SELECT event_id, lat, lon FROM positions WHERE lat BETWEEN -80.0 AND -35.5 AND (lon >= 150.0 OR lon <= -150.0)""")
def bbox_wrap(spark, sf_dir):
    return t.positions(spark, sf_dir).filter(geo.in_bbox(F.col("lat"), F.col("lon"), -80.0, 150.0, -35.5, -150.0)).select("event_id", "lat", "lon")


# documents over telemetry

def duck_cover(width: int) -> str:
    b0, b1 = duck_bucket("ts_start", width), duck_bucket("(ts_end - INTERVAL 1 MICROSECOND)", width)
    return f"cover AS (SELECT entity, id, kind, title, body, unnest(range({b0}, coalesce({b1}, {b0}) + 1)) AS bucket FROM docs)"


@query(f"""WITH {duck_telemetry(HOUR)}, {DUCK_DOCS}, {duck_cover(HOUR)}
SELECT t.entity, t.bucket, c.id, c.kind, round(t.mean, 6) AS mean FROM telemetry t JOIN cover c USING (entity, bucket)""")
def docs_cover_join(spark, sf_dir):
    d = t.docs(spark, sf_dir)
    j = relations.docs_in_range(telemetry(spark, sf_dir, HOUR), d, search.covered_buckets(d, HOUR))
    return j.select("entity", "bucket", "id", "kind", F.round("mean", 6).alias("mean"))


def duck_match(body: str) -> str:
    from tidemark.functions.text import duck_tokens

    return f"list_has_any({duck_tokens(body)}, ['le', 'la', 'der']) AND list_has_any({duck_tokens(body)}, ['un', 'und', 'en'])"


MATCH_TEXT = "the le OR la der AND un und OR en"


@query(f"""WITH {duck_telemetry(HOUR)}, {DUCK_DOCS}, {duck_cover(HOUR)}, hits AS (SELECT DISTINCT entity, bucket FROM cover WHERE kind = 'notes' AND {duck_match('body')})
SELECT t.entity, t.bucket, t.n FROM telemetry t JOIN hits USING (entity, bucket)""")
def match_telemetry(spark, sf_dir):
    return search.match_telemetry(telemetry(spark, sf_dir, HOUR), t.docs(spark, sf_dir), "notes", MATCH_TEXT, HOUR).select("entity", "bucket", "n")


@query(f"""WITH {duck_telemetry(HOUR)}, {DUCK_DOCS}, {duck_cover(HOUR)}, hits AS (SELECT DISTINCT entity, bucket FROM cover WHERE kind = 'notes' AND {duck_match('body')})
SELECT t.entity, t.bucket, t.n FROM telemetry t ANTI JOIN hits USING (entity, bucket)""")
def not_match_telemetry(spark, sf_dir):
    return search.match_telemetry(telemetry(spark, sf_dir, HOUR), t.docs(spark, sf_dir), "notes", MATCH_TEXT, HOUR, negate=True).select("entity", "bucket", "n")


# predicates over telemetry

@query(f"""WITH {duck_telemetry(HOUR)} SELECT entity, bucket, hi FROM telemetry WHERE hi > 99.99""")
def filter_quantized(spark, sf_dir):
    """A literal finer than the column's scale compares as the column would hold it."""
    return telemetry(spark, sf_dir, HOUR).filter(F.col("hi") > quantized(99.98999, 2)).select("entity", "bucket", "hi")


@query(f"""WITH {duck_telemetry(HOUR)} SELECT entity, bucket, n FROM telemetry WHERE {duck_start('bucket', HOUR)} >= TIMESTAMP '2024-01-10 00:00:00.000001' AND {duck_start('bucket', HOUR)} < TIMESTAMP '2024-01-20 00:00:00.5'""")
def filter_time_offgrid(spark, sf_dir):
    start = clock.bucket_start(F.col("bucket"), HOUR)
    lit = lambda x: F.lit(x).cast(NTZ)
    return telemetry(spark, sf_dir, HOUR).filter((start >= lit("2024-01-10 00:00:00.000001")) & (start < lit("2024-01-20 00:00:00.5"))).select("entity", "bucket", "n")


@query(f"""WITH {duck_telemetry(TEN)}, x AS (SELECT entity, bucket, CASE WHEN n > 1 THEN state END AS state FROM telemetry) SELECT entity, bucket, state FROM x WHERE state <> 'high'""")
def set_not_equal_kleene(spark, sf_dir):
    x = telemetry(spark, sf_dir, TEN).select("entity", "bucket", F.when(F.col("n") > 1, F.col("state")).alias("state"))
    return x.filter(F.col("state") != "high")


@query(f"""WITH {duck_telemetry(HOUR)} SELECT entity, bucket, n FROM telemetry WHERE list_contains(sources, '7') OR list_contains(sources, '11')""")
def source_membership(spark, sf_dir):
    return telemetry(spark, sf_dir, HOUR).filter(F.array_contains("sources", "7") | F.array_contains("sources", "11")).select("entity", "bucket", "n")


@query(f"""WITH {duck_telemetry(TEN)}, x AS (SELECT entity, bucket, CASE WHEN n > 1 THEN state END AS state, n FROM telemetry) SELECT entity, bucket, state FROM x WHERE state IS DISTINCT FROM 'high' AND n < 4""")
def is_distinct_from(spark, sf_dir):
    x = telemetry(spark, sf_dir, TEN).select("entity", "bucket", F.when(F.col("n") > 1, F.col("state")).alias("state"), "n")
    return x.filter(~F.col("state").eqNullSafe("high") & (F.col("n") < 4)).select("entity", "bucket", "state")


@query(f"""WITH {duck_telemetry(TEN)}, x AS (SELECT entity, bucket, CASE WHEN n > 1 THEN state END AS state, hi, lo FROM telemetry) SELECT entity, bucket FROM x WHERE NOT (state = 'mid' AND hi > 70) OR (lo BETWEEN 10 AND 20 AND state IS NULL)""")
def bool_tree(spark, sf_dir):
    x = telemetry(spark, sf_dir, TEN).select("entity", "bucket", F.when(F.col("n") > 1, F.col("state")).alias("state"), "hi", "lo")
    return x.filter(~((F.col("state") == "mid") & (F.col("hi") > 70)) | (F.col("lo").between(10, 20) & F.col("state").isNull())).select("entity", "bucket")


# stores, shards, documents

@query("""WITH r AS (SELECT event_type AS entity, user_id % 10 AS shard, count(*) AS version, md5(CAST(sum(event_id) AS VARCHAR)) AS hash FROM events GROUP BY 1, 2),
l AS (SELECT event_type AS entity, user_id % 10 AS shard, count(*) AS version, md5(CAST(sum(event_id) AS VARCHAR)) AS hash FROM events WHERE user_id % 7 <> 3 AND event_type <> 'error' GROUP BY 1, 2)
SELECT r.entity, r.shard, r.version, r.hash, CASE WHEN l.version IS NULL THEN 'missing' WHEN l.version < r.version THEN 'older' ELSE 'different' END AS reason
FROM r LEFT JOIN l USING (entity, shard) WHERE l.version IS NULL OR l.version < r.version OR (l.version = r.version AND l.hash <> r.hash)""")
def manifest_diff(spark, sf_dir):
    def shards(e):
        return e.groupBy(F.col("event_type").alias("entity"), (F.col("user_id") % 10).alias("shard")).agg(F.count("*").alias("version"), F.md5(F.sum("event_id").cast("string").cast("binary")).alias("hash"))

    e = t.table(spark, sf_dir, "events")
    return relations.manifest_diff(shards(e), shards(e.filter("user_id % 7 <> 3 and event_type <> 'error'")))


@query("""WITH s AS (SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 1 DAY AS ts_to, count(*) AS n FROM events GROUP BY 1, 2), x AS (SELECT *, ts_to < TIMESTAMP '2024-01-28' AS sealed FROM s)
SELECT event_type, ts_to, n, sealed FROM x WHERE NOT (sealed AND ts_to <= TIMESTAMP '2024-01-31' - INTERVAL 10 DAYS)""")
def retention(spark, sf_dir):
    end = (F.date_trunc("day", F.col("ts").cast("timestamp")) + F.expr("INTERVAL 1 DAY")).cast(NTZ)
    s = t.table(spark, sf_dir, "events").groupBy("event_type", end.alias("ts_to")).agg(F.count("*").alias("n"))
    s = s.withColumn("sealed", F.col("ts_to") < F.lit("2024-01-28").cast(NTZ))
    return relations.retained(s, F.lit("2024-01-31").cast("timestamp"), 10 * 86400)


@query(f"""WITH {DUCK_DOCS}, o AS (SELECT entity, id, kind, title FROM docs WHERE id % 5 <> 1), n AS (SELECT entity, id, kind, CASE WHEN id % 4 = 0 THEN 'new ' || title ELSE title END AS title FROM docs WHERE kind = 'notes' AND id % 2 = 0)
SELECT coalesce(o.entity, n.entity) AS entity, coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'insert' WHEN n.id IS NOT NULL AND o.title = n.title THEN 'keep' WHEN n.id IS NOT NULL THEN 'update' WHEN o.kind = 'notes' THEN 'delete' ELSE 'other' END AS action,
  coalesce(n.kind, o.kind) AS kind, coalesce(n.title, o.title) AS title FROM o FULL JOIN n ON o.entity = n.entity AND o.id = n.id""")
def doc_reconcile(spark, sf_dir):
    d = t.docs(spark, sf_dir).select("entity", "id", "kind", "title")
    new = d.filter("kind = 'notes' and id % 2 = 0").withColumn("title", F.when(F.col("id") % 4 == 0, F.concat(F.lit("new "), "title")).otherwise(F.col("title")))
    return relations.reconcile(d.filter("id % 5 <> 1"), new, ["entity", "id"], F.col("kind") == "notes")


@query("""SELECT 'type.urn:' || event_type AS context, 'value' AS path, ts, value, NULL AS value_str, CAST(user_id AS VARCHAR) AS source FROM events
UNION ALL SELECT 'type.urn:' || event_type, 'position.' || k.n, ts, k.v, NULL, CAST(user_id AS VARCHAR) FROM events, LATERAL (VALUES ('latitude', ((user_id * 37) % 1700) / 10.0 - 85), ('longitude', ((user_id * 71) % 3600) / 10.0 - 180)) AS k(n, v)
UNION ALL SELECT 'type.urn:' || event_type, 'type', ts, NULL, event_type, CAST(user_id AS VARCHAR) FROM events""")
def raw_union(spark, sf_dir):
    from tidemark.sources.readers import raw_view

    e, u = t.table(spark, sf_dir, "events"), F.col("user_id")
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    base = [F.concat(F.lit("type.urn:"), "event_type").alias("context"), iso.alias("signalk_timestamp"), u.cast("string").alias("source")]
    numbers = e.select(*base, F.lit("value").alias("path"), "value")
    objects = e.select(*base, F.lit("position").alias("path"), ((u * 37) % 1700 / 10.0 - 85).alias("value_latitude"), ((u * 71) % 3600 / 10.0 - 180).alias("value_longitude"))
    texts = e.select(*base, F.lit("type").alias("path"), F.col("event_type").alias("value"))
    return raw_view(numbers, objects, texts).withColumn("ts", F.col("ts").cast(NTZ))
