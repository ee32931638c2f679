"""Hybrid search, imports, bitmaps, shards and typed metadata, with DuckDB twins where SQL can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.text import duck_tokens, tokens
from tidemark.operators import hybrid, search
from tidemark.plans.telemetry import HOUR, duck_telemetry, telemetry
from tidemark.plans.text import _COSINE, CLASSIC, duck_bm25, duck_question, vectors
from tidemark.session import scratch_path
from tidemark.sources import sinks
from tidemark.sources import tables as t
from tidemark.sources.tables import DUCK_DOCS, DUCK_SECTIONS

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"""WITH {DUCK_SECTIONS}, kept AS (SELECT * FROM sections WHERE NOT coalesce(lang IN ('es'), false) AND coalesce(n_chars >= 300 AND n_chars <= 9000, false)),
{duck_bm25(CLASSIC, 'kept', questions=duck_question({'le': 1, 'der': 1}))}, r AS (SELECT id, score, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM scored)
SELECT id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 15""")
def search_filtered(spark, sf_dir):
    """Filters in the query text, lexical fallback without vectors."""
    found, warning = hybrid.hybrid_search(t.sections(spark, sf_dir), "le der -lang:es n_chars:300..9000", 15, metadata=("lang", "n_chars"), stemmed=False)
    assert warning
    return found.select("id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {DUCK_SECTIONS}, {duck_bm25(CLASSIC, questions=duck_question({'le': 1, 'der': 1}))}, {_COSINE.replace("q.vec_id % 50 = 0", "q.vec_id = 0").replace("near AS", "nearest AS")}, sem AS (SELECT n.id, n.cosine AS score FROM nearest n JOIN sections USING (id) WHERE n.rank <= 60 AND n.cosine > 0),
j AS (SELECT coalesce(l.id, s.id) AS id, coalesce(l.score, 0) AS lex, coalesce(s.score, 0) AS sem FROM scored l FULL JOIN sem s ON l.id = s.id),
r AS (SELECT id, CASE WHEN lex > 0 THEN lex * (1 + 0.5 * sem) ELSE sem END AS score FROM j WHERE lex > 0 OR sem > 0), k AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM r)
SELECT id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 40""")
def search_hybrid(spark, sf_dir):
    v = vectors(spark, sf_dir)[0]
    sem = search.cosine_top_k(v, v.filter("id = 0"), 60).select("id", F.col("cosine").alias("score")).filter("score > 0")
    found, _ = hybrid.hybrid_search(t.sections(spark, sf_dir), "le der", 40, "hybrid_strict", semantic=sem, stemmed=False)
    return found.select("id", F.round("score", 6).alias("score"), "rank")


@query("""SELECT vec_id AS id, 'dimensions' AS problem FROM embeddings WHERE vec_id % 17 = 0 UNION ALL SELECT vec_id, 'duplicate' FROM embeddings WHERE vec_id % 23 = 0
UNION ALL SELECT vec_id, 'unknown' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id, 'missing' FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def vector_import(spark, sf_dir):
    """Vectors with some cut short and some given twice, against the documents."""
    v = vectors(spark, sf_dir)[0]
    broken = v.withColumn("vector", F.when(F.col("id") % 17 == 0, F.slice("vector", 1, 10)).otherwise(F.col("vector")))
    twice = v.filter("id % 23 = 0").withColumn("vector", F.transform("vector", lambda x: x))
    return hybrid.vector_problems(broken.unionByName(twice), t.sections(spark, sf_dir), 64).distinct()


@query(f"""WITH p AS (SELECT DISTINCT doc_id AS id, term FROM (SELECT doc_id, unnest({duck_tokens('text')}) AS term FROM documents)), a AS (SELECT id FROM p WHERE term = 'que'), b AS (SELECT id FROM p WHERE term = 'la')
SELECT (SELECT count(*) FROM a JOIN b USING (id)) AS "both", (SELECT count(*) FROM (SELECT id FROM a UNION SELECT id FROM b)) AS either, (SELECT count(*) FROM a JOIN b USING (id)) / nullif((SELECT count(*) FROM (SELECT id FROM a UNION SELECT id FROM b)), 0) AS jaccard""")
def bitmap_jaccard(spark, sf_dir):
    """Two terms' documents as bitmaps."""
    p = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    return hybrid.bitmap_overlap(hybrid.bitmaps(p), "que", "la")


@query()
def regex_tags(spark, sf_dir):
    """Addresses, numbers and one-edit forms of a word in the documents."""
    return hybrid.regex_tags(t.sections(spark, sf_dir), {"ip": r"\d{1,3}(?:\.\d{1,3}){3}", "mail": r"[\w.]+@[\w.]+", "near": rf"\b{hybrid.one_edit_pattern('tion')}\b"})


@query(f"""WITH {DUCK_DOCS} SELECT entity, kind || '/' || strftime(ts_start, '%Y-%m-%dT%H:%M:%SZ') || '/' || substr(sha256(title || chr(31) || body), 1, 16) AS id, count(*) AS n FROM docs GROUP BY 1, 2""")
def document_import(spark, sf_dir):
    d = t.docs(spark, sf_dir)
    return d.groupBy("entity", hybrid.document_id(F.col("kind"), F.col("ts_start"), F.col("title"), F.col("body")).alias("id")).agg(F.count("*").alias("n"))


@query(f"""WITH {duck_telemetry(HOUR)} SELECT entity, bucket >> 16 AS shard, bucket, n FROM telemetry, (SELECT min(bucket) AS b0, max(bucket) AS b1 FROM telemetry) WHERE bucket BETWEEN b0 + (b1 - b0) // 4 AND b1""")
def shard_round_trip(spark, sf_dir):
    """Telemetry written by entity and shard, read back with bounds that prune shards."""
    path = scratch_path(spark, "shards")
    sinks.write_shards(telemetry(spark, sf_dir, HOUR), path)
    lo, hi = sinks.read_shards(spark, path).agg(F.min("bucket"), F.max("bucket")).first()
    return sinks.read_shards(spark, path, lo + (hi - lo) // 4, hi).select("entity", F.col("shard").cast("long").alias("shard"), "bucket", "n")


@query(f"""WITH {duck_telemetry(HOUR)}, x AS (SELECT entity, bucket, n FROM telemetry) SELECT entity, 0 AS shard, count(*) AS version, 'different' AS reason FROM x GROUP BY 1 HAVING count(*) FILTER (bucket % 50 = 0) > 0""")
def shard_hashes(spark, sf_dir):
    """A copy whose counts differ in some buckets shows as other content."""
    from tidemark.operators.relations import manifest_diff

    x = telemetry(spark, sf_dir, HOUR).select("entity", "bucket", "n")
    changed = x.withColumn("n", F.when(F.col("bucket") % 50 == 0, F.col("n") + 1).otherwise(F.col("n")))
    d = manifest_diff(sinks.shard_manifest(x), sinks.shard_manifest(changed))
    return d.select("entity", F.col("shard").cast("int").alias("shard"), "version", "reason")
