"""Queries of the document search side, with DuckDB twins where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import STOP_WORDS, duck_tokens, tokens
from tidemark.operators import knowledge, relations, search
from tidemark.scratch import small_side, stored
from tidemark.sources import readers
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


_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def duck_bm25(gain: str, source: str = "sections", fields=(("title", 2.0), ("body", 1.0)), group: str = "", questions: str | None = None) -> str:
    """CTEs up to scored(query, [group,] id, score); `gain` uses tf, norm."""
    g = f"{group}, " if group else ""
    parts = " UNION ALL ".join(f"SELECT {g}id, '{f}' AS field, {w} AS weight, {duck_tokens(f)} AS toks FROM {source}" for f, w in fields)
    using = f"USING ({g}field)" if True else ""
    q = questions or f"""SELECT item_id AS query, unnest(CASE WHEN len(list_filter(k, lambda x: NOT list_contains({_STOP}, x))) > 0 THEN list_filter(k, lambda x: NOT list_contains({_STOP}, x)) ELSE k END) AS term
  FROM (SELECT item_id, {duck_tokens('text')} AS k FROM benchmark)"""
    return f"""fielded AS ({parts}), lens AS (SELECT {g}id, field, CAST(len(toks) AS BIGINT) AS len FROM fielded),
stats AS (SELECT {g}field, count(*) AS n, avg(len) AS avgdl FROM lens GROUP BY ALL),
post AS (SELECT {g}id, field, weight, term, count(*) AS tf FROM (SELECT {g}id, field, weight, unnest(toks) AS term FROM fielded) GROUP BY ALL),
qt AS (SELECT query, term, count(*) AS times FROM ({q}) GROUP BY ALL),
df AS (SELECT {g}field, term, count(*) AS df FROM post WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
parts AS (SELECT {g}id, term, weight * greatest(0.0, ln((n - df + 0.5) / (df + 0.5) + 1)) * ({gain}) AS part
  FROM (SELECT p.*, d.df, s.n, CAST(p.tf AS DOUBLE) AS f, CASE WHEN s.avgdl > 0 THEN 1 - 0.75 + 0.75 * l.len / s.avgdl ELSE 1.0 END AS norm
    FROM post p JOIN df d USING ({g}field, term) JOIN stats s {using} JOIN lens l USING ({g}field, id))),
scored AS (SELECT query, {g}id, sum(part * times) AS score FROM parts JOIN qt USING (term) GROUP BY ALL)"""


CLASSIC, PLUS = "f * 2.2 / (f + 1.2 * norm)", "f * 2.2 / (f + 1.2 * norm) + 1.0"
LONG = "2.2 * (f / norm + 0.5) / (1.2 + f / norm + 0.5)"


def duck_top(gain: str) -> str:
    return f"""WITH {DUCK_SECTIONS}, {duck_bm25(gain)}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM scored)
SELECT query, id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 10"""


def benchmark_search(spark: SparkSession, sf_dir: str, variant: str, stemmed: bool = False) -> DataFrame:
    q = search.query_table(t.table(spark, sf_dir, "benchmark"), "item_id", "text", stemmed)
    found = search.bm25(search.postings(t.sections(spark, sf_dir), stemmed=stemmed), q, variant, best=10)
    return search.top(found, 10).select("query", "id", "rank", F.round("score", 6).alias("score"))


@query(duck_top(CLASSIC))
def bm25_classic(spark, sf_dir):
    """The ten best documents for every benchmark text."""
    return benchmark_search(spark, sf_dir, "classic")


@query(duck_top(PLUS))
def bm25_plus(spark, sf_dir):
    return benchmark_search(spark, sf_dir, "plus")


@query(duck_top(LONG))
def bm25_l(spark, sf_dir):
    return benchmark_search(spark, sf_dir, "l")


@query()
def bm25_stemmed(spark, sf_dir):
    """As by default: words match by their stems. A test holds it against the formula in plain Python."""
    return benchmark_search(spark, sf_dir, "classic", stemmed=True)


def duck_question(words: dict[str, int]) -> str:
    return " UNION ALL ".join(f"SELECT 0 AS query, '{w}' AS term FROM range({n})" for w, n in words.items())


@query(f"""WITH {DUCK_SECTIONS}, {duck_bm25(CLASSIC, questions=duck_question({'le': 2, 'der': 1}))},
r AS (SELECT id, score FROM scored WHERE id NOT IN (SELECT id FROM post WHERE term IN ('une', 'und'))), k AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM r)
SELECT id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 25""")
def search_not(spark, sf_dir):
    """A repeated term counts twice; `-word` and `NOT word` exclude; excluding a stop word does nothing."""
    return search.search(t.sections(spark, sf_dir), "le der Le -une NOT und -the", 25, stemmed=False).select("id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {DUCK_DOCS} SELECT entity, id FROM docs WHERE list_has_any({duck_tokens('body')}, ['le', 'der']) AND list_has_any({duck_tokens('body')}, ['une', 'und'])""")
def match_and_groups(spark, sf_dir):
    return t.docs(spark, sf_dir).filter(search.text_condition(F.col("body"), "the le OR der AND une und")).select("entity", "id")


@query(f"""WITH {DUCK_DOCS}, {duck_bm25(CLASSIC, 'docs', (('body', 1.0),), 'entity, kind', duck_question({'le': 1, 'der': 1, 'une': 1, 'und': 1}))}
SELECT d.entity, d.kind, d.id, round(coalesce(s.score, 0.0), 6) AS score FROM docs d LEFT JOIN scored s ON s.entity = d.entity AND s.kind = d.kind AND s.id = d.id
WHERE list_has_any({duck_tokens('body')}, ['le', 'der']) AND list_has_any({duck_tokens('body')}, ['une', 'und'])""")
def match_docs_scored(spark, sf_dir):
    """Scores by the statistics of each (entity, kind)."""
    return search.match_docs(t.docs(spark, sf_dir), "le OR der AND une und").select("entity", "kind", "id", F.round("score", 6).alias("score"))


@query(f"""SELECT token, count(*) AS n FROM (SELECT unnest({duck_tokens('text')}) AS token FROM documents) GROUP BY token""")
def tokens_folded(spark, sf_dir):
    d = t.table(spark, sf_dir, "documents").select(F.explode(tokens(F.col("text"))).alias("token"))
    return d.groupBy("token").agg(F.count("*").alias("n"))


# entities: names in the documents

_MENTIONS = f"""toks AS (SELECT DISTINCT id, entity FROM (SELECT doc_id AS id, unnest({duck_tokens('text')}) AS entity FROM documents)),
names AS (SELECT DISTINCT entity FROM (SELECT unnest({duck_tokens('text')}) AS entity FROM benchmark) WHERE length(entity) >= 8),
mentions AS (SELECT id, entity FROM toks JOIN names USING (entity))"""

_GRAPH = f"""{_MENTIONS}, m AS (SELECT count(DISTINCT id) AS n FROM mentions), size AS (SELECT entity, count(*) AS k FROM mentions GROUP BY 1),
pair AS (SELECT a.entity AS a, b.entity AS b, count(*) AS "both" FROM mentions a JOIN mentions b ON a.id = b.id AND a.entity < b.entity GROUP BY 1, 2),
g0 AS (SELECT p.a, p.b, p."both", x.k AS ka, y.k AS kb, CAST(m.n AS DOUBLE) AS n FROM pair p JOIN size x ON x.entity = p.a JOIN size y ON y.entity = p.b, m),
g1 AS (SELECT *, "both" / (ka + kb - "both") AS jaccard, ka * kb / n AS expect, ka * kb / n * (1 - ka / n) * (1 - kb / n) AS spread FROM g0 WHERE "both" / (ka + kb - "both") >= 0.1),
graph AS (SELECT a, b, "both", jaccard, CASE WHEN spread > 0 THEN tanh(sign(("both" - expect) / sqrt(spread)) * ln(1 + abs(("both" - expect) / sqrt(spread))) / 3) ELSE 0.0 END AS relatedness FROM g1)"""


def mentions(spark, sf_dir) -> DataFrame:
    """(id, entity): documents' words that are names, which here are the benchmark's words of eight letters or more."""
    names = t.table(spark, sf_dir, "benchmark").select(F.explode(tokens(F.col("text"))).alias("entity")).filter(F.length("entity") >= 8).distinct()
    long = F.filter(tokens(F.col("text")), lambda w: F.length(w) >= 8)
    m = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(F.array_distinct(long)).alias("entity"))
    return stored(m.join(small_side(names), "entity").select("id", "entity"), "mentions")  # texts are cut into tokens once


@query(f"""WITH {_GRAPH} SELECT a, b, "both", round(jaccard, 6) AS jaccard, round(relatedness, 6) AS relatedness FROM graph""")
def entity_graph(spark, sf_dir):
    return knowledge.entity_graph(mentions(spark, sf_dir)).select("a", "b", "both", F.round("jaccard", 6).alias("jaccard"), F.round("relatedness", 6).alias("relatedness"))


def first_seeds(m: DataFrame) -> list[str]:
    return [r.entity for r in m.groupBy("entity").count().orderBy(F.desc("count"), "entity").limit(3).collect()]


_WALK = f"""{_GRAPH}, seeds AS (SELECT entity FROM size ORDER BY k DESC, entity LIMIT 3), dir AS (SELECT a, b, relatedness FROM graph UNION ALL SELECT b, a, relatedness FROM graph),
near AS (SELECT d.*, row_number() OVER (PARTITION BY a ORDER BY round(relatedness, 9) DESC, b) AS nth FROM dir d WHERE a IN (SELECT entity FROM seeds) AND relatedness >= 0.05),
weight AS (SELECT entity, max(w) AS w FROM (SELECT b AS entity, 0.5 * relatedness AS w FROM near WHERE nth <= 8 UNION ALL SELECT entity, 1.0 FROM seeds) GROUP BY 1),
raw AS (SELECT id, sum(w) AS raw FROM mentions JOIN weight USING (entity) GROUP BY 1), mass AS (SELECT id, raw / (SELECT max(raw) FROM raw) AS mass FROM raw)"""


def walk(spark, sf_dir) -> DataFrame:
    m = mentions(spark, sf_dir)
    seeds = first_seeds(m)
    return knowledge.graph_walk(stored(knowledge.entity_graph(m, touching=seeds), "edges"), m, seeds)


@query(f"""WITH {_WALK} SELECT id, round(mass, 6) AS mass FROM mass""")
def graph_walk(spark, sf_dir):
    """Documents near the three most frequent entities."""
    return walk(spark, sf_dir).select("id", F.round("mass", 6).alias("mass"))


@query(f"""WITH {_WALK}, {DUCK_SECTIONS}, {duck_bm25(CLASSIC, questions=duck_question({'le': 1, 'der': 1}))}
SELECT coalesce(s.id, m.id) AS id, round(CASE WHEN s.score IS NOT NULL THEN s.score * (1 + 0.4 * coalesce(m.mass, 0)) ELSE 0.4 * m.mass END, 6) AS score
FROM scored s FULL JOIN mass m ON s.id = m.id WHERE s.score IS NOT NULL OR m.mass >= 0.5""")
def graph_boost(spark, sf_dir):
    q = spark.createDataFrame([(0, "le", 1), (0, "der", 1)], "query int, term string, times long")
    scored = search.bm25(search.postings(t.sections(spark, sf_dir), stemmed=False), q)
    return knowledge.graph_boost(scored, walk(spark, sf_dir)).select("id", F.round("score", 6).alias("score"))


_VOCAB = f"""words AS (SELECT word, count(*) AS n FROM (SELECT unnest({duck_tokens('text')}) AS word FROM documents) GROUP BY 1)"""


def vocabulary(spark, sf_dir) -> DataFrame:
    d = t.table(spark, sf_dir, "documents").select(F.explode(tokens(F.col("text"))).alias("word"))
    return d.groupBy("word").agg(F.count("*").alias("n"))


@query(f"""WITH {_VOCAB}, v AS (SELECT word FROM words WHERE n >= 5 AND length(word) >= 3), asked AS (SELECT DISTINCT word FROM (SELECT unnest({duck_tokens('text')}) AS word FROM benchmark) WHERE length(word) >= 3),
known AS (SELECT word, word AS suggestion FROM asked WHERE word IN (SELECT word FROM v)), unk AS (SELECT word FROM asked WHERE word NOT IN (SELECT word FROM v)),
gram AS (SELECT word, unnest(list_distinct(list_transform(generate_series(1, length(word)), lambda i: substr('_' || word || '_', i, 3)))) AS g FROM v),
idf AS (SELECT g, ln(1 + ((SELECT count(*) FROM v) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM gram GROUP BY 1),
ug AS (SELECT word, unnest(list_distinct(list_transform(generate_series(1, length(word)), lambda i: substr('_' || word || '_', i, 3)))) AS g FROM unk),
sc AS (SELECT u.word, gram.word AS candidate, sum(idf) AS score FROM ug u JOIN gram USING (g) JOIN idf USING (g) GROUP BY 1, 2),
sh AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY round(score, 9) DESC, candidate) AS nth, levenshtein(word, candidate) AS e FROM sc),
va AS (SELECT word, candidate, round(score * CASE e WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.5 END, 9) AS value FROM sh WHERE nth <= 20 AND e <= 2),
best AS (SELECT word, arg_min(candidate, (-value, candidate)) AS suggestion FROM va GROUP BY 1)
SELECT word, suggestion FROM known UNION ALL SELECT unk.word, best.suggestion FROM unk LEFT JOIN best USING (word)""")
def spell_correct(spark, sf_dir):
    """Words of the benchmark against the documents' words that occur five times or more."""
    known = vocabulary(spark, sf_dir).filter("n >= 5 and length(word) >= 3")
    asked = t.table(spark, sf_dir, "benchmark").select(F.explode(tokens(F.col("text"))).alias("word")).filter("length(word) >= 3")
    return knowledge.spell(asked, known)


@query(f"""SELECT w1, w2, w3, count(*) AS times FROM (SELECT k[i] AS w1, k[i + 1] AS w2, k[i + 2] AS w3 FROM (SELECT k, unnest(generate_series(1, len(k) - 2)) AS i FROM (SELECT {duck_tokens('text')} AS k FROM documents) WHERE len(k) >= 3)) GROUP BY ALL""")
def markov_transitions(spark, sf_dir):
    return knowledge.transitions(t.sections(spark, sf_dir))


@query()
def tag_longest(spark, sf_dir):
    """Documents tagged by the longest phrases of a dictionary made of the benchmark's first words."""
    b = t.table(spark, sf_dir, "benchmark").select("item_id", F.slice(tokens(F.col("text")), 1, 2).alias("w")).filter("size(w) = 2")
    phrases = b.select(F.array_join("w", " ").alias("phrase"), F.concat(F.lit("PAIR"), "item_id").alias("action")).unionAll(b.select(F.col("w")[0], F.concat(F.lit("WORD"), "item_id")))
    return knowledge.tag_by_table(t.sections(spark, sf_dir), phrases).select("id", F.array_join("tags", ",").alias("tags"))


# facets, metadata, metrics

_HITS = f"hits AS (SELECT * FROM sections WHERE list_has_any({duck_tokens('body')}, ['le', 'der', 'los']))"


def hits(spark, sf_dir) -> DataFrame:
    return t.sections(spark, sf_dir).filter(search.text_condition(F.col("body"), "le der los"))


@query(f"""WITH {DUCK_SECTIONS}, {_HITS} SELECT CAST(nullif(lang, 'es') AS VARCHAR) AS value, count(*) AS n, nullif(lang, 'es') IS NULL AS missing FROM hits GROUP BY 1, 3""")
def facet_field(spark, sf_dir):
    return relations.facet_field(hits(spark, sf_dir).withColumn("lang", F.nullif(F.col("lang"), F.lit("es"))), "lang")


@query(f"""WITH {DUCK_SECTIONS}, {_HITS}, s AS (SELECT CASE WHEN n_chars < 500 THEN 'before' WHEN n_chars >= 10000 THEN 'after' WHEN n_chars IS NULL THEN 'missing' ELSE 'range' END AS slot, n_chars FROM hits)
SELECT slot, CASE WHEN slot = 'range' THEN CAST(floor((n_chars - 500) / 1500.0) * 1500 + 500 AS DOUBLE) END AS lo, count(*) AS n FROM s GROUP BY 1, 2""")
def facet_range(spark, sf_dir):
    return relations.facet_range(hits(spark, sf_dir), "n_chars", 500, 10000, 1500)


@query(f"""WITH {DUCK_SECTIONS}, {_HITS} SELECT 'long' AS query, count(*) FILTER (n_chars > 3000) AS n FROM hits UNION ALL SELECT 'french', count(*) FILTER (lang = 'fr') FROM hits UNION ALL SELECT 'src0', count(*) FILTER (source = 'src0') FROM hits""")
def facet_query(spark, sf_dir):
    return relations.facet_query(hits(spark, sf_dir), {"long": F.col("n_chars") > 3000, "french": F.col("lang") == "fr", "src0": F.col("source") == "src0"})


@query(f"""WITH {DUCK_SECTIONS}, s AS (SELECT id, CASE WHEN id % 9 <> 0 THEN lang END AS lang, n_chars FROM sections) SELECT id, lang FROM s WHERE NOT coalesce(lang IN ('fr', 'de'), false) AND coalesce(n_chars >= 400 AND n_chars <= 5000, false)""")
def meta_filter_negated(spark, sf_dir):
    """A negated metadata filter keeps rows without a value."""
    s = t.sections(spark, sf_dir).select("id", F.when(F.col("id") % 9 != 0, F.col("lang")).alias("lang"), "n_chars")
    rest, conditions = relations.parse_filters("-lang:fr,de n_chars:400..5000 words", ["lang", "n_chars"])
    assert rest == "words"
    for c in conditions:
        s = s.filter(c)
    return s.select("id", "lang")


@query(f"""WITH {DUCK_SECTIONS}, {duck_bm25(CLASSIC)}, r AS (SELECT query, id, CAST(row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS BIGINT) AS rank FROM scored),
a AS (SELECT item_id, list_distinct({duck_tokens('text')}) AS w FROM benchmark), b AS (SELECT doc_id, {duck_tokens('text')} AS w FROM documents),
g AS (SELECT r.query, rank, len(list_intersect(a.w, b.w)) / len(a.w) AS gain FROM r JOIN a ON a.item_id = r.query JOIN b ON b.doc_id = r.id WHERE rank <= 20),
x AS (SELECT query, rank, CASE WHEN gain >= 0.8 THEN 1.0 ELSE 0.0 END AS gain FROM g), y AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY gain DESC, rank) AS ideal FROM x),
z AS (SELECT query, max(CASE WHEN gain > 0 AND rank <= 10 THEN 1 ELSE 0 END) AS hit, min(CASE WHEN gain > 0 THEN rank END) AS first, sum(CASE WHEN rank <= 10 THEN gain / log2(rank + 1.0) ELSE 0 END) AS dcg, sum(CASE WHEN ideal <= 10 THEN gain / log2(ideal + 1.0) ELSE 0 END) AS best FROM y GROUP BY 1)
SELECT query, CAST(hit AS INTEGER) AS hit, round(coalesce(1.0 / first, 0.0), 6) AS mrr, round(CASE WHEN best > 0 THEN dcg / best ELSE 0.0 END, 6) AS ndcg FROM z""")
def ir_metrics(spark, sf_dir):
    """Benchmark texts as questions; a document is relevant if it holds four fifths of the text's distinct tokens."""
    b = t.table(spark, sf_dir, "benchmark")
    found = search.bm25(search.postings(t.sections(spark, sf_dir), stemmed=False), search.query_table(b, "item_id", "text", stemmed=False), best=20)
    first = small_side(stored(search.top(found, 20).select("query", "id", "rank"), "ranked"))
    ranked = t.sections(spark, sf_dir).select("id", "body").join(first, "id").join(b.select(F.col("item_id").alias("query"), tokens(F.col("text")).alias("answer")), "query").withColumn("own", tokens(F.col("body")))
    share = relations.containment(F.col("answer"), F.col("own"))
    m = relations.ranking_metrics(ranked.filter(share.isNotNull()).select("query", "rank", F.when(share >= 0.8, 1.0).otherwise(0.0).alias("gain")), 10)
    return m.select("query", "hit", F.round("mrr", 6).alias("mrr"), F.round("ndcg", 6).alias("ndcg"))


# vectors and fusion

_DOT = "list_sum(list_transform(list_zip(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), lambda z: z[1] * z[2]))"
_NORM = "sqrt(list_sum(list_transform(CAST({}.embedding AS DOUBLE[]), lambda z: z * z)))"
_COSINE = f"""cos AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round({_DOT} / ({_NORM.format('q')} * {_NORM.format('v')}), 9) AS cosine FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0),
near AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS INTEGER) AS rank FROM cos)"""


def vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    v = t.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return v, v.filter("id % 50 = 0")


@query(f"""WITH {_COSINE} SELECT query_id, rank, id, round(cosine, 6) AS cosine FROM near WHERE rank <= 10""")
def cosine_topk(spark, sf_dir):
    v, q = vectors(spark, sf_dir)
    return search.cosine_top_k(v, q, 10).select("query_id", "rank", "id", F.round("cosine", 6).alias("cosine"))


_ITEMS = "q.vec_id IN (SELECT item_id FROM benchmark)"
_TWO = f"""{DUCK_SECTIONS}, {duck_bm25(CLASSIC)}, lex AS (SELECT query, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS nth FROM scored) WHERE nth <= 30),
{_COSINE.replace("q.vec_id % 50 = 0", _ITEMS).replace("near AS", "nearest AS")}, sem AS (SELECT query_id AS query, id, cosine AS score, rank FROM nearest WHERE rank <= 30)"""
_THREE = f"""{_TWO}, {_WALK}, skg AS (SELECT query, id, mass AS score FROM (SELECT query, id FROM lex UNION SELECT query, id FROM sem) JOIN mass USING (id))"""


def two(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """For each benchmark item the best documents by BM25 for its text, and by cosine to the vector of its number."""
    v, _ = vectors(spark, sf_dir)
    items = t.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))
    q = search.query_table(t.table(spark, sf_dir, "benchmark"), "item_id", "text", stemmed=False)
    lex = search.top(search.bm25(search.postings(t.sections(spark, sf_dir), stemmed=False), q, best=30), 30).select("query", "id", "score")
    sem = search.cosine_top_k(v, v.join(items, "id", "left_semi"), 30).select(F.col("query_id").alias("query"), "id", F.col("cosine").alias("score"), "rank")
    return stored(lex, "lexical"), stored(sem, "semantic")


def three(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The two lists and, for their documents, the mass of the entity graph's walk."""
    lex, sem = two(spark, sf_dir)
    skg = lex.select("query", "id").union(sem.select("query", "id")).distinct().join(walk(spark, sf_dir), "id").select("query", "id", F.col("mass").alias("score"))
    return lex, sem.select("query", "id", "score"), skg


def duck_blend(score: str) -> str:
    return f"""WITH {_THREE}, j AS (SELECT coalesce(l.query, s.query, k.query) AS query, coalesce(l.id, s.id, k.id) AS id, coalesce(l.score, 0) AS lex, coalesce(s.score, 0) AS sem, coalesce(k.score, 0) AS skg, l.score AS raw
  FROM lex l FULL JOIN sem s ON l.query = s.query AND l.id = s.id FULL JOIN skg k ON coalesce(l.query, s.query) = k.query AND coalesce(l.id, s.id) = k.id), f AS (SELECT *, max(raw) OVER (PARTITION BY query) AS most FROM j WHERE lex > 0 OR sem > 0 OR skg >= 0.5)
SELECT query, id, round({score}, 6) AS score FROM f"""


@query(duck_blend("CASE WHEN lex > 0 THEN lex * (1 + 0.5 * sem + 0.4 * skg) ELSE sem + 0.4 * skg END"))
def blend_multiplicative(spark, sf_dir):
    return search.blend(*three(spark, sf_dir)).select("query", "id", F.round("score", 6).alias("score"))


@query(duck_blend("CASE WHEN most > 0 THEN lex / most ELSE 0 END + 0.5 * sem + 0.4 * skg"))
def blend_normalized(spark, sf_dir):
    return search.blend(*three(spark, sf_dir), normalized=True).select("query", "id", F.round("score", 6).alias("score"))


@query(f"""WITH {_TWO}, lr AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM lex), u AS (SELECT query, id, rank FROM lr UNION ALL SELECT query, id, rank FROM sem)
SELECT query, id, round(sum(1 / (60.0 + rank)), 9) AS score FROM u GROUP BY 1, 2""")
def rrf(spark, sf_dir):
    lex, sem = two(spark, sf_dir)
    return search.rrf(search.top(lex, 1000), sem).select("query", "id", F.round("score", 9).alias("score"))


@query(f"""WITH {_TWO}, u AS (SELECT query, id, 0.7 * CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS part FROM lex WINDOW w AS (PARTITION BY query) UNION ALL SELECT query, id, 0.3 * CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END FROM sem WINDOW w AS (PARTITION BY query))
SELECT query, id, round(sum(part), 6) AS score FROM u GROUP BY 1, 2""")
def minmax_fusion(spark, sf_dir):
    lex, sem = two(spark, sf_dir)
    return search.minmax_fusion(lex, sem, 0.3).select("query", "id", F.round("score", 6).alias("score"))


# extraction

@query()
def snippet(spark, sf_dir):
    s = t.sections(spark, sf_dir).withColumn("terms", F.array(F.lit("le"), F.lit("der"), F.lit("los")))
    return search.snippets(s).select("id", "snippet")


@query()
def html_to_text(spark, sf_dir):
    title, text = readers.html_text(F.col("html"))
    return t.table(spark, sf_dir, "pages").select("page_id", title.alias("title"), text.alias("text"))


@query()
def markdown_sections(spark, sf_dir):
    """Documents as plain files: chunks of 25 lines."""
    d = t.table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file"), "text")
    return readers.markdown_sections(d).select("file", "line", F.length("body").cast("long").alias("chars"))


@query("""SELECT 'otel.urn:' || event_type AS entity, 'value{user=' || user_id || '}' AS path, ts, value AS num FROM events""")
def otlp_metrics(spark, sf_dir):
    """Each event as an OTLP/JSON gauge payload, and back."""
    attribute = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(v.alias("stringValue")).alias("value"))
    point = F.struct((F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string").alias("timeUnixNano"), F.col("value").alias("asDouble"), F.array(attribute("user", F.col("user_id").cast("string"))).alias("attributes"))
    metric = F.struct(F.lit("value").alias("name"), F.struct(F.array(point).alias("dataPoints")).alias("gauge"))
    payload = F.struct(F.array(F.struct(F.struct(F.array(attribute("service.name", F.col("event_type"))).alias("attributes")).alias("resource"), F.array(F.struct(F.array(metric).alias("metrics"))).alias("scopeMetrics"))).alias("resourceMetrics"))
    lines = t.table(spark, sf_dir, "events").select(F.to_json(payload).alias("value"))
    return readers.otlp_metrics(lines).select("entity", "path", F.col("ts").cast("timestamp_ntz").alias("ts"), "num")


@query("""SELECT 'vessels.urn:' || event_type AS entity, 'value' AS path, CAST(user_id AS VARCHAR) AS source, ts, value AS num, CAST(NULL AS VARCHAR) AS str FROM events
UNION ALL SELECT 'vessels.urn:' || event_type, 'props.k', CAST(user_id AS VARCHAR), ts, CAST(json_extract_string(props, '$.k') AS DOUBLE), NULL FROM events""")
def delta_records(spark, sf_dir):
    """Each event as an NDJSON delta with a number and an object, and back."""
    e = t.table(spark, sf_dir, "events")
    values = F.concat(F.lit('[{"path":"value","value":'), F.col("value").cast("string"), F.lit('},{"path":"props","value":'), F.col("props"), F.lit("}]"))
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    line = F.concat(F.lit('{"context":"urn:'), "event_type", F.lit('","updates":[{"$source":"'), F.col("user_id").cast("string"), F.lit('","timestamp":"'), stamp, F.lit('","values":'), values, F.lit("}]}"))
    return readers.deltas(e.select(line.alias("value"))).select("entity", "path", "source", F.col("ts").cast("timestamp_ntz").alias("ts"), "num", "str")
