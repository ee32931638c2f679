"""The search pipeline over lexical, vector and graph scores; vector import; posting bitmaps; regular-expression tags; document ids."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import search
from tidemark.operators.relations import parse_filters

MODES = ("lexical_only", "hybrid_or_fallback", "hybrid_strict")


def hybrid_search(sections: DataFrame, text: str, k: int = 10, mode: str = "hybrid_or_fallback", semantic: DataFrame | None = None, mass: DataFrame | None = None, alpha: float = 0.5, beta: float = 0.4, metadata: Sequence[str] = (), stemmed: bool = True) -> tuple[DataFrame, str | None]:
    """(id, score, rank) of a query and a warning, if there is one.

    Filters in the text (`field:value`) narrow the sections before they are scored; a text of filters alone returns ids in
    order with score 0. Without semantic scores (id, score), hybrid_or_fallback is lexical with a warning and
    hybrid_strict an error. mass (id, mass) boosts by the entity graph.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    rest, conditions = parse_filters(text, metadata)
    allowed = sections
    for c in conditions:
        allowed = allowed.filter(c)
    if not rest.strip():
        return allowed.select("id", F.lit(0.0).alias("score")).orderBy("id").limit(k).withColumn("rank", (F.row_number().over(search.Window.orderBy("id"))).cast("int")), None
    warning = None
    if mode != "lexical_only" and semantic is None:
        if mode == "hybrid_strict":
            raise ValueError("hybrid search needs vectors")
        warning = "no vectors: the result is lexical"
    want, drop = search.split_query(rest, stemmed)
    spark, p = sections.sparkSession, search.postings(allowed, stemmed=stemmed)
    q = spark.createDataFrame([(0, t, want.count(t)) for t in dict.fromkeys(want)], "query int, term string, times long")
    lexical = search.bm25(p, q)
    none = spark.createDataFrame([], "query int, id long, score double")
    ids = allowed.select("id")
    sem = none if semantic is None or mode == "lexical_only" else semantic.join(ids, "id", "left_semi").select(F.lit(0).alias("query"), "id", "score")
    skg = none if mass is None else mass.join(ids, "id", "left_semi").select(F.lit(0).alias("query"), "id", F.col("mass").alias("score"))
    found = search.blend(lexical, sem, skg, alpha, beta)
    if drop:
        found = found.join(p.words.filter(F.col("term").isin(*drop)).select("id").distinct(), "id", "left_anti")
    return search.top(found, k).select("id", "score", "rank"), warning


def vector_problems(vectors: DataFrame, sections: DataFrame, dimensions: int) -> DataFrame:
    """(id, problem) of an import of vectors(id, vector): wrong size, repeated id, an id without section, a section without vector."""
    size = vectors.filter(F.coalesce(F.size("vector"), F.lit(-1)) != dimensions).select("id", F.lit("dimensions").alias("problem"))
    twice = vectors.groupBy("id").count().filter("count > 1").select("id", F.lit("duplicate").alias("problem"))
    stray = vectors.select("id").distinct().join(sections.select("id"), "id", "left_anti").select("id", F.lit("unknown").alias("problem"))
    gone = sections.select("id").join(vectors.select("id"), "id", "left_anti").select("id", F.lit("missing").alias("problem"))
    return size.unionByName(twice).unionByName(stray).unionByName(gone)


def bitmaps(postings: DataFrame) -> DataFrame:
    """(term, part, bits): postings(term, id) as one bitmap a term and 32,768 ids."""
    return postings.groupBy("term", F.bitmap_bucket_number("id").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))


def bitmap_overlap(bits: DataFrame, one: str, other: str) -> DataFrame:
    """(both, either, jaccard) of two terms' sets, from the bitmaps of their parts."""
    chosen = bits.filter(F.col("term").isin(one, other)).groupBy("part").agg(F.bitmap_count(F.bitmap_and_agg("bits")).alias("common"), F.bitmap_count(F.bitmap_or_agg("bits")).alias("either"), F.count("*").alias("terms"))
    both = F.coalesce(F.sum(F.when(F.col("terms") == 2, F.col("common"))), F.lit(0))
    return chosen.agg(both.alias("both"), F.coalesce(F.sum("either"), F.lit(0)).alias("either")).select("both", "either", F.when(F.col("either") > 0, F.col("both") / F.col("either")).alias("jaccard"))


def regex_tags(sections: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(id, tag, start, text): the longest match of each pattern at each place where one starts; matches may overlap."""
    compiled = {tag: regex.compile(p, regex.POSIX) for tag, p in patterns.items()}  # the longest match, not the first alternative's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, body in zip(batch.column("id").to_pylist(), batch.column("body").to_pylist(), strict=True):
                for tag, p in compiled.items():
                    at = 0
                    while body and (m := p.search(body, at)):
                        if m[0]:
                            rows.append((i, tag, m.start(), m[0]))
                        at = m.start() + 1
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)], ["id", "tag", "start", "text"])

    return sections.select("id", "body").mapInArrow(run, "id long, tag string, start long, text string")


def one_edit_pattern(term: str) -> str:
    """A regular expression of the term and what one deletion, substitution, insertion or exchange of neighbours makes of it."""
    e = [re.escape(c) for c in term]
    out = ["".join(e)]
    for i in range(len(e)):
        out += ["".join(e[:i] + e[i + 1 :]), "".join([*e[:i], ".", *e[i + 1 :]])]
        if i + 1 < len(e):
            out.append("".join([*e[:i], e[i + 1], e[i], *e[i + 2 :]]))
    out += ["".join([*e[:i], ".", *e[i:]]) for i in range(len(e) + 1)]
    return "(?:" + "|".join(sorted(set(out), key=lambda x: (-len(x), x))) + ")"


def document_id(kind: Column, start: Column, title: Column, body: Column) -> Column:
    """kind/start/hash of title and body: a document that is imported again replaces itself."""
    return F.concat_ws("/", kind, F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.substring(F.sha2(F.concat(title, F.lit("\x1f"), body), 256), 1, 16))


def upserted(old: DataFrame, new: DataFrame, key: Sequence[str] = ("entity", "id")) -> DataFrame:
    """old without the keys of new, and new."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)
