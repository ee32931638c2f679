"""Queries on rows that the smallest tables don't hold, against their SQL twins, and steps against plain code."""

from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pyspark.sql import functions as F

from tidemark.operators import knowledge, search
from tidemark.plans import registry
from tidemark.streaming import live


def against_sql(spark, folder, name, **tables):
    """Rows of a query and of its twin over the tables, sorted."""
    con = duckdb.connect()
    for t, rows in tables.items():
        pq.write_table(rows, f"{folder}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = registry.QUERIES[name](spark, str(folder))
    columns = ", ".join(f'"{c}"' for c in df.columns)
    return sorted(map(tuple, df.collect()), key=str), sorted(con.sql(f"SELECT {columns} FROM ({registry.ORACLE[name]})").fetchall(), key=str)


def test_floats_are_scaled_as_floats(spark, tmp_path):
    vectors = [[-0.217, 0.3, 0.1], [-0.263, -0.1, 0.7], [-0.001, 0.3, 0.6]]
    e = pa.table({"vec_id": pa.array(range(3), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32()))})
    got, want = against_sql(spark, tmp_path, "fn_array", embeddings=e)
    assert got == want


def test_a_range_frame_isnt_walked_for_each_row(spark, tmp_path, data):
    """Ties, edges of the frame, nulls, times before 1970; no frame of the plan is bounded by an interval."""
    hours = [0, 0, 1, 2, 2, 3, 4, 4.5, 6.5, 6.5000001, 9, -3, -5, -5, None, None]
    us = [None if h is None else round(h * 3.6e9) for h in hours]
    e = pa.table({
        "event_id": pa.array(range(32), pa.int64()), "ts": pa.array(us * 2, pa.timestamp("us")), "user_id": pa.array([1] * 32, pa.int64()),
        "event_type": pa.array(["a"] * 16 + [None] * 16), "value": pa.array([None if i % 5 == 0 else float(i * 7 % 11) for i in range(32)]), "props": pa.array(["{}"] * 32),
    })
    got, want = against_sql(spark, tmp_path, "win_frame_range", events=e)
    assert got == want
    plan = registry.QUERIES["win_frame_range"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "INTERVAL" not in plan.upper()


@pytest.mark.parametrize(("cells", "products"), [(1, 1), (50, 40), (1 << 18, 1 << 21)])
@pytest.mark.parametrize("variant", ["classic", "plus", "l"])
def test_scores_in_blocks(spark, monkeypatch, cells, products, variant):
    """Blocks of any size give what joins give, and the best of each query with ties by id; no row is made for a token."""
    monkeypatch.setattr(search, "CELLS", cells)
    monkeypatch.setattr(search, "PRODUCTS", products)
    words = "lighthouse harbour anchor mast keel rudder the".split()
    body = [" ".join(words[(i * j) % 7] for j in range(1, 2 + i % 9)) for i in range(60)] + [None, "", "Ünïque!", "keel-keel"]
    rows = [(i, None if i % 7 == 0 else f"{words[i % 5]} {i}", b) for i, b in enumerate(body)]
    docs = spark.createDataFrame(rows, "id long, title string, body string").repartition(3)
    q = spark.createDataFrame([(k, words[(k * 3 + j) % 7], 1 + j) for k in range(9) for j in range(3)] + [(9, "nowhere", 1)], "query int, term string, times long")
    p = search.postings(docs, stemmed=False)
    counted = p.counted(["keel"])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in counted and "Aggregate" not in counted
    found = {(r.query, r.id): r.score for r in search.bm25(p, q, variant).collect()}
    grouped = search.postings(docs.withColumn("g", F.lit(1)), group=["g"], stemmed=False)
    want = {(r.query, r.id): r.score for r in search.bm25(grouped, q, variant).collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)
    best = [(r.query, r["rank"], r.id) for r in search.top(search.bm25(p, q, variant, best=4), 4).collect()]
    ranked = {k: [i for _, i in sorted((-round(s, 9), i) for (q_, i), s in want.items() if q_ == k)[:4]] for k in range(9)}
    assert sorted(best) == sorted((k, n + 1, i) for k, ids in ranked.items() for n, i in enumerate(ids))


def test_more_terms_than_are_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a mast", "keel keel rudder"), (2, None, "mast"), (3, "x", None)], "id long, title string, body string")
    q = spark.createDataFrame([(0, "keel", 1), (0, "mast", 2), (1, "rudder", 1)], "query int, term string, times long")
    want = {(r.query, r.id): round(r.score, 9) for r in search.bm25(search.postings(docs, stemmed=False), q).collect()}
    monkeypatch.setattr(search, "BROADCAST_ROWS", 1)
    assert {(r.query, r.id): round(r.score, 9) for r in search.bm25(search.postings(docs, stemmed=False), q).collect()} == want


def test_edges_of_some_entities(spark):
    m = spark.createDataFrame([(i, e) for i in range(40) for e in "abcdefg" if (i * (ord(e) - 95)) % 5 < 2], "id long, entity string")
    rows = lambda df: sorted((r.a, r.b, r.both, round(r.jaccard, 9), round(r.relatedness, 9)) for r in df.collect())
    every = rows(knowledge.entity_graph(m))
    for some in (["a"], ["c", "f"], ["a", "b", "g"]):
        assert rows(knowledge.entity_graph(m, touching=some)) == [r for r in every if r[0] in some or r[1] in some]


def test_phrases_are_looked_for_where_texts_lie(spark, monkeypatch):
    """Against the join that larger dictionaries take; no row is made for a run of tokens."""
    words = "red green blue sea sea-green deep".split()
    body = [" ".join(words[(i * 7 + j * j) % 6] for j in range(i % 13)) for i in range(50)] + [None, "", "!", "deep blue", "deep", "blue sea", "red red red"]
    docs = spark.createDataFrame(list(enumerate(body)), "id long, body string").repartition(3)
    book = [("red", "R"), ("Red green", "RG"), ("red green blue", "RGB"), ("deep blue sea", "DBS"), ("blue sea", "BS"), ("blue", "B"), ("blue", "B2"), ("red red", "RR"), ("sea-green deep", "SD"), ("...", "none")]
    phrases = spark.createDataFrame(book, "phrase string, action string")
    for longest in (True, False):
        df = knowledge.tag_by_table(docs, phrases, longest)
        got = sorted((r.id, r.tags) for r in df.collect())
        assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()
        with monkeypatch.context() as m:
            m.setattr(knowledge, "BROADCAST_ROWS", 0)
            assert got == sorted((r.id, r.tags) for r in knowledge.tag_by_table(docs, phrases, longest).collect())
    assert knowledge.tag_by_table(docs, phrases.limit(0)).count() == len(body)


def test_transitions_move_one_key(spark, data):
    plan = registry.QUERIES["markov_transitions"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(run" in plan


def test_edges_across_stretches_and_batches(spark, tmp_path):
    """Batch after batch against plain code; no Python state holds a series, and a batch that comes again changes nothing."""
    sink, last, want = live.RisingEdges(str(tmp_path), 60.0), {}, []
    for b in range(3):
        rows = [(e, "value", datetime(2024, 1, 1) + timedelta(minutes=37 * ((i * 7) % 20) + 400 * b), i, None if (i + b) % 6 == 0 else float((i * 31 + b * 17 + len(e)) % 120)) for e in ("a", "bb") for i in range(20)]
        for e, _, ts, _, v in sorted(rows, key=lambda r: (r[2], r[3])):
            if v is not None:
                if v > 60 and not last.get(e, 0) > 60:
                    want.append((e, ts))
                last[e] = v
        df = spark.createDataFrame(rows, "entity string, path string, ts timestamp, seq long, num double")
        sink(df, b)
        sink(df, b)
    assert sorted((r.entity, r.ts) for r in spark.read.parquet(f"{sink.edges}/batch=*").collect()) == sorted(want)
