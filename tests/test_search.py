"""Search, tagging, sections and the SQL front end against plain Python."""

import collections
import math
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions.stem import stem
from tidemark.functions.text import STOP_WORDS, query_tokens
from tidemark.operators import hybrid, intervals, knowledge, search
from tidemark.plans.sqlfront import Engine, NotReadOnly, guard
from tidemark.plans.verify import differences
from tidemark.sources import readers

TEXTS = ["The pumps were pumping", "a pump is connected to the connection", "connecting connections; was it connected?", "wind and sail", "", None, "Sailing: the sails' sail", "you do what you were doing"]


@pytest.fixture(scope="module")
def sections(spark):
    rows = [(i, (t or "")[:9], t) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "id long, title string, body string")


def plain_bm25(queries):
    fields = {f: [[stem(w) for w in re.findall("[a-z0-9]+", ((t or "")[:9] if f == "title" else t or "").lower().replace("'", " "))] for t in TEXTS] for f in ("title", "body")}
    out = {}
    for q, text in queries.items():
        words = [stem(w) for w in re.findall("[a-z0-9]+", text.lower())]
        words = [w for w in words if w not in STOP_WORDS] or words
        for i in range(len(TEXTS)):
            score = 0.0
            for f, weight in (("title", 2.0), ("body", 1.0)):
                mean = sum(map(len, fields[f])) / len(TEXTS)
                for w in words:
                    df, tf = sum(w in d for d in fields[f]), fields[f][i].count(w)
                    if tf:
                        idf = max(0.0, math.log((len(TEXTS) - df + 0.5) / (df + 0.5) + 1))
                        score += weight * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(fields[f][i]) / mean))
            if any(w in fields[f][i] for f in fields for w in words):
                out[q, i] = round(score, 6)
    return out


def test_stemmed_scores(spark, sections):
    queries = {0: "How does the pump connect", 1: "sails", 2: "what were you", 3: "absent words", 4: "connected connecting pumps"}
    q = spark.createDataFrame(list(queries.items()), "q int, text string")
    got = search.bm25(search.postings(sections), search.query_table(q, "q", "text"))
    assert {(r.query, r.id): round(r.score, 6) for r in got.collect()} == plain_bm25(queries)
    assert [r.id for r in search.search(sections, "connects -pumping").collect()] == [2]
    assert search.search(sections, "connects", stemmed=False).count() == 0
    assert query_tokens("what does it do", stemmed=True) == ["doe"] and query_tokens("what do you do") == ["what", "do", "you", "do"]


def test_tags_by_table_and_by_dictionary(spark):
    bodies = ["the sw-lucene café bar", "café bar café", "bar", "lucene sw", None, "big bar big bar big", ""]
    s = spark.createDataFrame(list(enumerate(bodies)), "id long, body string")
    d = {"sw-lucene": "L", "Café": "C", "café bar": "CB", "bar": "B", "big bar big": "BBB", "bar big": "X", "the": ""}
    table = spark.createDataFrame([(k, v or "THE") for k, v in d.items()] + [("Bar", "B2")], "phrase string, action string")
    want = {True: [["CB", "L", "THE"], ["C", "CB"], ["B"], [], [], ["BBB", "X"], []], False: [["B", "C", "CB", "L", "THE"], ["B", "C", "CB"], ["B"], [], [], ["B", "BBB", "X"], []]}
    for longest, tags in want.items():
        assert {r.id: r.tags for r in knowledge.tag(s, d, longest).collect()} == dict(enumerate(tags))
        more = [sorted({*t, "B2"}) if "B" in t else t for t in tags]
        assert {r.id: r.tags for r in knowledge.tag_by_table(s, table, longest).collect()} == dict(enumerate(more))


def test_the_longest_match_of_a_pattern(spark):
    s = spark.createDataFrame([(1, "xab abc"), (2, None), (3, "")], "id long, body string")
    got = {(r.tag, r.start, r.text) for r in hybrid.regex_tags(s, {"p": "a|ab|abc", "q": "b+|(bc)"}).collect()}
    assert got == {("p", 1, "ab"), ("p", 4, "abc"), ("q", 2, "b"), ("q", 5, "bc")}


def test_markdown_sections(spark):
    long = "word " * 30
    lines = [f"line {i}" if i % 40 else "" for i in range(120)]
    text = f"{long}\n# One\nshort\n##Two \n{long}\n\n# Three\n" + "\n".join(lines)
    f = spark.createDataFrame([("a.md", text), ("b.md", long), ("c.MD", "x"), ("d.txt", "\n".join(map(str, range(30)))), ("e.md", None)], "file string, text string")
    got = [(r.file, r.title, r.line, r.body) for r in readers.markdown_sections(f).collect()]
    three = [(0, 40), (40, 80), (80, 120)]
    want = [("a.md", "Introduction", 1, long), ("a.md", "Two", 4, f"{long}\n")]
    want += [("a.md", f"Three (Part {i + 1}/3)", 7 + a, "\n".join(lines[a:b])) for i, (a, b) in enumerate(three)]
    want += [("b.md", "Introduction", 1, long), ("d.txt", "d.txt", 1, "\n".join(map(str, range(25)))), ("d.txt", "d.txt", 26, "\n".join(map(str, range(25, 30))))]
    assert got == want


def test_the_cap_counts_all_entities(spark):
    rows = [(e, b, 9.0) for e in "abc" for b in (0, 2, 4, 7)]
    t = spark.createDataFrame(rows, "entity string, bucket long, hi double")
    got = intervals.episodes(t, F.col("hi") > 1, 600, "10m", "r", F.lit("m"), max_per_hour=2).select("entity", "id").collect()
    hours = collections.Counter(r.id[-20:-7] for r in got)
    assert sorted(hours.values()) == [2, 2] and {r.entity for r in got} == {"a", "b"}


@pytest.fixture(scope="module")
def engine(spark):
    t = spark.createDataFrame([("e", 0, 2.0, ["7", "8"]), ("f", 0, 2.5, ["8"])], "entity string, bucket long, hi double, sources array<string>")
    d = spark.createDataFrame([(1, "e", "notes", "2020-01-01 00:00:05", None, "t", "bilge pump pump"), (2, "f", "alerts", "2020-01-01 00:00:05", None, "t", "pump"), (3, "f", "notes", "2020-01-01 00:00:05", None, "t", None)], "id long, entity string, kind string, ts_start string, ts_end timestamp, title string, body string")
    return Engine(spark, t, d.withColumn("ts_start", F.col("ts_start").cast("timestamp")), 10, {"hi": 2})


def test_literals_are_held_to_digits(engine):
    count = lambda where: engine.sql(f"SELECT * FROM telemetry x WHERE {where}").count()
    assert count("hi = 2.0049") == 1 and count("2.0049 = x.hi") == 1 and count("hi <=> 1.9951") == 1 and count("hi BETWEEN 2.0049 AND 2.0") == 1 and count("hi NOT IN (1.999, 2.501)") == 0 and count("2.004 < hi AND hi < 3") == 1 and count("hi BETWEEN 1 AND 1.999") == 1
    assert engine.sql("SELECT 'hi > 1.23456' AS note, 'sources = ''7''' AS s FROM telemetry WHERE sources = '7'").collect() == [("hi > 1.23456", "sources = '7'")]


def test_statements_that_only_read():
    for good in ("WITH x AS (SELECT 1 AS update) SELECT * FROM x", "SELECT 'a; DROP TABLE b'", "FROM t SELECT insert", "EXPLAIN FORMATTED SELECT 1;", "WITH x AS (SELECT 1 AS delete) SELECT delete FROM x"):
        assert guard(good)
    for bad in ("WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "FROM t INSERT OVERWRITE TABLE u SELECT *", "EXPLAIN DROP TABLE t", "SELECT 1; SELECT 2", "UPDATE t SET a = 1", ""):
        with pytest.raises(NotReadOnly):
            guard(bad)


def test_match_over_documents_and_joins(engine):
    rows = engine.sql("SELECT id, score FROM docs WHERE match(body, 'pump AND bilge') ORDER BY id").collect()
    assert [r.id for r in rows] == [1] and rows[0].score > 0
    assert [r.id for r in engine.sql("SELECT d.id FROM docs d WHERE NOT match(body, 'bilge') AND match(d.body, 'pump')").collect()] == [2]
    assert engine.sql("SELECT t.hi FROM telemetry t JOIN telemetry u ON t.entity = u.entity WHERE match(notes, 'pump')").count() == 1
    assert [tuple(r) for r in engine.status().orderBy("entity").collect()] == [("e", 1, 0, 0, 1), ("f", 1, 0, 0, 2)]
    assert engine.sql("SELECT hi FROM telemetry WHERE entity = ? AND hi > ?", ["f", 2.2]).count() == 1


def test_differences(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, None), (None, 3.0, "z"), (4, None, "w"), (5, 5.0, "v"), (5, 6.0, "v")], "k int, v double, s string")
    b = spark.createDataFrame([(1, 1.004, "x"), (2, 2.02, None), (None, 3.0, "q"), (6, 1.0, "w"), (5, 6.0, "v"), (5, 5.0, "v")], "k int, v double, s string")
    got = {(r.k, r.column, r.golden, r.found) for r in differences(a, b, ["k"], {"v": 2}).collect()}
    assert got == {(2, "v", "2.0", "2.02"), (None, "s", "z", "q"), (4, "(row)", "present", None), (6, "(row)", None, "present")}
    assert differences(a, a, ["k"]).count() == 0


def test_cosine_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "VECTOR_BLOCK", 3)
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    rows = [(i, [float(i % 5), float(i % 3), 1.0]) for i in range(20)] + [(20, [0.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, vector array<float>")
    unit = [[x / (math.sqrt(sum(y * y for y in r)) or 1) for x in r] for _, r in rows]
    want = []
    for q in range(0, 20, 4):
        best = sorted((-round(sum(x * y for x, y in zip(unit[q], u, strict=True)), 9), i) for i, u in enumerate(unit))[:4]
        want += [(q, n + 1, i) for n, (_, i) in enumerate(best)]
    assert sorted((r.query_id, r.rank, r.id) for r in search.cosine_top_k(v, v.filter("id % 4 = 0 and id < 20"), 4).collect()) == want
