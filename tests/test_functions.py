"""Hand-computed edges of the scalar functions and small operators."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import clock, fixed, geo, stem, text
from tidemark.operators import buckets, intervals, knowledge, relations, search
from tidemark.plans.sqlfront import Engine, NotReadOnly, guard
from tidemark.sources import readers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("value,scale,want", [(1.25, 1, 13), (-1.25, 1, -13), (0.5, 0, 1), (-0.5, 0, -1), (1.005, 2, 100), (float("nan"), 2, None), (float("inf"), 2, None), (1e30, 2, None), (None, 2, None)])
def test_fixed(spark, value, scale, want):
    assert one(spark, fixed.to_fixed(F.lit(value).cast("double"), scale)) == want


def test_quantized():
    assert fixed.quantized(99.98999, 2) == 99.99 and fixed.quantized(-0.005, 2) == -0.01
    with pytest.raises(ValueError):
        fixed.quantized(float("nan"), 2)


def test_buckets_of_time(spark):
    at = lambda s: F.timestamp_seconds(F.lit(clock.EPOCH + s))
    assert one(spark, clock.bucket_of(at(9), 10)) == 0 and one(spark, clock.bucket_of(at(10), 10)) == 1
    with pytest.raises(Exception, match="no bucket"):
        one(spark, clock.bucket_of(at(-1), 10))


@pytest.mark.parametrize("t,ns", [("1.5m", 90 * 10**9), ("0s", 0), ("2h", 7200 * 10**9), ("40.000000001s", 40_000_000_001)])
def test_durations(t, ns):
    assert clock.duration_ns(t) == ns


@pytest.mark.parametrize("t", ["-1s", "1", "NaNs", "0.000000001ms", ""])
def test_bad_durations(t):
    with pytest.raises(ValueError):
        clock.duration_ns(t)


def test_geo(spark):
    lit = lambda x: F.lit(x).cast("double")
    assert one(spark, geo.distance_nm(lit(0), lit(179.9), 0, -179.9)) == pytest.approx(12.008092, abs=1e-6)
    box = lambda lon: one(spark, geo.in_bbox(lit(0), lit(lon), -1, 179, 1, -179))
    assert box(180) and box(-180) and not box(0)
    assert one(spark, geo.within_nm(lit(None), lit(5), 0, 0, 10)) is None
    with pytest.raises(ValueError):
        geo.in_bbox(lit(0), lit(0), 5, 0, 1, 0)


RUNS = [(0, 65535), (0, 65536), (0, 65538)]


@pytest.mark.parametrize("least,gap,want", [("40s", "10s", [(65535, 65539, 3)]), ("40.000000001s", "10s", []), ("0s", "9.999999999s", [(65535, 65537, 2), (65538, 65539, 1)])])
def test_runs(spark, least, gap, want):
    t = spark.createDataFrame(RUNS, "entity int, bucket long")
    got = intervals.intervals(t, F.lit(True), 10, least, gap).collect()
    number = lambda ts: (int(ts.replace(tzinfo=__import__("datetime").timezone.utc).timestamp()) - clock.EPOCH) // 10
    assert sorted((number(r.start), number(r.end), r.buckets) for r in got) == want


def test_counters(spark):
    rows = [("a", 1, 0, 2.0, False), ("a", 2, 0, 5.0, False), ("a", 2, 0, 5.0, False), ("a", 3, 3, 1.0, False), ("a", 4, 3, 3.0, False), ("d", 1, 0, 2.0, True), ("d", 2, 0, 3.0, True)]
    p = spark.createDataFrame(rows, "k string, ts long, start long, value double, delta boolean")
    got = {(r.k, r.ts): r.total for r in intervals.counter_totals(p, ["k"]).collect()}
    assert got == {("a", 1): 2, ("a", 2): 5, ("a", 3): 6, ("a", 4): 8, ("d", 1): 2, ("d", 2): 5}
    bad = spark.createDataFrame([("a", 1, 0, 2.0, False), ("a", 2, 0, 1.0, False)], "k string, ts long, start long, value double, delta boolean")
    with pytest.raises(Exception, match="fell"):
        intervals.counter_totals(bad, ["k"]).collect()


@pytest.mark.parametrize("glob,path,want", [("*.ais.*", "design.ais.length", True), ("design.*", "design.draft", True), ("design.*", "xdesign.draft", False), ("propulsion.*.state", "propulsion.main.state", True), ("propulsion.*.state", "propulsion.main.states", False)])
def test_globs(glob, path, want):
    assert bool(re.search(buckets.glob_regex(glob), path)) == want


def test_tokens(spark):
    got = one(spark, text.tokens(F.lit("SW-Lucene word—next Straße Æther þorn Привет naïve x_y 3.5")))
    assert got == ["swlucene", "wordnext", "strasse", "aether", "thorn", "naive", "x", "y", "3", "5"]
    assert text.query_tokens("the and of") == ["the", "and", "of"] and text.query_tokens("the Bilge-pump") == ["bilgepump"]


@pytest.mark.parametrize("w,s", [("running", "run"), ("caresses", "caress"), ("ponies", "poni"), ("generously", "generous"), ("relational", "relat"), ("hopping", "hop"), ("skies", "sky"), ("dying", "die"), ("happiness", "happi"), ("agreed", "agre"), ("knightly", "knight"), ("consistency", "consist"), ("knots", "knot")])
def test_stems(w, s):
    assert stem.stem(w) == s


def test_query_parts():
    assert search.split_query("anchor -storm NOT rope -the bay") == (["anchor", "bay"], ["storm", "rope"])


def test_relatedness(spark):
    rows = [(i, e) for i in range(100) for e, ok in (("a", i % 2 == 0), ("b", i % 5 == 0), ("c", i % 2 == 1 or i == 0), ("d", True)) if ok]
    g = {(r.a, r.b): r for r in knowledge.entity_graph(spark.createDataFrame(rows, "id long, entity string"), 0.0).collect()}
    assert abs(g["a", "b"].relatedness) < 0.01 and g["a", "c"].relatedness < -0.5 and g["a", "d"].relatedness == 0


def test_metrics(spark):
    m = relations.ranking_metrics(spark.createDataFrame([(1, 1, 0.0), (1, 2, 1.0), (1, 3, 1.0)], "query int, rank int, gain double"), 2).first()
    assert m.hit == 1 and m.mrr == 0.5 and m.ndcg == pytest.approx((1 / 1.58496) / (1 + 1 / 1.58496), abs=1e-4)


def test_guard():
    assert guard("SELECT ';' -- x;\n;") .startswith("SELECT")
    for bad in ("DROP TABLE x", "SELECT 1; SELECT 2", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "", "SET x = 1"):
        with pytest.raises(NotReadOnly):
            guard(bad)


def three(op, *xs):
    if op == "not":
        return None if xs[0] is None else not xs[0]
    if op == "and":
        return False if False in xs else None if None in xs else True
    return True if True in xs else None if None in xs else False


def test_random_predicates(spark):
    """Filters against a three-valued evaluator, over rows with nulls."""
    rng = random.Random(7)
    rows = [(i, *(rng.choice([None, 0.5, 1.0, 2.5]) for _ in range(3))) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double").cache()

    def tree(depth):
        if depth == 0 or rng.random() < 0.2:
            c, op, v = rng.choice("abc"), rng.choice(["<", ">=", "=", "<>", "isnull"]), rng.choice([0.5, 1.0, 2.0])
            at = "abc".index(c) + 1
            if op == "isnull":
                return f"{c} IS NULL", lambda r: r[at] is None
            f = {"<": lambda x: x < v, ">=": lambda x: x >= v, "=": lambda x: x == v, "<>": lambda x: x != v}[op]
            return f"{c} {op} {v}D", lambda r: None if r[at] is None else f(r[at])
        if rng.random() < 0.25:
            s, f = tree(depth - 1)
            return f"NOT ({s})", lambda r: three("not", f(r))
        op, (s, f), (t, g) = rng.choice(["and", "or"]), tree(depth - 1), tree(depth - 1)
        return f"({s}) {op.upper()} ({t})", lambda r: three(op, f(r), g(r))

    for _ in range(25):
        s, f = tree(3)
        assert sorted(r.id for r in df.filter(s).collect()) == [r[0] for r in rows if f(r) is True], s


def test_engine_errors(spark):
    t = spark.createDataFrame([("e", 1, 2.0)], "entity string, bucket long, hi double")
    d = spark.createDataFrame([], "id long, entity string, kind string, ts_start timestamp, ts_end timestamp, title string, body string")
    e = Engine(spark, t, d, 10, {"hi": 2})
    assert e.sql("SELECT telemetry.hi FROM telemetry WHERE hi > 1.999").count() == 0
    assert e.sql("SELECT t.hi FROM telemetry t WHERE t.hi >= 1.999 AND NOT match(notes, 'x')").count() == 1
    for bad in ("SELECT match(body, 'x') FROM telemetry", "SELECT * FROM intervals('hi > 1', gap => '1s')", "DELETE FROM telemetry"):
        with pytest.raises(ValueError):
            e.sql(bad)


def test_readers(spark):
    title, body = readers.html_text(F.lit("<html><head><title>A &amp; B</title><style>p{}</style></head><body><p>one <b>two</b></p><script>x()</script><div> </div>three</body></html>"))
    assert one(spark, title) == "A & B" and one(spark, body) == "one two\nthree"
    f = spark.createDataFrame([("a.md", "---\ntag: x\n---\n# H\n" + "long " * 30), ("b.txt", "\n".join(map(str, range(30))))], "file string, text string")
    m = {r.file: r for r in readers.frontmatter(f).collect()}
    assert m["a.md"].meta == {"tag": "x"} and m["a.md"].text.split("\n")[3] == "# H" and m["b.txt"].meta is None
    s = readers.markdown_sections(readers.frontmatter(f).select("file", "text")).collect()
    assert [(r.file, r.title, r.line) for r in s] == [("a.md", "H", 4), ("b.txt", "b.txt", 1), ("b.txt", "b.txt", 26)]
    p = spark.createDataFrame([("a/b.tmp",), ("keep.tmp",), ("build/x.c",), ("src/x.c",)], "p string")
    got = p.filter(~readers.ignored(F.col("p"), ["*.tmp", "!keep.tmp", "build/"])).collect()
    assert sorted(r.p for r in got) == ["keep.tmp", "src/x.c"]
    r = knowledge.resolve("stbd depht", spark.createDataFrame([("navigation.depth", "water", "m"), ("propulsion.starboard.rpm", None, "rpm")], "path string, description string, unit string"))
    assert {x.path for x in r.collect()} == {"navigation.depth", "propulsion.starboard.rpm"}


def test_sinks(spark):
    from tidemark.sources import sinks

    df = spark.createDataFrame([(1, "a|b"), (2, None), (3, "c")], "id int, x string").orderBy("id")
    assert sinks.shown(df, rows=2) == ("| id | x |\n|---|---|\n| 1 | a\\|b |\n| 2 |  |", True)
    assert sinks.shown(df, "csv", 5) == ("id,x\n1,a|b\n2,\n3,c", False)
    assert sinks.shown(df, "json", 5, 30)[1]
    a, b = sinks.shard_manifest(spark.createDataFrame([("e", 1, 2.0), ("e", 70000, 1.0)], "entity string, bucket long, v double")).orderBy("shard").collect()
    assert (a.shard, a.version, b.shard) == (0, 1, 1) and a.hash != b.hash
    assert "PushedFilters" in sinks.measured(spark.read.parquet("/root/testdata/sf0.001/orders.parquet").filter("o_orderkey > 5"))


def test_hybrid_edges(spark):
    from tidemark.operators import hybrid

    s = spark.createDataFrame([(1, "T", "bilge pump alarm", "a"), (2, "U", "pump", None), (3, "V", "wind", "b")], "id long, title string, body string, tag string")
    found, warning = hybrid.hybrid_search(s, "tag:a,b", metadata=("tag",))
    assert [(r.id, r.score) for r in found.collect()] == [(1, 0.0), (3, 0.0)] and warning is None
    with pytest.raises(ValueError):
        hybrid.hybrid_search(s, "pump", mode="hybrid_strict")
    assert [r.id for r in hybrid.hybrid_search(s, "pump -alarm -tag:b", metadata=("tag",))[0].collect()] == [2]
    assert hybrid.hybrid_search(s, "-pump")[0].count() == 0
    assert re.fullmatch(hybrid.one_edit_pattern("pump"), "pmup") and re.fullmatch(hybrid.one_edit_pattern("pump"), "pumps") and not re.fullmatch(hybrid.one_edit_pattern("pump"), "pimps")


def test_live_counters(spark, tmp_path):
    from tidemark.streaming import live

    rows = [("a", 1, 0, 2.0, False), ("a", 2, 0, 5.0, False), ("a", 2, 0, 5.0, False), ("a", 3, 3, 1.0, False), ("a", 4, 3, 3.0, False), ("a", 5, 3, 2.0, False)]
    df = spark.createDataFrame(rows, "series string, t long, s long, value double, delta boolean").select("series", F.timestamp_seconds("t").alias("ts"), F.timestamp_seconds("s").alias("start"), "value", "delta")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = live.counter_totals(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select(F.unix_seconds("ts").alias("t"), "total").collect()
    assert sorted((r.t, r.total) for r in got if r.total is not None) == [(1, 2), (2, 5), (3, 6), (4, 8)]
    assert [r.t for r in got if r.total is None] == [5]


def test_otlp_logs(spark):
    line = '{"resourceLogs":[{"resource":{"attributes":[{"key":"host.name","value":{"stringValue":"h"}}]},"scopeLogs":[{"logRecords":[{"timeUnixNano":"1700000000500000000","eventName":"e","body":{"stringValue":"text"}},{"observedTimeUnixNano":"1700000001000000000","body":{"stringValue":"more"}}]}]}]}'
    got = readers.otlp_logs(spark.createDataFrame([(line,)], "value string")).orderBy("ts_start").collect()
    assert [(r.entity, r.kind, r.title, r.body) for r in got] == [("otel.urn:h", "logbook", "e", "text"), ("otel.urn:h", "logbook", "log", "more")] and len({r.id for r in got}) == 2
