"""Readers: mapped Parquet, the raw tier, OTLP JSON, delta records, InfluxDB points, HTML, Markdown, frontmatter."""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.buckets import glob_regex


def mapped_time(c: Column, unit: str, zone: str = "UTC") -> Column:
    """A timestamp from seconds, millis, micros, nanos or an RFC 3339 text; naive clocks are of the zone."""
    if unit == "rfc3339":
        return F.try_to_timestamp(c)
    make = {"s": F.timestamp_seconds, "ms": F.timestamp_millis, "us": F.timestamp_micros}
    ts = F.timestamp_micros(F.floor(c / 1000).cast("long")) if unit == "ns" else F.timestamp_seconds(c) if unit == "s" else make[unit](c.cast("long")) if unit in make else F.to_utc_timestamp(c, zone)
    return ts


def mapped(df: DataFrame, time: str, unit: str, entity: str | None = None, constant: str = "", metric: str | None = None, value: str | None = None, exclude: Sequence[str] = (), zone: str = "UTC") -> DataFrame:
    """Samples (entity, path, ts, num) of a long table (metric and value columns) or a wide one (each other column a metric)."""
    who = F.col(entity).cast("string") if entity else F.lit(constant)
    base = df.select(who.alias("entity"), mapped_time(F.col(time), unit, zone).alias("ts"), *[c for c in df.columns if c not in (entity, time, *exclude)])
    if metric:
        return base.select("entity", F.col(metric).alias("path"), "ts", F.col(value).cast("double").alias("num")).filter("num is not null")
    numbers = [c for c in base.columns if c not in ("entity", "ts")]
    wide = base.select("entity", "ts", *[F.col(c).cast("double").alias(c) for c in numbers])
    return wide.unpivot(["entity", "ts"], numbers, "path", "num").filter("num is not null").select("entity", "path", "ts", "num")


def raw_view(*files: DataFrame) -> DataFrame:
    """(context, path, ts, value, value_str, source): files of scalars and of objects in one view; value_<k> columns become path.<k>."""
    parts = []
    for f in files:
        ts = F.coalesce(*[F.try_to_timestamp(F.col(c).cast("string")) for c in ("signalk_timestamp", "received_timestamp") if c in f.columns])
        base = f.withColumn("__ts", ts)
        keys = [c for c in f.columns if c.startswith("value_")]
        if "value" in f.columns:
            n = F.col("value").try_cast("double")
            parts.append(base.select("context", "path", F.col("__ts").alias("ts"), n.alias("value"), F.when(n.isNull(), F.col("value").cast("string")).alias("value_str"), "source"))
        if keys:
            long = base.select("context", "path", "__ts", "source", *[F.col(c).cast("double").alias(c) for c in keys]).unpivot(["context", "path", "__ts", "source"], keys, "k", "value")
            parts.append(long.filter("value is not null").select("context", F.concat_ws(".", "path", F.substring("k", 7, 1000)).alias("path"), F.col("__ts").alias("ts"), "value", F.lit(None).cast("string").alias("value_str"), "source"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_ATTRIBUTE = "array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>>>"
_POINT = f"struct<timeUnixNano:string,startTimeUnixNano:string,asInt:string,asDouble:double,sum:double,count:string,attributes:{_ATTRIBUTE}>"
_METRICS = f"resourceMetrics array<struct<resource:struct<attributes:{_ATTRIBUTE}>,scopeMetrics:array<struct<metrics:array<struct<name:string,unit:string,gauge:struct<dataPoints:array<{_POINT}>>,sum:struct<isMonotonic:boolean,aggregationTemporality:int,dataPoints:array<{_POINT}>>,histogram:struct<dataPoints:array<{_POINT}>>>>>>>>"
_LOGS = f"resourceLogs array<struct<resource:struct<attributes:{_ATTRIBUTE}>,scopeLogs:array<struct<logRecords:array<struct<timeUnixNano:string,observedTimeUnixNano:string,eventName:string,body:struct<stringValue:string>,attributes:{_ATTRIBUTE}>>>>>>"


def _attribute(attributes: Column, key: str) -> Column:
    v = F.get(F.filter(attributes, lambda a: a["key"] == key), F.lit(0))["value"]
    return F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"))


def _dimensional(name: Column, attributes: Column) -> Column:
    """name{k=v,...} with attributes in order of their keys; the bare name without any."""
    text = F.array_join(F.transform(F.array_sort(F.transform(F.coalesce(attributes, F.array().cast(_ATTRIBUTE)), lambda a: F.concat_ws("=", a["key"], F.coalesce(a["value"]["stringValue"], a["value"]["intValue"], a["value"]["doubleValue"].cast("string"), a["value"]["boolValue"].cast("string"))))), lambda x: x), ",")
    return F.when(text == "", name).otherwise(F.concat(name, F.lit("{"), text, F.lit("}")))


def otlp_metrics(payloads: DataFrame, column: str = "value", identity: Sequence[str] = ("host.name", "service.name")) -> DataFrame:
    """(entity, path, ts, start, num, monotonic, delta) of OTLP/JSON metric payloads; histograms give path.sum and path.count."""
    p = payloads.select(F.from_json(column, _METRICS).alias("m")).select(F.explode("m.resourceMetrics").alias("r")).select(F.col("r.resource.attributes").alias("ra"), F.explode("r.scopeMetrics").alias("s")).select("ra", F.explode("s.metrics").alias("m"))
    who = F.concat(F.lit("otel.urn:"), F.coalesce(*[_attribute(F.col("ra"), k) for k in identity], F.lit("unknown")))
    point = lambda c: F.transform(F.col(f"m.{c}.dataPoints"), lambda d: F.struct(F.lit(c).alias("kind"), d.alias("d")))
    none = F.array().cast(f"array<struct<kind:string,d:{_POINT}>>")
    flat = p.select(who.alias("entity"), "m", F.explode(F.concat(*[F.coalesce(point(c), none) for c in ("gauge", "sum", "histogram")])).alias("p"))
    path = _dimensional(F.col("m.name"), F.col("p.d.attributes"))
    number = F.coalesce(F.col("p.d.asDouble"), F.col("p.d.asInt").cast("double"))
    values = F.when(F.col("p.kind") == "histogram", F.array(F.struct(F.concat(path, F.lit(".sum")).alias("path"), F.col("p.d.sum").alias("num")), F.struct(F.concat(path, F.lit(".count")).alias("path"), F.col("p.d.count").cast("double").alias("num")))).otherwise(F.array(F.struct(path.alias("path"), number.alias("num"))))
    at = lambda c: mapped_time(F.col(c).cast("decimal(20,0)"), "ns")
    out = flat.select("entity", F.explode(values).alias("v"), at("p.d.timeUnixNano").alias("ts"), at("p.d.startTimeUnixNano").alias("start"), F.coalesce("m.sum.isMonotonic", F.lit(False)).alias("monotonic"), (F.coalesce("m.sum.aggregationTemporality", F.lit(0)) == 1).alias("delta"))
    return out.select("entity", "v.path", "ts", "start", "v.num", "monotonic", "delta").filter("num is not null")


def otlp_logs(payloads: DataFrame, column: str = "value", identity: Sequence[str] = ("host.name", "service.name")) -> DataFrame:
    """Logbook documents (id, entity, kind, ts_start, title, body) of OTLP/JSON log payloads; the id is a hash of their content."""
    p = payloads.select(F.from_json(column, _LOGS).alias("m")).select(F.explode("m.resourceLogs").alias("r")).select(F.col("r.resource.attributes").alias("ra"), F.explode("r.scopeLogs").alias("s")).select("ra", F.explode("s.logRecords").alias("l"))
    who = F.concat(F.lit("otel.urn:"), F.coalesce(*[_attribute(F.col("ra"), k) for k in identity], F.lit("unknown")))
    ts = mapped_time(F.coalesce("l.timeUnixNano", "l.observedTimeUnixNano").cast("decimal(20,0)"), "ns")
    d = p.select(who.alias("entity"), ts.alias("ts_start"), F.coalesce("l.eventName", F.lit("log")).alias("title"), F.coalesce("l.body.stringValue", F.lit("")).alias("body"))
    return d.select(F.sha2(F.concat_ws("\x1f", "entity", F.col("ts_start").cast("string"), "title", "body"), 256).substr(1, 16).alias("id"), "entity", F.lit("logbook").alias("kind"), "ts_start", "title", "body")


_DELTA = "context string, updates array<struct<`$source`:string,source:struct<label:string,type:string,src:string,pgn:string,talker:string>,timestamp:string,values:array<struct<path:string,value:string>>>>"


def deltas(lines: DataFrame, received: Column | None = None, own: str = "vessels.urn:self", skew_seconds: int = 300, allow: Sequence[str] = (), deny: Sequence[str] = (), allow_sources: Sequence[str] = (), deny_sources: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Samples (entity, path, source, ts, num, str) of NDJSON delta records in a `value` column, batch or streaming.

    Objects flatten to path.key (arrays and empty ones drop); a timestamp missing, invalid or more than skew_seconds from
    the time of receipt gives way to that; contexts `urn:x` become `vessels.urn:x`. Globs of paths and of sources allow (all,
    if none are given) and deny; a denial wins. Columns in `keep` are carried along.
    """
    d = lines.select(F.from_json("value", _DELTA).alias("d"), (received if received is not None else F.lit(None).cast("timestamp")).alias("rt"), *keep).select("d.context", "rt", *keep, F.explode("d.updates").alias("u")).select("context", "rt", *keep, F.col("u.`$source`").alias("s"), F.col("u.source").alias("so"), F.try_to_timestamp("u.timestamp").alias("ts"), F.explode("u.values").alias("v"))
    ctx = F.coalesce("context", F.lit(own))
    entity = F.when(ctx.startswith("urn:"), F.concat(F.lit("vessels."), ctx)).otherwise(ctx)
    late = F.col("ts").isNull() | (F.abs(F.unix_seconds("ts") - F.unix_seconds("rt")) > skew_seconds)
    ts = F.when(F.col("rt").isNotNull() & F.coalesce(late, F.lit(True)), F.col("rt")).otherwise(F.col("ts"))
    source = F.coalesce("s", F.concat_ws(".", "so.label", F.coalesce("so.src", "so.talker")))
    raw = F.col("v.value")
    fields = F.from_json(raw, "map<string,string>")
    pairs = F.when(raw.startswith("{"), F.transform(F.map_entries(fields), lambda e: F.struct(F.concat_ws(".", F.col("v.path"), e["key"]).alias("path"), e["value"].alias("x")))).otherwise(F.array(F.struct(F.col("v.path").alias("path"), raw.alias("x"))))
    flat = d.select(entity.alias("entity"), source.alias("source"), ts.alias("ts"), *keep, F.explode(pairs).alias("p")).filter("p.x is not null and not startswith(p.x, '[') and not startswith(p.x, '{')")
    fits = lambda c, globs: F.coalesce(functools.reduce(operator.or_, [c.rlike(glob_regex(g)) for g in globs]), F.lit(False))
    for c, yes, no in ((F.col("p.path"), allow, deny), (F.col("source"), allow_sources, deny_sources)):
        flat = flat.filter(fits(c, yes)) if yes else flat
        flat = flat.filter(~fits(c, no)) if no else flat
    n = F.expr("try_cast(p.x AS double)")
    return flat.select("entity", "p.path", "source", "ts", *keep, F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n).alias("num"), F.when(n.isNull(), F.col("p.x")).alias("str")).filter("num is not null or str is not null")


def influx_points(points: DataFrame) -> DataFrame:
    """Samples of points(measurement, context, source, time, value, lat, lon): a measurement with lat and lon gives path.latitude and path.longitude."""
    v = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.array(F.struct(F.concat("measurement", F.lit(".latitude")).alias("path"), F.col("lat").alias("num")), F.struct(F.concat("measurement", F.lit(".longitude")).alias("path"), F.col("lon").alias("num"))))
    v = v.otherwise(F.array(F.struct(F.col("measurement").alias("path"), F.col("value").alias("num"))))
    return points.select(F.col("context").alias("entity"), "source", F.col("time").alias("ts"), F.explode(v).alias("p")).select("entity", "p.path", "source", "ts", "p.num").filter("num is not null")


_BLOCK = "address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul"


def html_text(html: Column) -> tuple[Column, Column]:
    """(title, text) of a page, by regular expressions in the JVM: scripts, styles and comments go, block tags break lines, other tags vanish, common entities decode, blank lines go."""

    def decoded(c: Column) -> Column:
        for name, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
            c = F.replace(c, F.lit(name), F.lit(ch))
        return c

    title = F.trim(F.regexp_replace(decoded(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), r"[ \t\r\n]+", " "))
    body = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|head|noscript|template)\b.*?</\1\s*>", " ")
    body = F.regexp_replace(F.regexp_replace(body, rf"(?i)</?(?:{_BLOCK})\b[^>]*>", "\n"), r"<[^>]*>", "")
    lines = F.transform(F.split(decoded(body), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r]+", " ")))
    return title, F.array_join(F.filter(lines, lambda x: x != ""), "\n")


#: Lines of a piece of a Markdown section: at least, and at most if no blank line comes before; lines of a piece of another file.
PIECE, MOST, PLAIN = 30, 50, 25


def _sections(lines: list[str], least: int) -> list[tuple[str, int, list[str]]]:
    """(title, line, body lines): a section a `#` heading; what comes before the first is `Introduction`. Bodies of `least` bytes or fewer go."""
    cuts, title, line = [], "Introduction", 1
    body: list[str] = []
    for i, x in enumerate(lines):
        head = x.strip()
        if head.startswith("#") and head.lstrip("#").strip():
            cuts.append((title, line, body))
            title, line, body = head.lstrip("#").strip(), i + 1, []
        else:
            body.append(x)
    return [c for c in [*cuts, (title, line, body)] if len("\n".join(c[2]).strip().encode()) > least]


def _pieces(lines: list[str]) -> list[tuple[int, list[str]]]:
    """(place, lines): pieces of PIECE lines, drawn out to the next blank line, up to MOST; blank ones go."""
    out, at = [], 0
    while at < len(lines):
        end = min(at + PIECE, len(lines))
        while end < min(at + MOST, len(lines)) and lines[end].strip():
            end += 1
        if any(x.strip() for x in lines[at:end]):
            out.append((at, lines[at:end]))
        at = end
    return out


def markdown_sections(files: DataFrame, least: int = 100) -> DataFrame:
    """(file, title, line, body) of files(file, text): a section a `#` heading, long ones in parts of 30 to 50 lines; other files in chunks of 25 lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[str, str, int, str]] = []
            for name, text in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist(), strict=True):
                lines = [x.removesuffix("\r") for x in (text or "").removesuffix("\n").split("\n")]
                if (name or "").lower().endswith((".md", ".markdown")):
                    for title, line, body in _sections(lines, least):
                        parts = _pieces(body)
                        if len(parts) <= 1:
                            rows.append((name, title, line, "\n".join(body)))
                        else:
                            rows += [(name, f"{title} (Part {i + 1}/{len(parts)})", line + at, "\n".join(part)) for i, (at, part) in enumerate(parts)]
                else:
                    for a in range(0, len(lines), PLAIN):
                        if body := "\n".join(lines[a : a + PLAIN]).strip():
                            rows.append((name, name, a + 1, body))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], ["file", "title", "line", "body"])

    return files.select("file", "text").mapInArrow(run, "file string, title string, line long, body string")


def frontmatter(files: DataFrame) -> DataFrame:
    """files(file, text) with `meta` (a map of the `key: value` lines between leading --- lines) and the text with these lines blank, so that line numbers stay."""
    block = F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    entries = F.filter(F.transform(F.split(block, "\n"), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value"))), lambda e: e["value"] != "")
    n = F.size(F.split(block, "\n")) + 2
    blank = F.concat(F.repeat(F.lit("\n"), n - 1), F.regexp_replace("text", r"(?s)\A---\n.*?\n---", ""))
    return files.select("file", F.when(block != "", F.map_from_entries(entries)).alias("meta"), F.when(block != "", blank).otherwise(F.col("text")).alias("text"))


def ignored(path: Column, rules: Sequence[str]) -> Column:
    """Whether a path is left out by gitignore-like rules: `*` within a name, `**` across, a slash at the end for folders, `!` to take back; the last fitting rule decides."""
    out = F.lit(False)
    for rule in rules:
        keep, body = rule.startswith("!"), rule.lstrip("!")
        deep = body.strip("/")
        rx = "".join(".*" if t == "**" else "[^/]*" if t == "*" else "[^/]" if t == "?" else re.escape(t) for t in re.split(r"(\*\*|\*|\?)", deep))
        anchor = "^" if "/" in body.rstrip("/") else "(^|.*/)"
        out = F.when(path.rlike(f"{anchor}{rx}(/.*|$)" if not body.endswith("/") else f"{anchor}{rx}/.*"), F.lit(not keep)).otherwise(out)
    return out


def manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, modified, hash): files under a folder with their content's SHA-256, for change detection."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return f.select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("hash"))


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change): added, changed or deleted files of two manifests."""
    j = before.select("path", F.col("hash").alias("a")).join(now.select("path", F.col("hash").alias("b")), "path", "full")
    what = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "changed")
    return j.select("path", what.alias("change")).filter("change is not null")


