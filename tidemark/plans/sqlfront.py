"""Read-only SQL over telemetry and documents: a pre-pass over the text, then Spark SQL.

It expands match(kind, 'text') and match(body, 'text'), intervals('condition', min_len => '..', max_gap => '..', entity => '..'), within_nm(lat, lon, nm),
in_bbox(lat0, lon0, lat1, lon1) and date_bin(INTERVAL '..' UNIT, ts[, origin]); all else is Spark's to parse.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.fixed import quantized
from tidemark.operators.intervals import intervals
from tidemark.operators.search import covered_buckets, match_docs, text_condition

_STRING = r"'(?:[^']|'')*'"
_QUOTED = re.compile(rf'{_STRING}|"[^"]*"|--[^\n]*|/\*.*?\*/', re.S)


#: Words that can follow a table's name and aren't its alias.
_CLAUSES = frozenset("WHERE JOIN ON USING GROUP ORDER LIMIT OFFSET LEFT RIGHT FULL INNER OUTER CROSS SEMI ANTI HAVING UNION WINDOW LATERAL EXCEPT INTERSECT MINUS NATURAL TABLESAMPLE PIVOT SORT CLUSTER DISTRIBUTE".split())


#: Beginnings of statements that write, as they can follow WITH or FROM.
_WRITES = re.compile(r"\bINSERT\s+(?:INTO|OVERWRITE)\b|\bUPDATE\s+[\w.`]+\s+(?:AS\s+\w+\s+)?SET\b|(?<!SELECT )(?<!, )\bDELETE\s+FROM\b|\bMERGE\s+INTO\b", re.I)


def _masked(sql: str) -> str:
    """The text with the insides of quotes and comments blanked out, so that places stay."""
    return _QUOTED.sub(lambda m: m[0][0] + "x" * (len(m[0]) - 2) + m[0][-1] if m[0][0] in "'\"" else " " * len(m[0]), sql)


def _flat(bare: str) -> str:
    """The text outside of all brackets."""
    out, depth = [], 0
    for c in bare:
        depth -= c == ")"
        out.append(c if depth <= 0 else " ")
        depth += c == "("
    return "".join(out)


class NotReadOnly(ValueError):
    pass


def guard(sql: str) -> str:
    """The statement without its final semicolon, if it is one query or EXPLAIN of one."""
    bare = _QUOTED.sub(lambda m: " " * len(m[0]) if m[0][:2] in ("--", "/*") else "x" * len(m[0]), sql)
    text = sql[: len(bare.rstrip().rstrip(";"))] if bare.rstrip().endswith(";") else sql
    bare = bare.rstrip().rstrip(";")
    words = re.findall(r"[A-Za-z]+", bare)
    first = words[0].upper() if words else ""
    if ";" in bare or first not in ("SELECT", "WITH", "VALUES", "EXPLAIN", "FROM", "TABLE"):
        raise NotReadOnly("tables are derived and read-only: one SELECT or EXPLAIN is what can run")
    flat = _flat(bare)
    own = re.match(r"\s*EXPLAIN\s+(?:(?:EXTENDED|FORMATTED|CODEGEN|COST)\s+)?(\w+)", flat, re.I)
    if _WRITES.search(flat) or own and own[1].upper() not in ("SELECT", "WITH", "VALUES", "FROM", "TABLE"):
        raise NotReadOnly("tables are derived and read-only: one SELECT or EXPLAIN is what can run")
    return text.strip()


def _args(text: str) -> list[str]:
    """Arguments between commas outside of quotes and brackets."""
    out, depth, start, i = [], 0, 0, 0
    while i < len(text):
        if m := _QUOTED.match(text, i):
            i = m.end()
            continue
        c = text[i]
        depth += c in "(["
        depth -= c in ")]"
        if c == "," and not depth:
            out.append(text[start:i].strip())
            start = i + 1
        i += 1
    return [*out, text[start:].strip()]


def _calls(sql: str, name: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, arguments) of the calls of a function, outside of quotes, last first."""
    masked = _QUOTED.sub(lambda m: "x" * len(m[0]), sql)
    found = []
    for m in re.finditer(rf"\b{name}\s*\(", masked, re.I):
        depth, i = 1, m.end()
        while i < len(masked) and depth:
            depth += masked[i] == "("
            depth -= masked[i] == ")"
            i += 1
        if depth:
            raise ValueError(f"{name}( isn't closed")
        found.append((m.start(), i, _args(sql[m.end() : i - 1])))
    return found[::-1]


def _text(arg: str) -> str:
    if not re.fullmatch(_STRING, arg):
        raise ValueError(f"a string literal is needed, not {arg}")
    return arg[1:-1].replace("''", "'")


class Engine:
    """SQL over telemetry(entity, bucket, ...) and docs, at a bucket width; scales give columns' fixed-point digits."""

    def __init__(self, spark: SparkSession, telemetry: DataFrame, docs: DataFrame, width: int, scales: dict[str, int] | None = None, position: tuple[str, str] = ("lat", "lon"), **tables: DataFrame):
        self.spark, self.width, self.scales, self.position = spark, width, scales or {}, position
        self.telemetry, self.docs = telemetry, docs
        self.tables = {"telemetry": telemetry, "docs": docs, **tables}

    def sql(self, text: str, args: list | dict | None = None, limit: int | None = None) -> DataFrame:
        """The query's rows; limit caps them for a display. Named and positional placeholders take args."""
        text, frames = guard(text), dict(self.tables)
        for a, b, x in _calls(text, "intervals"):
            name = f"__runs_{len(frames)}"
            frames[name] = self._intervals(x)
            text = f"{text[:a]}{name}{text[b:]}"
        frames["docs"], text = self._docs_matched(text)
        for a, b, x in _calls(text, "match"):
            if len(x) != 2 or x[0].lower() not in ("notes", "logbook", "alerts"):
                raise ValueError("match(notes | logbook | alerts, 'text') over telemetry, match(body, 'text') over docs")
            name = f"__hits_{len(frames)}"
            hits = self.docs.filter((F.col("kind") == x[0].lower()) & text_condition(F.col("body"), _text(x[1])))
            frames[name] = covered_buckets(hits, self.width).select(F.col("entity").alias("__entity"), F.col("bucket").alias("__bucket")).distinct()
            own = self._alias(text, "telemetry")
            text = f"{text[:a]}EXISTS (SELECT 1 FROM {name} WHERE __entity = {own}entity AND __bucket = {own}bucket){text[b:]}"
        lat, lon = self.position
        for a, b, x in _calls(text, "within_nm"):
            y, z, nm = (float(v) for v in x)
            if not 0 <= nm < float("inf"):
                raise ValueError("a radius must be finite and not negative")
            hav = f"(pow(sin(radians({lat} - {y}) / 2), 2) + cos(radians({lat})) * cos(radians({y})) * pow(sin(radians({lon} - {z}) / 2), 2))"
            cond = f"({lat} BETWEEN {y} - {nm / 60 * 1.01 + 1e-6} AND {y} + {nm / 60 * 1.01 + 1e-6} AND CASE WHEN {lat} IS NOT NULL AND {lon} IS NOT NULL THEN round(2 * 3440.065 * asin(sqrt(CASE WHEN {hav} > 1 THEN 1.0D ELSE {hav} END)), 9) <= {nm} END)"
            text = text[:a] + cond + text[b:]
        for a, b, x in _calls(text, "in_bbox"):
            y0, x0, y1, x1 = (float(v) for v in x)
            if y0 > y1:
                raise ValueError("latitudes are reversed")
            across = f"{lon} BETWEEN {x0} AND {x1}" if x0 <= x1 else f"({lon} >= {x0} OR {lon} <= {x1})"
            text = f"{text[:a]}({lat} BETWEEN {y0} AND {y1} AND {across}){text[b:]}"
        for a, b, x in _calls(text, "date_bin"):
            m = re.fullmatch(r"INTERVAL\s+'(\d+)\s*(\w*)'\s*(\w*)", x[0], re.I)
            if not m:
                raise ValueError("date_bin(INTERVAL 'n' UNIT, ts[, origin])")
            unit = (m[2] or m[3]).lower().rstrip("s")
            step = int(m[1]) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}[unit] * 1_000_000
            origin = f"unix_micros(CAST({x[2]} AS TIMESTAMP))" if len(x) > 2 else "0L"
            at = f"(unix_micros(CAST({x[1]} AS TIMESTAMP)) - {origin})"
            text = f"{text[:a]}CAST(timestamp_micros({at} - pmod({at}, {step}L) + {origin}) AS TIMESTAMP_NTZ){text[b:]}"
        text = self._membership(self._quantized(text))
        for name in frames:
            text = self._from(text, name)
        used = {n: f for n, f in frames.items() if f"{{{n}}}" in text}
        out = self.spark.sql(text, args, **used) if args is not None else self.spark.sql(text, **used)
        return out.limit(limit) if limit is not None else out

    @staticmethod
    def _from(text: str, name: str) -> str:
        """The frame in place of its name in FROM and JOIN, under that name unless an alias follows."""

        def put(m: re.Match) -> str:
            after = re.match(r"\s*(?:AS\s+)?([A-Za-z_]\w*)", text[m.end() :], re.I)
            own = after and after[1].upper() not in _CLAUSES
            return f"{m[1]}{{{name}}}" if own or name.startswith("__") else f"{m[1]}{{{name}}} AS {name}"

        return re.sub(rf"\b((?:FROM|JOIN)\s+|,\s*){name}\b(?!\s*[.(=<>])", put, text, flags=re.I)

    def _intervals(self, x: list[str]) -> DataFrame:
        named = {}
        for arg in x[1:]:
            k, sep, v = arg.partition("=>")
            if not sep or k.strip() not in ("min_len", "max_gap", "entity", "vessel"):
                raise ValueError(f"intervals() takes min_len, max_gap and entity by name, not {arg}")
            named["entity" if k.strip() in ("entity", "vessel") else k.strip()] = _text(v.strip())
        return intervals(self.telemetry, self._condition(_text(x[0])), self.width, **named)

    def _condition(self, text: str) -> Column:
        if ";" in _QUOTED.sub("", text):
            raise ValueError("a single condition is needed")
        return F.expr(self._membership(self._quantized(text)))

    def _docs_matched(self, text: str) -> tuple[DataFrame, str]:
        """docs with a score, and match(body, 'text') as a condition on them. Calls ANDed together must all match; scores add up; NOT leaves documents out."""
        calls = [c for c in _calls(text, "match") if c[2] and c[2][0].lower().split(".")[-1] == "body"]
        docs = self.docs
        if not calls:
            return docs, text
        if not re.search(r"\b(?:FROM|JOIN)\s+docs\b", _masked(text), re.I):
            raise ValueError("match(body, 'text') needs docs")
        score = F.lit(0.0)
        for i, (a, b, x) in enumerate(calls):
            if len(x) != 2:
                raise ValueError("match(body, 'text')")
            words, before = _text(x[1]), _masked(text)[:a]
            docs = docs.withColumn(f"__match_{i}", text_condition(F.col("body"), words))
            if not re.search(r"\bNOT\s*$", before, re.I):
                found = match_docs(self.docs, words).select("entity", "kind", "id", F.col("score").alias(f"__score_{i}"))
                docs, score = docs.join(found, ["entity", "kind", "id"], "left"), score + F.coalesce(F.col(f"__score_{i}"), F.lit(0.0))
            text = f"{text[:a]}{self._alias(text, 'docs')}__match_{i}{text[b:]}"
        return docs.select(*self.docs.columns, *[f"__match_{i}" for i in range(len(calls))], score.alias("score")), text

    @staticmethod
    def _alias(text: str, name: str) -> str:
        """How columns of a table are qualified: by its alias or its name, or not at all if it isn't in the text."""
        m = re.search(rf"\b(?:FROM|JOIN)\s+{name}\b(?:\s+(?:AS\s+)?([A-Za-z_]\w*))?", _masked(text), re.I)
        if not m:
            return ""
        return f"{m[1] if m[1] and m[1].upper() not in _CLAUSES else name}."

    def schema(self) -> DataFrame:
        """(table, position, column, type, digits): what can be asked; digits of fixed-point columns."""
        rows = [(n, i + 1, f.name, f.dataType.simpleString(), self.scales.get(f.name) if n == "telemetry" else None) for n, df in sorted(self.tables.items()) for i, f in enumerate(df.schema)]
        return self.spark.createDataFrame(rows, "table string, position int, column string, type string, digits int")

    def status(self) -> DataFrame:
        """(entity, buckets, first, last, documents): how far telemetry and documents reach."""
        t = self.telemetry.groupBy("entity").agg(F.count("*").alias("buckets"), F.min("bucket").alias("first"), F.max("bucket").alias("last"))
        d = self.docs.groupBy("entity").agg(F.count("*").alias("documents"))
        return t.join(d, "entity", "full").select("entity", F.coalesce("buckets", F.lit(0)).alias("buckets"), "first", "last", F.coalesce("documents", F.lit(0)).alias("documents"))

    def _quantized(self, text: str) -> str:
        """Decimal literals that are compared with a fixed-point column, as the column would hold them: by operators on either side, BETWEEN and IN; never inside quotes."""
        number = r"-?\d+\.\d+(?:[eE][+-]?\d+)?(?![\w.])"
        for c, s in self.scales.items():
            masked, own, op = _masked(text), rf"(?<![\w.])(?:\w+\.)?{re.escape(c)}\b", r"(?:<=>|<=|>=|<>|!=|=|<|>)"
            spans = []
            for rx in (rf"{own}\s*{op}\s*({number})", rf"(?<![\w.])({number})\s*{op}\s*{own}", rf"{own}\s+(?:NOT\s+)?BETWEEN\s+({number})\s+AND\s+", rf"{own}\s+(?:NOT\s+)?BETWEEN\s+[^()]*?\s+AND\s+({number})"):
                spans += [m.span(1) for m in re.finditer(rx, masked, re.I)]
            for m in re.finditer(rf"{own}\s+(?:NOT\s+)?IN\s*\(([^()]*)\)", masked, re.I):
                spans += [(m.start(1) + n.start(), m.start(1) + n.end()) for n in re.finditer(rf"(?<![\w.]){number}", m[1])]
            for a, b in sorted(set(spans), reverse=True):
                text = f"{text[:a]}{quantized(float(text[a:b]), s)!r}D{text[b:]}"
        return text

    def _membership(self, text: str) -> str:
        """An array column equal to a string is one that holds it."""
        lists = [f.name for f in self.telemetry.schema if f.dataType.typeName() == "array"]
        for c in lists:
            for m in reversed(list(re.finditer(rf"(?<![\w.])((?:\w+\.)?{re.escape(c)})\s*(=|<>|!=)\s*('x*')", _masked(text), re.I))):
                text = f"{text[: m.start()]}{'' if m[2] == '=' else 'NOT '}array_contains({m[1]}, {text[m.start(3) : m.end(3)]}){text[m.end() :]}"
        return text
