"""Sinks: partitioned shards with content hashes, capped results for display, self-telemetry of streaming queries."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

#: Rows and bytes of a result that is shown.
ROWS, BYTES = 500, 64 * 1024


def write_shards(telemetry: DataFrame, path: str) -> None:
    """Telemetry by entity and shard (65,536 buckets); only the shards in the table are replaced."""
    t = telemetry.withColumn("shard", F.shiftright("bucket", 16))
    t.repartition("entity", "shard").sortWithinPartitions("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("entity", "shard").parquet(path)


def read_shards(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The shards' rows; bounds on buckets also bound the shards, so that other folders aren't listed."""
    t = spark.read.parquet(path)
    if first is not None:
        t = t.filter((F.col("bucket") >= first) & (F.col("shard") >= first >> 16))
    if last is not None:
        t = t.filter((F.col("bucket") <= last) & (F.col("shard") <= last >> 16))
    return t


def shard_manifest(telemetry: DataFrame) -> DataFrame:
    """(entity, shard, version, hash): rows and an order-free content hash of each shard."""
    t = telemetry.withColumn("shard", F.shiftright("bucket", 16))
    row = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(telemetry.columns)])
    return t.groupBy("entity", "shard").agg(F.count("*").alias("version"), F.hex(F.bit_xor(row)).alias("hash"))


def shown(df: DataFrame, form: str = "markdown", rows: int = ROWS, size: int = BYTES) -> tuple[str, bool]:
    """The first rows as json, csv or markdown, and whether some are left out."""
    got = df.limit(rows + 1).collect()
    cut, out, columns = len(got) > rows, io.StringIO(), df.columns
    lines: list[str] = []
    for r in got[:rows]:
        if form == "json":
            line = json.dumps(r.asDict(recursive=True), default=str)
        elif form == "csv":
            out.seek(0), out.truncate()
            csv.writer(out).writerow(r)
            line = out.getvalue().rstrip("\r\n")
        else:
            line = "| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |"
        if sum(map(len, lines)) + len(line) > size:
            cut = True
            break
        lines.append(line)
    head = [] if form == "json" else [",".join(columns)] if form == "csv" else ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return ("[" + ",\n".join(lines) + "]" if form == "json" else "\n".join([*head, *lines])), cut


def measured(df: DataFrame) -> str:
    """The plan with what is pushed to scans and read from them."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


class SelfTelemetry(StreamingQueryListener):
    """Progress of streaming queries as samples (entity, path, ts, num) of entity tidemark.urn:host:<host>."""

    def __init__(self, host: str, keep: int = 10_000):
        self.entity, self.rows, self.keep = f"tidemark.urn:host:{host}", [], keep

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        for path, value in (("rows.input", p.numInputRows), ("rate.processed", p.processedRowsPerSecond), ("batch.ms", p.durationMs.get("triggerExecution"))):
            if value is not None:
                self.rows.append((self.entity, f"{p.name or p.id}.{path}", p.timestamp, float(value)))
        del self.rows[: -self.keep]

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def samples(self, spark: SparkSession) -> DataFrame:
        df = spark.createDataFrame(self.rows, "entity string, path string, ts string, num double")
        return df.withColumn("ts", F.to_timestamp("ts"))
