"""Backfill of a profile table from a folder of sample files: files that a manifest knows unchanged are skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.buckets import profile
from tidemark.scratch import stored
from tidemark.sources.readers import changes

_DAYS = "path string, hash string, day date"


class Backfill:
    """Keeps root/profile equal to the profile of all files under `source`, run after run.

    root/files says which file held which days at which content. A run reads the files that were added or changed to learn
    their days, aggregates these and the days of files that changed or went again, and replaces their partitions alone. A
    run that is broken off leaves the list of files as it was, so the next one does its work again.
    """

    def __init__(self, spark: SparkSession, source: str, root: str, width: int, scale: int = 2):
        self.spark, self.source, self.width, self.scale = spark, source, width, scale
        self.table, self.files = f"{root}/profile", f"{root}/files"

    def _known(self) -> DataFrame:
        try:
            return self.spark.read.schema(_DAYS).parquet(self.files)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], _DAYS)
            raise

    def _now(self) -> DataFrame:
        """(path, hash) of the files, with paths as scans give them."""
        f = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(self.source)
        return f.select(F.col("_metadata.file_path").alias("path"), F.sha2("content", 256).alias("hash"))

    def run(self) -> list[str]:
        """Brings the table up to date; the paths of the files that were read, those of unchanged files not among them."""
        known, now = self._known(), stored(self._now(), "manifest")
        before = known.select("path", "hash").distinct()
        changed = stored(changes(before, now), "changes")
        fresh = [r.path for r in changed.filter("change != 'deleted'").collect()]
        if not changed.limit(1).count():
            return []
        day = F.to_date("ts").alias("day")
        samples = self.spark.read.parquet(self.source)
        read = self.spark.read.schema(samples.schema).parquet(*fresh) if fresh else samples.limit(0)
        days = read.select(F.col("_metadata.file_path").alias("path"), day).distinct() if fresh else self.spark.createDataFrame([], "path string, day date")
        listed = stored(known.join(changed, "path", "left_anti").unionByName(now.join(changed.select("path"), "path", "left_semi").join(days, "path", "left").select("path", "hash", "day")), "files")
        touched = days.select("day").union(known.join(changed, "path", "left_semi").select("day")).distinct()
        days_ = [r.day for r in touched.filter("day is not null").collect()]  # the days of one run
        out = profile(samples.filter(day.isin(days_)), self.width, self.scale).withColumn("day", F.to_date(F.timestamp_seconds(F.col("bucket") * self.width + 1_577_836_800)))
        if gone := set(days_) - {r.day for r in samples.select(day).filter(F.col("day").isin(days_)).distinct().collect()}:
            raise ValueError(f"no file holds samples of {sorted(gone)} any more: delete these partitions by hand")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self.table)
        listed.write.mode("overwrite").parquet(self.files)
        return sorted(fresh)
