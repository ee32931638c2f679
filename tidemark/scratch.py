"""Tables between the steps of a job, in the folder that driver and executors share, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few longs each, up to which a side of a join is broadcast (about 100 MB once hashed).
BROADCAST_ROWS = 1_000_000


def scratch_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode alone, where it may be unset, a new temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.conf.get("spark.master", None) or "").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/tidemark/{label}-{uuid.uuid4().hex}"


#: Spark's setting by which the shuffle files of an execution go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes the rows to the shared folder and returns the table read back: lineage ends there, and it survives lost executors.

    The write's shuffle files go with its end, as nothing refers to them any more.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, label), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored() tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "_tidemark_path", None)
        if path:
            jvm, spark = df.sparkSession._jvm, df.sparkSession
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The side marked for broadcast if it has at most `limit` rows; otherwise as it is, for a shuffled join. Counts the rows: give a stored table or a small one."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
