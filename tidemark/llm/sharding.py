"""Sharding by fixed virtual slots (operator 10), in DataFrame functions only.

Records hash into a fixed number of slots, far more than there are shards. Bytes are summed by slot, and a versioned map
gives each slot a shard: version 1 by longest-processing-time-first, later versions by edits that move few slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import scratch_path

SLOTS = 8192


def virtual_slot(key: Column, text: Column, slots: int = SLOTS) -> Column:
    """The slot of a record: the first 32 bits of its key's MD5, modulo slots; of its text's, if the key is null."""
    hashed = F.md5(F.coalesce(key.cast("string"), text, F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def sized(documents: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 8; a null text has none), text_crc32 and virtual_slot of each row."""
    text = F.coalesce("text", F.lit(""))
    return documents.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), virtual_slot(F.col("doc_id"), F.col("text"), slots).alias("virtual_slot")
    )


def slot_totals(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, bytes, rows) for every slot, also those without records: a table of fixed size."""
    sums = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(sums, "virtual_slot", "left").select("virtual_slot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("rows", F.lit(0)).alias("rows"))


def first_map(totals: DataFrame, shards: int) -> DataFrame:
    """(version, virtual_slot, shard, bytes, rows): slots from the largest down, each to the shard with the fewest bytes, then rows of slots, then number."""
    items = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot", "rows")))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<int>").alias("at"))

    def step(state: Column, item: Column) -> Column:
        # an empty slot counts as one byte here, so that spare slots spread too
        least = (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int")
        loads = F.transform(state["loads"], lambda x, i: F.when(i == least, x - F.least(item["less"], F.lit(-1))).otherwise(x))
        return F.struct(loads.alias("loads"), F.concat(state["at"], F.array(least)).alias("at"))

    dealt = totals.agg(items.alias("items")).select("items", F.aggregate("items", start, step)["at"].alias("at"))
    rows = dealt.select(F.explode(F.arrays_zip("items", "at")).alias("x"))
    return rows.select(F.lit(1).alias("version"), F.col("x.items.virtual_slot").alias("virtual_slot"), F.col("x.at").alias("shard"), (-F.col("x.items.less")).alias("bytes"), F.col("x.items.rows").alias("rows"))


def store_map(slot_map: DataFrame, path: str) -> None:
    """Adds a version to the map's table; a version that is there already is an error."""
    version = slot_map.select("version").first()[0]
    slot_map.drop("version").write.mode("error").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}").withColumn("version", F.lit(version))


def grow(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version, for one shard more: each old shard hands over its smallest slots up to its bytes beyond the new mean; no other slot moves."""
    mean = F.sum("bytes").over(Window.partitionBy()) / (shards + 1)  # over the map, which has a fixed size
    whole = F.sum("bytes").over(Window.partitionBy("shard"))
    sofar = F.sum("bytes").over(Window.partitionBy("shard").orderBy("bytes", "virtual_slot").rowsBetween(Window.unboundedPreceding, 0))
    marked = slot_map.select("*", (sofar <= whole - mean).alias("moves"))
    return marked.select((F.col("version") + 1).alias("version"), "virtual_slot", F.when(F.col("moves"), F.lit(shards)).otherwise(F.col("shard")).alias("shard"), "bytes", "rows")


def placed(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """records with shard and slot, the record's place in its shard, gapless from 0: by virtual slot, then doc_id, checksum and size.

    Places are counted within virtual slots and added to the rows of the slots before, so no task sorts a whole shard.
    """
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1))
    known = slot_map.select("virtual_slot", "shard", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(F.asc_nulls_first("doc_id"), "text_crc32", "size")) - 1
    return records.withColumn("own", own).join(F.broadcast(known), "virtual_slot").withColumn("slot", (F.col("before") + F.col("own")).cast("long")).drop("before", "own")  # the map has one row a slot


def sharded(documents: DataFrame, shards: int = 24, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Each row of documents(doc_id, text) with size, text_crc32, law, shard, slot, grown_shard, virtual_slot; stores version 1 of the map.

    Shards' bytes are near equal (law `bytes`). Null texts are empty; rows that repeat a doc_id share a virtual slot and
    keep their own places; rows with a null doc_id are dealt by text. An empty table gives an empty result.
    """
    spark = documents.sparkSession
    records = sized(documents, slots)
    path = path or scratch_path(spark, "slot_map")
    store_map(first_map(slot_totals(records, slots), shards), path)
    out = placed(records, load_map(spark, path, 1))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def write_shards(documents: DataFrame, placed_rows: DataFrame, path: str) -> None:
    """Writes the rows of documents by shard; a shard's files are split by virtual slot, so that no task writes a whole shard."""
    rows = documents.join(placed_rows.select("doc_id", "shard", "slot", "virtual_slot"), "doc_id")
    rows.repartition("virtual_slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
