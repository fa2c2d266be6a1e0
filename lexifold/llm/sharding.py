"""Operator 4: sharding by fixed virtual slots and a versioned slot-to-shard map (DataFrame functions only)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, stash, table

SHARDS = 24
SLOTS = 8192
#: Bytes that a record takes besides its text.
OVERHEAD = 8
#: Rows of a virtual slot that are numbered in one task, about.
PART = 1 << 20


def virtual_slot(doc_id: Column, slots: int = SLOTS) -> Column:
    """The fixed slot of a record: a hash of its doc_id alone (null has one too), the same for all versions of the map."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(OVERHEAD)).cast("long")


def slot_totals(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(vslot, bytes, rows) for every slot, empty ones included; records has vslot and size. At most `slots` rows."""
    found = records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(found, "vslot", "left").na.fill(0, ["bytes", "rows"])


def first_map(totals: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: equal ranges of slots, whatever they hold."""
    return totals.select(F.lit(1).alias("version"), "vslot", F.floor(F.col("vslot") * F.lit(shards) / F.lit(slots)).cast("int").alias("shard"))


def rebalance(totals: DataFrame, placed: DataFrame, shards: int) -> DataFrame:
    """The next version of a map: slots, largest first, move from their shard to the least loaded one wherever that lowers the
    larger of the two loads, or where their shard is no more; all others stay.

    A fold over one array of the slots, whose number is fixed; records are not touched.
    """
    slots = totals.join(placed, "vslot").select("version", F.struct((-F.col("bytes")).alias("o"), "vslot", "bytes", "shard").alias("s"))
    one = slots.groupBy().agg(F.max("version").alias("version"), F.array_sort(F.collect_list("s")).alias("slots"))
    loads = f"transform(sequence(0, {shards - 1}), k -> aggregate(filter(slots, s -> s.shard = k), 0L, (a, s) -> a + s.bytes))"
    best = "cast(array_position(a.loads, array_min(a.loads)) - 1 as int)"
    gains = f"s.shard >= {shards} or (s.bytes > 0 and array_min(a.loads) + s.bytes < get(a.loads, s.shard))"
    moved = f"named_struct('loads', transform(a.loads, (v, k) -> case when k = s.shard then v - s.bytes when k = {best} then v + s.bytes else v end), 'moves', concat(a.moves, array(named_struct('vslot', s.vslot, 'shard', {best}))))"
    fold = f"aggregate(slots, named_struct('loads', {loads}, 'moves', cast(array() as array<struct<vslot:int,shard:int>>)), (a, s) -> if({gains}, {moved}, a), a -> a.moves)"
    edits = one.select("version", F.explode(F.expr(fold)).alias("m")).select(F.col("m.vslot").alias("vslot"), F.col("m.shard").alias("to"))
    return placed.join(edits, "vslot", "left").select((F.col("version") + 1).alias("version"), "vslot", F.coalesce("to", "shard").alias("shard"))


def store_version(slot_map: DataFrame, path: str) -> None:
    """Add a version (version, vslot, shard) to a stored map, in a folder of its own."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """(version, vslot, shard) of the given or the newest version of a stored map; None where there is no map yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    stored = spark.read.schema("vslot int, shard int, version int").parquet(path).select("version", "vslot", "shard")
    return stored.where(F.col("version") == (stored.agg(F.max("version")).first()[0] if version is None else version))


def balanced_map(records: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(totals, map): totals per slot of records (vslot, size), and the newest version of the map stored at path, (version, vslot,
    shard). A new map begins with equal ranges as version 1. The stored map is edited for these records, and where slots move the
    edited map is stored as the next version. Without a path the map is kept in a place of its own in the shared folder."""
    spark = records.sparkSession
    path = path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    totals = stash(slot_totals(records, slots), "slot-totals")
    if load_map(spark, path) is None:
        store_version(first_map(totals, shards, slots), path)
    placed = load_map(spark, path)
    edited = stash(rebalance(totals, placed, shards), "edited-map")
    if edited.join(placed, ["vslot", "shard"], "left_anti").count():
        store_version(edited, path)
    return totals, load_map(spark, path)


def assign_shards(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Every row of docs as row (a struct of its columns), with size, text_crc32, vslot and shard, by the map stored at path.

    The law is `bytes`: shards hold near equal bytes. Null texts count 0 bytes and have crc 0; a null doc_id has a slot like
    any value; rows of one doc_id share their slot; an empty table gives no rows. The map has `slots` rows, which bounds the
    broadcast; records are not shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), record_size(F.col("text")).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), virtual_slot(F.col("doc_id"), slots).alias("vslot"))
    _, slot_map = balanced_map(docs.select(virtual_slot(F.col("doc_id"), slots).alias("vslot"), record_size(F.col("text")).alias("size")), shards, slots, path)
    return rows.join(F.broadcast(slot_map.select("vslot", "shard")), "vslot")


def place_in_shards(rows: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """rows (vslot, size, ...) with shard and slot, the place in the shard, without gaps from 0: after those of earlier virtual slots
    of the shard. A virtual slot of many rows is numbered in several parts, so that one doc_id that holds a third of all rows
    doesn't meet in one task."""
    rows = stash(rows.withColumn("at", F.monotonically_increasing_id()), "sharded-rows")
    totals, slot_map = balanced_map(rows.select("vslot", "size"), shards, slots, path)
    known = totals.join(slot_map, "vslot").select("vslot", "shard", (F.floor(F.col("rows") / PART) + 1).cast("int").alias("parts"))
    dealt = rows.join(F.broadcast(known), "vslot").withColumn("part", F.pmod(F.xxhash64("at"), F.col("parts")))
    ahead = Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("shard", "vslot", "part").agg(F.count("*").alias("n"))
    starts = sizes.select("vslot", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("vslot", "part").orderBy("at"))
    return dealt.withColumn("place", place).join(starts, ["vslot", "part"]).withColumn("slot", F.col("start") + F.col("place") - 1).drop("at", "parts", "part", "place", "start")


def op4_shard_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", record_size(F.col("text")).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), virtual_slot(F.col("doc_id")).alias("vslot"))
    placed = place_in_shards(rows)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"))
