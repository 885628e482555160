"""Sharding by fixed virtual slots.

Every record hashes to one of a few thousand virtual slots, for ever. A versioned table says which
shard holds each slot; rebalancing and growing edit that table and move whole slots, so that no other
record moves. Version 0 deals slots round-robin; :func:`rebalance` adds a version after weighing the
slots; :func:`save_map` and :func:`load_map` keep all versions in a folder, from which the next run goes on. Everything is DataFrame functions. The map has ``slots`` rows whatever the input, so it is
broadcast, and the editing itself runs over arrays of at most ``slots`` entries.

Defined results: null text has size 1 (no bytes plus one) and the crc32 of no bytes; a null id hashes
as an own value. Rows that repeat an id *and* a text are numbered, and hash with their number, so they are dealt
evenly like all others, however many they are. Groups of equal texts are not kept together: a group may be larger than
a shard's share of bytes. An empty table gives an empty result.
Other columns of the input are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import exists, join_keyed, n_bytes, shared_dir, small, stored, table, utf8

SLOTS = 4096
SHARDS = 8
TOLERANCE = 0.005  #: of the mean load, by which shards may differ before a map is edited


def virtual_slot(h: Column, copy: Column, slots: int = SLOTS) -> Column:
    """The record's slot: a hash of what identifies it, the same on every run and for every map."""
    return F.pmod(F.when(copy == 0, h).otherwise(F.xxhash64(h, copy)), F.lit(slots)).cast("int")


def with_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot of every record.

    Records that repeat id and text are numbered from 0 by input partition, and within it by place; a window holds
    one partition's copies of a record at most.
    """
    records = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (n_bytes(F.col("text")) + 1).alias("size"),
        F.crc32(utf8(F.col("text"))).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("h", F.xxhash64("doc_id", "text_crc32"))
    records = stored(records.withColumn("part", F.shiftright("row", 33)), "records")
    repeated = stored(records.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    out = ["doc_id", "size", "text_crc32"]
    if repeated.isEmpty():
        return records.select(*out, virtual_slot(F.col("h"), F.lit(0), slots).alias("vslot"))
    copies = join_keyed(records, repeated, ["h"], "n")
    parts = copies.groupBy("h", "part").agg(F.count("*").alias("m"))
    before = stored(parts.select("h", "part", "m", (F.sum("m").over(W.partitionBy("h").orderBy("part")) - F.col("m")).alias("before")), "copies-before")
    place = F.row_number().over(W.partitionBy("h", "part").orderBy("row")) - 1
    numbered = join_keyed(copies, before, ["h", "part"], "m").select(*out, "h", (F.col("before") + place).alias("copy"))
    single = records.join(small(repeated.select("h")), "h", "left_anti").select(*out, "h", F.lit(0).cast("long").alias("copy"))
    return single.union(numbered).select(*out, virtual_slot(F.col("h"), F.col("copy"), slots).alias("vslot"))


def slot_weights(records: DataFrame) -> DataFrame:
    """Rows and bytes of each slot that holds any."""
    return records.groupBy("vslot").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def first_map(spark: SparkSession, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """Version 0 of the slot map: slots dealt round-robin."""
    return spark.range(slots).select(
        F.lit(0).alias("version"), F.col("id").cast("int").alias("vslot"), (F.col("id") % shards).cast("int").alias("shard")
    )


def balanced(slot_map: DataFrame, weights: DataFrame, shards: int = SHARDS) -> bool:
    """Whether the last version's shards hold equal bytes, but for TOLERANCE of the mean."""
    last = slot_map.agg(F.max("version")).first()[0]
    loads = slot_map.where(F.col("version") == last).join(weights, "vslot").groupBy("shard").agg(F.sum("bytes").alias("load"))
    most, least, total, n = loads.agg(F.max("load"), F.min("load"), F.sum("load"), F.count("*")).first()
    return not n or (n == shards and most - least <= TOLERANCE * total / shards)


def rebalance(slot_map: DataFrame, weights: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Add a version in which shards hold nearly equal bytes.

    Each shard above the mean releases slots, largest first, while they fit in what it has too much;
    the released slots go, largest first, to the shard that then holds least. Slots that need not move
    stay. ``shards`` may exceed the map's: the new shards begin empty.
    """
    last = slot_map.agg(F.max("version")).first()[0]
    now = slot_map.where(F.col("version") == last).join(weights, "vslot", "left").select("vslot", "shard", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    slot = F.struct((-F.col("bytes")).alias("minus"), F.col("vslot").alias("vslot"))
    by_shard = now.groupBy("shard").agg(F.sort_array(F.collect_list(slot)).alias("own"), F.sum("bytes").alias("load"))
    mean = (now.agg(F.sum("bytes")).first()[0] or 0) / shards
    nothing = F.expr("cast(array() as array<struct<minus:bigint,vslot:int>>)")
    freed = by_shard.select(
        "shard",
        "load",
        F.aggregate(
            "own",
            F.struct((F.col("load") - F.lit(mean)).alias("over"), nothing.alias("free")),
            lambda s, x: F.when((x["minus"] < 0) & (-x["minus"] <= s["over"]), F.struct((s["over"] + x["minus"]).alias("over"), F.concat(s["free"], F.array(x)).alias("free"))).otherwise(s),
        )["free"].alias("free"),
    ).withColumn("load", F.aggregate("free", F.col("load"), lambda left, x: left + x["minus"]))
    # One row that holds the loads of `shards` shards and at most `slots` freed slots.
    every = F.sequence(F.lit(0), F.lit(shards - 1))
    start = freed.agg(F.map_from_entries(F.collect_list(F.struct("shard", "load"))).alias("have"), F.sort_array(F.flatten(F.collect_list("free"))).alias("pool")).select(
        F.transform(every, lambda i: F.coalesce(F.element_at("have", i), F.lit(0)).cast("long")).alias("loads"), "pool"
    )

    def place(s: Column, x: Column) -> Column:
        to = F.array_position(s["loads"], F.array_min(s["loads"])).cast("int") - 1
        return F.struct(
            F.transform(s["loads"], lambda v, i: F.when(i == to, v - x["minus"]).otherwise(v)).alias("loads"),
            F.concat(s["moves"], F.array(F.struct(x["vslot"].alias("vslot"), to.alias("to")))).alias("moves"),
        )

    empty = F.expr("cast(array() as array<struct<vslot:int,to:int>>)")
    moves = (
        start.select(F.explode(F.aggregate("pool", F.struct(F.col("loads"), empty.alias("moves")), place)["moves"]).alias("m"))
        .select("m.vslot", "m.to")
    )
    edited = now.join(moves, "vslot", "left").select(F.lit(last + 1).alias("version"), "vslot", F.coalesce("to", "shard").cast("int").alias("shard"))
    return slot_map.unionByName(edited)


def save_map(slot_map: DataFrame, path: str) -> None:
    """Add the versions that the folder lacks; those it has are never written again."""
    spark = slot_map.sparkSession
    had = load_map(spark, path).agg(F.max("version")).first()[0] if exists(spark, path) else -1
    for version in [r[0] for r in slot_map.where(F.col("version") > had).select("version").distinct().orderBy("version").collect()]:
        slot_map.where(F.col("version") == version).drop("version").coalesce(1).write.parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str) -> DataFrame:
    """(version, vslot, shard) of all versions in the folder."""
    return spark.read.schema("vslot int, shard int, version int").parquet(path).select("version", "vslot", "shard")


def assign(records: DataFrame, slot_map: DataFrame, weights: DataFrame) -> DataFrame:
    """Shard and gapless position within the shard of every record, by the map's last version.

    Positions run through a shard slot by slot: the slot's offset comes from the slot weights, the
    place within the slot from a window over that one slot, never over a whole shard.
    """
    last = slot_map.agg(F.max("version")).first()[0]
    at = slot_map.where(F.col("version") == last).join(weights, "vslot")
    before = W.partitionBy("shard").orderBy("vslot").rowsBetween(W.unboundedPreceding, -1)
    at = at.select("vslot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy("vslot").orderBy("doc_id", "text_crc32")
    return records.join(F.broadcast(at), "vslot").withColumn("slot", F.col("offset") + F.row_number().over(inside) - 1)


def shard_documents(docs: DataFrame, slots: int = SLOTS, shards: int = SHARDS, map_path: str | None = None) -> DataFrame:
    """All records with their shard, by the slot map in ``map_path`` (a new folder by default).

    A folder without a map gets version 0; then a version is added if the last one is not balanced.
    """
    spark = docs.sparkSession
    records = stored(with_slots(docs, slots), "slotted")
    weights = stored(slot_weights(records), "slot-weights")
    path = map_path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    if not exists(spark, path):
        save_map(first_map(spark, slots, shards), path)
    if not balanced(load_map(spark, path), weights, shards):
        save_map(rebalance(load_map(spark, path), weights, shards), path)
    return assign(records, load_map(spark, path), weights)


def op8_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 8 shards of nearly equal bytes."""
    return shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot")
    )
