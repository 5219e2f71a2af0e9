"""Sharding by fixed virtual slots.

Records hash into thousands of slots, bytes are summed per slot, and a versioned
slot-to-shard map says where each slot lives. Rebalancing edits the map and so
moves few slots; records never rehash. Only the map is ever held in one place.

Rows that share a key share a slot, and one key may hold a third of all rows. A
slot that holds more than ``1 / MOST_PIECES`` of all bytes is therefore cut by a
hash of the rows' positions into pieces of about that share, and each piece is a
slot of the map, numbered from ``N_SLOTS`` on: the map has at most ``N_SLOTS``
plus ``MOST_PIECES`` rows, whatever the keys.

Defined results: a null text has no bytes and the checksum of the empty text; a
row without doc_id hashes by its text; equal rows get different positions in any
order, and where they are over a slot's share they are dealt to several shards; an empty table gives no rows and a map without slots; further columns of
the input are ignored by the query and kept by :func:`assign`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from telespan.llm.base import documents, query, whole_text
from telespan.scratch import materialize

N_SLOTS = 4096
MOST_PIECES = 1024
N_SHARDS = 24
ROW_BYTES = 8


def slot_of(key: Column, instead: Column, n_slots: int = N_SLOTS) -> Column:
    """Fixed for ever by the key; ``instead`` is hashed where the key is null."""
    return F.pmod(F.xxhash64(key, F.when(key.isNull(), instead)), F.lit(n_slots)).cast("int")


def slot_sizes(rows: DataFrame) -> DataFrame:
    """slot, bytes, n_rows of rows that have columns slot and size."""
    return rows.groupBy("slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))


def cut_slots(rows: DataFrame, sizes: DataFrame, n_slots: int = N_SLOTS, most: int = MOST_PIECES) -> DataFrame:
    """Rows with ``slot`` replaced by its piece where ``sizes`` has the slot over its share.

    ``spread`` is a number that differs between the rows of a slot.
    """
    total = sizes.agg(F.sum("bytes").alias("all"))
    share = F.ceil(F.col("bytes") * F.lit(1.0) * most / F.nullif(F.col("all"), F.lit(0)))
    over = sizes.crossJoin(total).select(F.col("slot").alias("_slot"), share.alias("_pieces")).where("_pieces > 1")  # by a single row
    piece = F.pmod("spread", F.coalesce("_pieces", F.lit(1)))
    return (
        rows.join(F.broadcast(over), F.col("slot") == F.col("_slot"), "left")  # fewer than MOST_PIECES rows
        .withColumn("slot", (F.col("slot") + n_slots * piece).cast("int"))
        .drop("_slot", "_pieces", "spread")
    )


def _one_row(sizes: DataFrame, *more: str) -> DataFrame:
    """All slots, largest first, as an array in one row. There are at most N_SLOTS + MOST_PIECES of them."""
    item = F.struct((-F.col("bytes")).alias("neg"), "slot", *more)
    return sizes.agg(F.sort_array(F.collect_list(item)).alias("slots"))


def _add(loads: Column, at: Column, value: Column) -> Column:
    return F.transform(loads, lambda x, i: F.when(i == at, x + value).otherwise(x))


def first_map(sizes: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """Version 1: slots in falling order of bytes, each to the shard that has least so far."""
    state = F.struct(
        F.array_repeat(F.lit(0).cast("bigint"), n_shards).alias("loads"),
        F.array().cast("array<int>").alias("shards"),
    )

    def place(acc, s):
        at = (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int")
        return F.struct(
            _add(acc["loads"], at, -s["neg"]).alias("loads"),
            F.concat(acc["shards"], F.array(at)).alias("shards"),
        )

    folded = _one_row(sizes).select("slots", F.aggregate("slots", state, place).alias("end"))
    return folded.select(F.explode(F.arrays_zip("slots", "end.shards")).alias("x")).select(
        F.lit(1).alias("version"), F.col("x.slots.slot").alias("slot"), F.col("x.shards").alias("shard")
    )


def rebalance(old: DataFrame, sizes: DataFrame, n_shards: int, slack: float = 0.02) -> DataFrame:
    """The next version of a map for new sizes or more shards.

    A slot moves only if its shard holds more than the mean times 1 + slack and
    the emptiest shard stays within that. Slots new to the map go to the
    emptiest shard.
    """
    known = sizes.join(F.broadcast(old.select("slot", "shard", "version")), "slot", "left")
    current = known.groupBy("shard").agg(F.sum("bytes").alias("load"))
    loads = current.where("shard IS NOT NULL").agg(
        F.map_from_entries(F.collect_list(F.struct("shard", "load"))).alias("held")
    )
    limit = F.aggregate("slots", F.lit(0).cast("bigint"), lambda a, s: a - s["neg"]) / n_shards * (1 + slack)
    state = F.struct(
        F.transform(
            F.sequence(F.lit(0), F.lit(n_shards - 1)),
            lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0)).cast("bigint"),
        ).alias("loads"),
        F.array().cast("array<int>").alias("shards"),
    )

    def edit(acc, s):
        least = (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int")
        here, size = s["shard"], -s["neg"]
        home = here.isNotNull() & (here < n_shards)
        crowded = F.get(acc["loads"], here) > F.col("most")
        fits = F.get(acc["loads"], least) + size <= F.col("most")
        to = F.when(home & ~(crowded & fits), here).otherwise(least)
        held = F.transform(
            acc["loads"],
            lambda x, i: x
            + F.when(i == to, size).otherwise(F.lit(0))
            - F.when(home & (i == here), size).otherwise(F.lit(0)),
        )
        return F.struct(held.alias("loads"), F.concat(acc["shards"], F.array(to)).alias("shards"))

    one = _one_row(known, "shard").crossJoin(loads).withColumn("most", limit)  # two single rows
    version = old.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version"))
    return (
        one.select("slots", F.aggregate("slots", state, edit).alias("end"))
        .select(F.explode(F.arrays_zip("slots", "end.shards")).alias("x"))
        .select(F.col("x.slots.slot").alias("slot"), F.col("x.shards").alias("shard"))
        .crossJoin(version)  # a single row
        .select("version", "slot", "shard")
    )


def assign(rows: DataFrame, slot_map: DataFrame, order: list[str]) -> DataFrame:
    """Adds shard and position: gapless from 0 in each shard.

    Rows are numbered within their slot; a slot starts where the slots of the
    same shard before it end. No task sees more than one slot's rows at a time.
    """
    ahead = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.withColumn("start", F.coalesce(F.sum("n_rows").over(ahead), F.lit(0)))
    inside = Window.partitionBy("slot").orderBy(*order)
    return (
        rows.withColumn("in_slot", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts.select("slot", "shard", "start")), "slot")  # at most N_SLOTS + MOST_PIECES rows
        .withColumn("position", F.col("start") + F.col("in_slot"))
        .drop("start", "in_slot")
    )


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, slot, shard, position, map_version per document.

    Texts are read once: what the later steps need of a row is written first, and
    with it a hash of the row's position, so that it stays the same when a task
    or a scan is repeated.
    """
    text = whole_text()
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        slot_of(F.col("doc_id"), text).alias("slot"),
        F.xxhash64(F.monotonically_increasing_id()).alias("spread"),
    )
    rows = materialize(rows, "slot-rows")
    rows = cut_slots(rows, materialize(slot_sizes(rows), "slot-shares"))
    sizes = materialize(slot_sizes(rows), "slot-sizes")
    slot_map = materialize(first_map(sizes, n_shards), "slot-map")
    placed = assign(rows, slot_map.join(sizes, "slot"), ["doc_id", "text_crc32", "size"])
    return placed.withColumn("map_version", F.lit(1))


@query("op1_sharding")
def op1_sharding(spark, sf):
    """All documents in 24 shards of nearly equal bytes."""
    return shard_documents(documents(spark, sf)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("position").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("slot").alias("virtual_slot"),
        "map_version",
    )
