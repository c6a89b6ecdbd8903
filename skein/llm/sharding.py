"""Sharding through fixed virtual slots.

A record is hashed into one of `n_slots` (thousands) virtual slots; bytes are summed per slot; a versioned map says
which shard holds a slot. Only the map is edited when shards are added or loads change, so records move by whole slots.
The map has n_slots rows whatever the input, and is the only thing that reaches the driver, but for the list of heavy texts.

Version 1 of the map deals the slots in turn, before any load is known. It is stored; the loads are measured, and the
map is edited: slots move from the heaviest to the lightest shard until all are near equal. That is version 2; it is stored
too, read back, and used.

The slot is the hash of the text, so equal texts share a slot and a shard. Only a text whose copies alone hold more than
`hot_share` of a shard's fair load (n_shards / hot_share texts at most) is spread, over all slots by the hash of (id, copy
number), so that no group outweighs a shard; the other texts of its slot stay where they are.

A slot may also hold many rows of few bytes (empty texts, say). Its rows are numbered in pieces, as many as the slot has fair
row counts, so a task numbers about one n_slots-th of the rows whatever the slot holds; there are 2 * n_slots pieces at most.

Law: `bytes` (the sizes of shards are near equal). Edge cases: a null text has no bytes and size 1; repeated rows are
rows of their own; an empty table gives an empty table; ids may be null. Extra columns are ignored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._common import materialize, new_folder, text_of

N_SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """A version of the map: shard[i] holds slot i; hot texts, by hash, size and checksum, are spread by id."""

    version: int
    n_shards: int
    shard: tuple[int, ...]
    hot: frozenset[tuple[int, int, int]] = frozenset()

    def to_json(self) -> str:
        return json.dumps({"version": self.version, "n_shards": self.n_shards, "shard": list(self.shard), "hot": sorted(self.hot)})

    @staticmethod
    def from_json(text: str) -> SlotMap:
        x = json.loads(text)
        return SlotMap(x["version"], x["n_shards"], tuple(x["shard"]), frozenset(map(tuple, x["hot"])))

    def save(self, spark: SparkSession, folder: str) -> None:
        spark.createDataFrame([(self.version, self.to_json())], "version int, map string").coalesce(1).write.mode("append").parquet(folder)

    @staticmethod
    def load(spark: SparkSession, folder: str, version: int | None = None) -> SlotMap:
        stored = spark.read.parquet(folder)
        stored = stored.where(F.col("version") == version) if version else stored.orderBy(F.desc("version"))
        return SlotMap.from_json(stored.first()["map"])


def first_map(n_shards: int, n_slots: int = N_SLOTS) -> SlotMap:
    """Version 1: the slots in turn."""
    return SlotMap(1, n_shards, tuple(i % n_shards for i in range(n_slots)))


def rebalance(current: SlotMap, loads: dict[int, int], n_shards: int | None = None, tolerance: float = 0.0005, hot: frozenset[tuple[int, int, int]] | None = None) -> SlotMap:
    """The next version: slots of shards that are gone are placed, heaviest first, each in the lightest shard; then slots move from
    the heaviest to the lightest shard until all are within the tolerance. Others stay, so a new shard only takes what it lacks."""
    n_shards = n_shards or current.n_shards
    shard, held = list(current.shard), [set() for _ in range(n_shards)]
    for slot, s in enumerate(shard):
        if s < n_shards:
            held[s].add(slot)
    load = [sum(loads.get(i, 0) for i in x) for x in held]
    for slot in sorted((i for i, s in enumerate(shard) if s >= n_shards), key=lambda i: (-loads.get(i, 0), i)):
        low = min(range(n_shards), key=lambda s: (load[s], len(held[s]), s))
        held[low].add(slot)
        shard[slot] = low
        load[low] += loads.get(slot, 0)
    mean = sum(load) / n_shards
    for _ in range(len(shard)):
        high, low = max(range(n_shards), key=lambda s: (load[s], -s)), min(range(n_shards), key=lambda s: (load[s], s))
        gap = load[high] - load[low]
        fit = [i for i in held[high] if 0 < loads.get(i, 0) < gap]
        if gap <= tolerance * mean or not fit:
            break
        slot = min(fit, key=lambda i: (abs(loads[i] - gap / 2), i))
        held[high].remove(slot)
        held[low].add(slot)
        shard[slot] = low
        load[high] -= loads[slot]
        load[low] += loads[slot]
    return SlotMap(current.version + 1, n_shards, tuple(shard), current.hot if hot is None else hot)


def stored_map(spark: SparkSession, folder: str) -> SlotMap | None:
    """The latest version in the folder; None if there is none yet."""
    try:
        return SlotMap.load(spark, folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def _records(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    narrow = docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("long").alias("_size"), F.crc32(F.encode(text, "UTF-8")).alias("_crc"), F.xxhash64(text).alias("_x")
    )
    return narrow.groupBy("_id", "_size", "_crc", "_x").agg(F.count(F.lit(1)).alias("_rows"))


def hot_texts(records: DataFrame, least: int) -> frozenset[tuple[int, int, int]]:
    """Texts whose copies hold more than `least` bytes together: hash, size, checksum."""
    sums = records.groupBy("_x", "_size", "_crc").agg(F.sum(F.col("_size") * F.col("_rows")).alias("b")).where(F.col("b") > least)
    return frozenset((r["_x"], r["_size"], r["_crc"]) for r in sums.collect())


def _counted(df: DataFrame, n: Column, out: str) -> DataFrame:
    """Each row n times, with 0 to n - 1 in `out`; in two steps, so that no array is longer than 65536."""
    start = F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(65536).cast("long")))
    return df.withColumn("_start", start).withColumn(out, F.explode(F.sequence("_start", F.least(F.col("_start") + 65535, n - 1)))).drop("_start")


def _slotted(records: DataFrame, hot: frozenset[tuple[int, int, int]], n_slots: int) -> DataFrame:
    own = F.pmod(F.col("_x"), F.lit(n_slots)).cast("int")
    if not hot:
        return records.withColumn("_slot", own)
    is_hot = reduce(Column.__or__, [(F.col("_x") == x) & (F.col("_size") == size) & (F.col("_crc") == crc) for x, size, crc in sorted(hot)])
    return _counted(records, F.when(is_hot, F.col("_rows")).otherwise(F.lit(1).cast("long")), "_copy").select(
        "_id", "_size", "_crc", "_x", F.when(is_hot, F.lit(1).cast("long")).otherwise(F.col("_rows")).alias("_rows"),
        F.when(is_hot, F.pmod(F.xxhash64("_id", "_copy"), F.lit(n_slots)).cast("int")).otherwise(own).alias("_slot"),
    )


def slot_loads(records: DataFrame, hot: frozenset[tuple[int, int, int]], n_slots: int) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot: n_slots entries at most."""
    sums = _slotted(records, hot, n_slots).groupBy("_slot").agg(F.sum(F.col("_size") * F.col("_rows")).alias("b"), F.sum("_rows").alias("r"))
    return {x["_slot"]: (x["b"], x["r"]) for x in sums.collect()}


def in_pieces(slotted: DataFrame, rows: dict[int, int], n_slots: int) -> DataFrame:
    """With _piece: the rows of a slot are dealt by a hash into as many pieces as it has fair row counts."""
    total = sum(rows.values())
    several = [(s, -(-r * n_slots // total)) for s, r in sorted(rows.items()) if r * n_slots > total]
    counts = F.broadcast(slotted.sparkSession.createDataFrame(several, "_slot int, _pieces int"))  # under n_slots rows
    piece = F.pmod(F.xxhash64("_x", "_id", "_rows", F.lit("piece")), F.coalesce("_pieces", F.lit(1))).cast("int")
    return slotted.join(counts, "_slot", "left").withColumn("_piece", piece).drop("_pieces")


def shard_documents(
    docs: DataFrame, n_shards: int = 16, n_slots: int = N_SLOTS, hot_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text", map_folder: str | None = None
) -> DataFrame:
    """One row per row of docs: id, size, text_crc32, law, shard, slot (place in its shard, gapless from 0), grown_shard, virtual_slot, map_version.

    map_folder: where the map's versions are stored; a new folder of the shared one if it isn't given. A map that is stored there is
    edited (its slots are kept, n_slots doesn't count), for more or fewer shards as well; version 1 is only made where there is none."""
    spark = docs.sparkSession
    current = stored_map(spark, map_folder) if map_folder else None
    map_folder = map_folder or new_folder(spark, "slot-map")
    if current is None:
        current = first_map(n_shards, n_slots)
        current.save(spark, map_folder)
    n_slots = len(current.shard)
    records = materialize(_records(docs, id_col, text_col), "shard-records")
    total = records.agg(F.sum(F.col("_size") * F.col("_rows"))).first()[0] or 0
    hot = hot_texts(records, int(hot_share * total / n_shards))
    loads = slot_loads(records, hot, n_slots)
    rebalance(current, {s: b for s, (b, _) in loads.items()}, n_shards, hot=hot).save(spark, map_folder)
    plan = SlotMap.load(spark, map_folder)
    cut = in_pieces(_slotted(records, hot, n_slots), {s: r for s, (_, r) in loads.items()}, n_slots)
    rows = {(x["_slot"], x["_piece"]): x["r"] for x in cut.groupBy("_slot", "_piece").agg(F.sum("_rows").alias("r")).collect()}  # 2 * n_slots at most
    first, base = [0] * n_shards, []
    for slot, piece in sorted(rows):
        s = plan.shard[slot]
        base.append((slot, piece, s, first[s]))
        first[s] += rows[slot, piece]
    places = F.broadcast(spark.createDataFrame(base, "_slot int, _piece int, shard int, _base long"))  # a row a piece
    before = W.partitionBy("_slot", "_piece").orderBy("_id", "_x", "_size", "_crc", "_rows").rowsBetween(W.unboundedPreceding, W.currentRow)
    numbered = cut.withColumn("_last", F.sum("_rows").over(before)).join(places, ["_slot", "_piece"])
    return _counted(numbered, F.col("_rows"), "_copy").select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("_base") + F.col("_last") - F.col("_rows") + F.col("_copy")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("_slot").alias("virtual_slot"), F.lit(plan.version).alias("map_version"),
    )
