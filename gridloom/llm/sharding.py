"""Sharding over fixed virtual slots, with a versioned slot-to-shard map.

A record's hash gives its slot, for good. Bytes are summed for each slot, and a map says which shard holds each slot.
Rebalancing edits the map (a new version): records move only with a slot whose shard changes. Maps are stored under a
path, a folder for each version, and a stored version is never changed.
Everything here is DataFrame expressions; the map has as many rows as there are slots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise

SLOTS, SHARDS = 8192, 8


def slot_of(*keys: F.Column, slots: int = SLOTS) -> F.Column:
    """Slot of a record: 32 bits of a digest of its keys, modulo the number of slots."""
    text = F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def slot_sizes(records: DataFrame, slot: str = "virtual_slot", size: str = "size") -> DataFrame:
    return records.groupBy(slot).agg(F.sum(size).cast("long").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def build_map(sizes: DataFrame, shards: int = SHARDS, version: int = 1) -> DataFrame:
    """version, virtual_slot, shard, bytes, rows: slots from the largest on, each to the shard with the fewest bytes.

    Ties go to the lower shard and the lower slot; slots without bytes go to the shards in turn. One row holds the whole
    map on the way, which the number of slots bounds.
    """
    slots = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), F.col("virtual_slot"), F.col("rows"))))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<int>").alias("shards"))

    def put(state: F.Column, slot: F.Column) -> F.Column:
        least = F.array_position(state["loads"], F.array_min(state["loads"])) - 1
        to = F.when(slot["less"] == 0, F.pmod(slot["virtual_slot"], F.lit(shards))).otherwise(least).cast("int")
        loads = F.transform(state["loads"], lambda x, i: F.when(i == to, x - slot["less"]).otherwise(x))
        return F.struct(loads.alias("loads"), F.concat(state["shards"], F.array(to)).alias("shards"))

    whole = sizes.agg(slots.alias("slots")).select("slots", F.aggregate("slots", start, put)["shards"].alias("to"))
    rows = whole.select(F.explode(F.arrays_zip("slots", "to")).alias("r"))
    return rows.select(F.lit(version).alias("version"), F.col("r.slots.virtual_slot").alias("virtual_slot"), F.col("r.to").alias("shard"), (-F.col("r.slots.less")).alias("bytes"), F.col("r.slots.rows").alias("rows"))


def rebalance(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version of a map for `shards` shards, by moving few slots: shards with an even share or less keep
    all they have; each other one gives up its last slots (in slot order) beyond an even share, and those go to the
    shards below an even share, in turn by cumulated bytes. Adding a shard thus moves slots to that shard alone when the rest are even.
    """
    total = slot_map.agg((F.sum("bytes") / shards).alias("share"), F.max("version").alias("latest"))
    held = slot_map.crossJoin(F.broadcast(total))  # one row
    run = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("upto", F.sum("bytes").over(run))
    stays = (F.col("upto") <= F.col("share") * 1.0) & (F.col("shard") < shards)
    kept, moved = held.where(stays), held.where(~stays)
    spark = slot_map.sparkSession
    loads = spark.range(shards).select(F.col("id").cast("int").alias("shard")).join(kept.groupBy("shard").agg(F.sum("bytes").alias("load")), "shard", "left")
    every = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    room = loads.crossJoin(F.broadcast(total)).withColumn("room", F.greatest(F.col("share") - F.coalesce("load", F.lit(0)), F.lit(0.0)))
    room = room.withColumn("ends", F.sum("room").over(every)).select(F.col("shard").alias("to"), (F.col("ends") - F.col("room")).alias("begins"), "ends")
    out = moved.withColumn("at", F.sum("bytes").over(Window.partitionBy(F.lit(0)).orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes") / 2)
    placed = out.join(F.broadcast(room), (F.col("at") >= F.col("begins")) & (F.col("at") < F.col("ends")), "left").withColumn("shard", F.coalesce("to", F.lit(shards - 1)))
    pick = [(F.col("latest") + 1).alias("version"), "virtual_slot", "shard", "bytes", "rows"]
    return kept.select(*pick).unionByName(placed.select(*pick))


def with_all_slots(sizes: DataFrame, slots: int) -> DataFrame:
    """sizes with a row for each slot: a map made from them places whatever comes later."""
    every = sizes.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    filled = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("bytes", "rows")]
    return every.join(sizes, "virtual_slot", "left").select("virtual_slot", *filled)


def stored_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions stored under path, in order. Folders of writes that never finished do not count."""
    marks = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")
    found = marks.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(marks)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])


def save_map(slot_map: DataFrame, path: str) -> int:
    """Stores a map as a version of its own under path, and returns its number. A version that is stored already is an
    error, since records may lie where it says; what an unfinished write left is replaced. One writer at a time."""
    version = slot_map.agg(F.max("version")).first()[0]
    if version is None:
        raise ValueError("a map without slots has no version to store")
    if version in stored_versions(slot_map.sparkSession, path):
        raise ValueError(f"version {version} is stored already under {path}")
    slot_map.drop("version").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")  # as many rows as slots
    return version


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored map: the version asked for, or the latest one. One that is not stored is an error."""
    known = stored_versions(spark, path)
    wanted = version if version is not None else max(known, default=None)
    if wanted is None or wanted not in known:
        raise ValueError(f"no version {'' if version is None else version} of a map under {path}")
    rows = spark.read.schema("virtual_slot int, shard int, bytes long, rows long").parquet(f"{path}/version={wanted}")
    return rows.select(F.lit(wanted).alias("version"), "virtual_slot", "shard", "bytes", "rows")


def moved_slots(old: DataFrame, new: DataFrame) -> DataFrame:
    """virtual_slot, old_shard, new_shard, bytes, rows of each slot that two maps place differently. A slot that only
    one of them holds has a null on the other side; bytes and rows are the new map's, if it has the slot."""
    a = old.select("virtual_slot", F.col("shard").alias("old_shard"), F.col("bytes").alias("old_bytes"), F.col("rows").alias("old_rows"))
    b = new.select("virtual_slot", F.col("shard").alias("new_shard"), "bytes", "rows")
    both = a.join(b, "virtual_slot", "full").where(~F.col("old_shard").eqNullSafe(F.col("new_shard")))
    return both.select("virtual_slot", "old_shard", "new_shard", F.coalesce("bytes", "old_bytes").alias("bytes"), F.coalesce("rows", "old_rows").alias("rows"))


def shard_records(records: DataFrame, slot_map: DataFrame, order: list[str]) -> DataFrame:
    """records (with virtual_slot), their shard and place in it, gapless from 0 (what lies in the shard's slots
    before, then the rank within the slot by `order`), and the map's version. `rows` of the map are those of records."""
    run = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.select("virtual_slot", "shard", F.col("version").alias("map_version"), F.coalesce(F.sum("rows").over(run), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(*order))
    placed = records.withColumn("nth", nth).join(F.broadcast(starts), "virtual_slot")  # as many rows as slots
    return placed.withColumn("slot", (F.col("before") + F.col("nth") - 1).cast("long")).drop("nth", "before")


def assign(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, doc_id: str = "doc_id", text: str = "text", maps: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version for each row of docs.

    Law `bytes`: the shards' sums of size are near equal. Equal texts of different ids lie in different slots, so a
    large group of copies is spread. Null text: size 1, checksum 0. Null ids hash by checksum and size. Equal rows
    share a slot and take successive places. An empty table gives an empty table.

    maps: a path of stored maps in a shared folder. If one is there, the latest says where slots lie, whatever
    `shards` is, so records of later tables go where those of earlier ones are, and the law holds as far as sizes are
    spread as they were; `rebalance` and `save_map` make the next one. If there is none, or without maps, a new map is
    made from these sizes (and stored as version 1). A stored map of another number of slots is an error.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    thin = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(value).cast("long") + 1).alias("size"), F.crc32(value.cast("binary")).alias("text_crc32"))
    thin = materialise(thin.withColumn("virtual_slot", slot_of(F.col("doc_id"), F.col("text_crc32"), F.col("size"), slots=slots)), "records")
    spark, sizes = docs.sparkSession, with_all_slots(slot_sizes(thin), slots)
    if maps is None or not stored_versions(spark, maps):
        slot_map = materialise(build_map(sizes, shards), "slot-map")
        if maps is not None:
            save_map(slot_map, maps)
    else:
        latest = load_map(spark, maps).select("version", "virtual_slot", "shard")
        held = latest.agg(F.count(F.lit(1)), F.max("virtual_slot")).first()
        if tuple(held) != (slots, slots - 1):
            raise ValueError(f"the latest map under {maps} is not one of {slots} slots")
        slot_map = materialise(latest.join(sizes, "virtual_slot"), "slot-map")
    placed = shard_records(thin, slot_map, ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = """
WITH RECURSIVE t AS (SELECT list(list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) tab FROM range(256) r(n)),
d AS (SELECT row_number() OVER () rid, doc_id, encode(coalesce(text, '')) raw FROM documents),
h AS (SELECT rid, doc_id, octet_length(raw)::BIGINT + 1 size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(raw), '..'), lambda p: ('0x' || p)::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT text_crc32 FROM d, t),
r AS (SELECT *, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || text_crc32::VARCHAR || '|' || size::VARCHAR), 1, 8))::BIGINT % 8192)::INTEGER virtual_slot FROM h),
z AS (SELECT virtual_slot, sum(size)::BIGINT bytes, count(*) n, row_number() OVER (ORDER BY sum(size) DESC, virtual_slot) k FROM r GROUP BY virtual_slot),
m AS (SELECT 0::BIGINT k, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[] loads, 0 AS to_ UNION ALL
  SELECT z.k, list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + bytes ELSE x END), list_position(loads, list_min(loads)) FROM m JOIN z ON z.k = m.k + 1),
p AS (SELECT virtual_slot, to_ - 1 AS shard, coalesce(sum(n) OVER (PARTITION BY to_ ORDER BY virtual_slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m JOIN z USING (k))
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard::INTEGER shard, (before + row_number() OVER (PARTITION BY r.virtual_slot ORDER BY doc_id, text_crc32, size) - 1)::BIGINT AS slot, NULL::INTEGER grown_shard, r.virtual_slot, 1 AS map_version
FROM r JOIN p ON r.virtual_slot = p.virtual_slot
"""
