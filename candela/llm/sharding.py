"""Sharding (2) by fixed virtual slots, with DataFrame functions only.

A record's slot is a hash of its key, one of SLOTS, whatever else the table holds; bytes and rows are summed for each slot. A slot with more than its
share of either, as one of a group of equal rows, has several parts, entries of their own in the slot-to-shard map, over which its rows are dealt; the other
slots have one. The map places whole parts. Its versions have at most 2 * SLOTS rows each, whatever the data, so it is folded in one task and broadcast.
Rebalancing, to the same or another number of shards, writes a new version in which a part stays on its shard unless that shard would pass its
share of the bytes or is no more; a new part begins on the shard of its slot's first.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_path, stored

SLOTS = 8192  # fixed for the life of a data set
PART, LEAST_PART = 2, 4  # a part holds about PART times a slot's mean share of the rows and bytes, or the share of LEAST_PART mean rows if that is more
SLACK = 0.0005  # of a shard's share of the bytes that a rebalanced shard may exceed


def slot_of(*key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def slot_stats(records: DataFrame, *by: str) -> DataFrame:
    """slot_rows, slot_bytes of records(virtual_slot, part, size) by slot and part, or by the columns named: partial sums before the shuffle."""
    return records.groupBy(*(by or ("virtual_slot", "part"))).agg(F.count(F.lit(1)).alias("slot_rows"), F.sum("size").alias("slot_bytes"))


def first_map(n_shards: int, spark, slots: int = SLOTS) -> DataFrame:
    """Version 1, made before anything is known about the data: slots of one part, dealt in turn."""
    slot = F.col("id").cast("int").alias("virtual_slot")
    return spark.range(0, slots, 1, 1).select(slot, F.lit(0).alias("part"), F.pmod("id", F.lit(n_shards)).cast("int").alias("shard"), F.lit(1).alias("version"))


def rebalance(current: DataFrame, stats: DataFrame, n_shards: int, slack: float = SLACK) -> DataFrame:
    """The next version of a map, for shards 0 to n_shards - 1, however many there were. Slots are taken by bytes, largest first. A
    slot stays where it is if the shard is still there and has room for it within its share; otherwise it moves to the shard
    with the fewest bytes so far. Slots without records stay, or go to the remainder of their number by n_shards where
    their shard is no more. Parts are taken like slots; those that stats has no longer go, a slot's first apart. Ties go to the lower slot, part and shard."""
    first = current.filter("part = 0").select("virtual_slot", "version", F.col("shard").alias("first"))
    last = stats.groupBy("virtual_slot").agg(F.max("part").alias("last"))
    entries = first.join(last, "virtual_slot", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("last", F.lit(0)))))
    slots = (
        entries.join(current.select("virtual_slot", "part", "shard"), ["virtual_slot", "part"], "left").join(stats, ["virtual_slot", "part"], "left")
        .select("version", F.struct((-F.coalesce("slot_bytes", F.lit(0))).alias("minus"), F.col("virtual_slot").alias("slot"), "part", F.coalesce("shard", "first").alias("was")).alias("s"))
        .groupBy("version")
        .agg(F.sort_array(F.collect_list("s")).alias("slots"))
        .withColumn("room", F.expr(f"ceil(-aggregate(slots, 0L, (t, x) -> t + x.minus) / {n_shards}D * {1 + slack}D)"))
    )
    # load: bytes of each shard so far; to: the shard of each slot so far. A shard that is no more has no load: null.
    stays = "coalesce(try_element_at(a.load, x.was + 1) - x.minus <= room, false)"
    to = f"case when x.minus = 0 then if(x.was < {n_shards}, x.was, pmod(x.slot, {n_shards})) when {stays} then x.was else cast(array_position(a.load, array_min(a.load)) as int) - 1 end"
    fold = f"""aggregate(slots,
        named_struct('load', array_repeat(0L, {n_shards}), 'to', cast(array() as array<int>)),
        (a, x) -> named_struct(
            'load', transform(a.load, (b, i) -> b - if(i = {to}, x.minus, 0L)),
            'to', concat(a.to, array({to}))))"""
    return (
        slots.withColumn("folded", F.expr(fold))
        .select("version", F.explode(F.expr("arrays_zip(slots, folded.to)")).alias("z"))
        .select(F.col("z.slots.slot").alias("virtual_slot"), F.col("z.slots.part").alias("part"), F.col("z.to").alias("shard"), (F.col("version") + 1).alias("version"))
    )


def write_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the stored map; older versions stay readable for readers that began with them."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def read_map(spark, path: str, version: int | None = None) -> DataFrame:
    """One version of the stored map, the latest if none is named. Versions written before slots had parts have one for each."""
    maps = spark.read.option("mergeSchema", "true").parquet(path)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.filter(F.col("version") == version).select("virtual_slot", (F.coalesce("part", F.lit(0)) if "part" in maps.columns else F.lit(0)).alias("part"), "shard", "version")


def has_map(spark, path: str) -> bool:
    """Whether a map is stored there."""
    try:
        return not spark.read.parquet(path).isEmpty()
    except AnalysisException:
        return False


def with_parts(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """records(doc_id, size, text_crc32), a written table, with virtual_slot, of the key alone, and part.

    A slot has as many parts as its share of the table's rows or bytes asks for, and no more than rows. Its rows are dealt over them by
    key and by place in the table, as only the place tells equal rows apart."""
    rows = records.withColumn("virtual_slot", slot_of(F.col("doc_id"), F.col("text_crc32"), slots=slots))
    stats = stored(slot_stats(rows, "virtual_slot"), "sharding-shares")
    total = stats.agg(F.coalesce(F.sum("slot_rows"), F.lit(0)), F.coalesce(F.sum("slot_bytes"), F.lit(0))).first()
    most = max(PART / slots, LEAST_PART / max(1, total[0]))
    share = F.greatest(F.col("slot_rows") / (total[0] or 1), F.col("slot_bytes") / (total[1] or 1))
    parts = stats.select("virtual_slot", F.least(F.ceil(share / most), "slot_rows").cast("int").alias("parts")).filter("parts > 1")
    part = F.pmod(F.xxhash64("doc_id", "text_crc32", F.monotonically_increasing_id()), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = rows.join(F.broadcast(parts), "virtual_slot", "left")  # at most `slots` rows
    return stored(dealt.select("doc_id", "size", "text_crc32", "virtual_slot", part.alias("part")), "sharding-slots", records, stats)


def shard_documents(docs: DataFrame, n_shards: int = 8, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null), virtual_slot, map_version, part.

    Law: the shards' bytes are near equal. The slot hash covers doc_id and the text's CRC-32, so rows without
    an id spread too; the map tells the shards of the slot's parts. `slot` is the row's place in its shard, gapless from 0: rows before its part (from
    the map's sums), then its rank in the part. No window is wider than one part of a virtual slot. A map that is already at
    map_path is edited: its latest version is rebalanced to the data and n_shards, and the result is the next version.
    Null text: size 1, CRC-32 0. Repeated rows each get a place of their own; ties in a part are equal rows. Texts of any
    length count by their bytes. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    text = F.col("text")
    rows = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    rows = with_parts(stored(rows, "sharding-rows"), slots)
    stats = stored(slot_stats(rows), "sharding-stats")
    path = map_path or scratch_path(spark, "sharding-map")
    if not (map_path and has_map(spark, path)):
        write_map(first_map(n_shards, spark, slots), path)
    current = read_map(spark, path)
    if (found := current.filter("part = 0").count()) != slots:
        raise ValueError(f"the map at {path} has {found} slots, not {slots}: slots are fixed for the life of a data set")
    write_map(rebalance(current, stats, n_shards), path)
    before = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    places = (
        read_map(spark, path)
        .join(stats, ["virtual_slot", "part"])
        .withColumn("rows_before", F.coalesce(F.sum("slot_rows").over(before), F.lit(0)))
        .select("virtual_slot", "part", "shard", "version", "rows_before")
    )
    in_slot = Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("rank", F.row_number().over(in_slot) - 1)
        .join(F.broadcast(places), ["virtual_slot", "part"])  # at most 2 * `slots` rows
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rows_before") + F.col("rank")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"), "part",
        )
    )
