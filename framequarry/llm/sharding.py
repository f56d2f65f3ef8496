"""Sharding through fixed virtual slots.

Records hash into thousands of fixed slots; bytes and rows are summed per slot (one partial aggregate, as many rows as
there are slots); a versioned slot-to-shard map, stored in a folder of its own, gives slots to shards. A new map deals
slots in turn (version 1) and is edited to what the slots then hold; every edit reads the latest version and writes the
next one beside it, so older versions stay readable. `grow` moves slots only into the new shard, `rebalance` moves as
few slots as it needs. Where a record goes never depends on anything but its slot and the map's version.

Law `bytes`: sizes of shards near equal. Rows of one text are a group that may hold a third of all rows, which no shard
of near equal size could take whole; slots hash the id with the text's checksum, so a group of copies is spread over all
slots, and so are rows of one id with different texts. Rows that share both, id and text, are told apart by nothing but
their place in the stored table, which deals them over slots as well.

Defined cases: a null text has size 1 and no checksum bytes (crc32 of nothing, 0); a null id hashes like a value of
its own, together with the text; equal rows get positions one after the other in their slot; an empty table gives no
rows; other columns of the input are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from framequarry.runtime import materialise, shared_dir

SLOTS = 4096
SHARDS = 8
MAP_SCHEMA = "version int, vslot int, shard int"
#: Copies of a row, id and text, that the hash of a row's place tells apart.
PLACES = 1024


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size and text_crc32 of each row; the text goes no further."""
    raw = F.coalesce(F.encode("text", "UTF-8"), F.lit("").cast("binary"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))


def with_slots(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Adds vslot to the rows of a stored table of `sized`.

    A record's slot is the hash of its id and checksum. Only where an id and text come more than once does the place in
    the stored table, which is the same whenever it is read, count too: for all rows of it but about one in PLACES.
    """
    one = rows.groupBy("doc_id", "text_crc32").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select(F.col("doc_id").alias("of_id"), F.col("text_crc32").alias("of_crc"))
    placed = rows.withColumn("place", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(PLACES)))
    met = placed.join(one, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_crc32") == F.col("of_crc")), "left")
    place = F.when(F.col("of_crc").isNotNull(), F.col("place")).otherwise(F.lit(0))
    return met.withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32", place), F.lit(slots)).cast("int")).drop("place", "of_id", "of_crc")


def slot_totals(rows: DataFrame) -> DataFrame:
    """Bytes and rows per virtual slot: never more rows than slots."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def deal(shards: int, slots: int = SLOTS) -> dict[int, int]:
    """First version of a map: slots in turn."""
    return {slot: slot % shards for slot in range(slots)}


def grow(current: dict[int, int], totals: dict[int, int], new_shard: int) -> dict[int, int]:
    """Next version with one more shard: slots move from the heaviest shards into the new one and nowhere else."""
    moved = dict(current)
    loads: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    for slot, shard in current.items():
        loads[shard] = loads.get(shard, 0) + totals.get(slot, 0)
        members.setdefault(shard, []).append(slot)
    for slots in members.values():
        slots.sort(key=lambda s: (totals.get(s, 0), s))
    target, got = sum(loads.values()) / (len(members) + 1), 0
    while got < target and any(members.values()):
        shard = max((s for s in members if members[s]), key=lambda s: (loads[s], -s))
        fits = [s for s in members[shard] if got + totals.get(s, 0) <= target]
        if not fits:
            break
        slot = fits[-1]
        members[shard].remove(slot)
        moved[slot] = new_shard
        loads[shard] -= totals.get(slot, 0)
        got += totals.get(slot, 0)
        if loads[shard] <= target and all(loads[s] <= target for s in members):
            break
    return moved


def rebalance(current: dict[int, int], totals: dict[int, int], tolerance: float = 0.01) -> dict[int, int]:
    """Next version after sizes have drifted: moves slots from the heaviest to the lightest shard until all lie within
    the tolerance of the mean or no move helps."""
    moved = dict(current)
    shards = sorted(set(current.values()))
    loads = {s: 0 for s in shards}
    for slot, shard in current.items():
        loads[shard] += totals.get(slot, 0)
    mean = sum(loads.values()) / len(shards)
    for _ in range(len(current)):
        high, low = max(shards, key=lambda s: (loads[s], -s)), min(shards, key=lambda s: (loads[s], s))
        gap = loads[high] - loads[low]
        if gap <= tolerance * mean:
            break
        slot = max((s for s, h in moved.items() if h == high and 0 < totals.get(s, 0) < gap), key=lambda s: (-abs(totals[s] - gap / 2), -s), default=None)
        if slot is None:
            break
        moved[slot] = low
        loads[high] -= totals[slot]
        loads[low] += totals[slot]
    return moved


class SlotMap:
    """The versions of one map, stored as tables in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def versions(self) -> list[int]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        done = (x.getPath() for x in files.listStatus(path) if files.exists(x.getPath().suffix("/_SUCCESS")))
        return sorted(int(p.getName()[1:]) for p in done)

    def table(self, version: int) -> DataFrame:
        """version, vslot and shard: as many rows as there are slots."""
        return self.spark.read.schema(MAP_SCHEMA).parquet(f"{self.folder}/v{version}")

    def placed(self, version: int) -> dict[int, int]:
        return {r["vslot"]: r["shard"] for r in self.table(version).collect()}

    def store(self, placed: dict[int, int]) -> int:
        """Writes the next version; one that another writer has just written is an error."""
        version = max(self.versions(), default=0) + 1
        rows = [(version, slot, shard) for slot, shard in sorted(placed.items())]
        self.spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("error").parquet(f"{self.folder}/v{version}")
        return version

    def edit(self, change) -> int:
        """Loads the latest version and stores what change makes of it as the next; none where nothing moves."""
        latest = max(self.versions())
        before = self.placed(latest)
        after = change(before)
        return self.store(after) if after != before else latest


def assign(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """Adds shard and the row's position in it, gapless from 0.

    Positions come in two levels: rows are numbered inside their virtual slot, and a slot starts where those before it
    in its shard end. No window spans more than a slot. placed: one version of the map; it has as many rows as there
    are slots, so it is broadcast.
    """
    counts = rows.groupBy("vslot").agg(F.count(F.lit(1)).alias("rows"))
    starts = F.broadcast(placed.select("vslot", "shard")).join(counts, "vslot", "inner")
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("vslot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("nth", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(starts), "vslot").withColumn("slot", (F.col("first") + F.col("nth")).cast("long")).drop("first", "nth")


def shard(docs: DataFrame, folder: str | None = None, shards: int = SHARDS, slots: int = SLOTS, tolerance: float = 0.0002) -> tuple[DataFrame, SlotMap, int]:
    """(rows with vslot, shard and slot; the stored map; its version that gave them).

    folder: where the map lives; it is made there if there is none, else its latest version is edited to these rows. By
    default a new one in the shared folder, which stays.
    """
    spark = docs.sparkSession
    stored = SlotMap(spark, folder or f"{shared_dir(spark)}/slot-maps/{uuid.uuid4().hex}")
    rows = materialise(with_slots(materialise(sized(docs), "sized"), slots), "slotted")
    totals = {r["vslot"]: r["bytes"] for r in slot_totals(rows).collect()}  # at most `slots` rows
    if not stored.versions():
        stored.store(deal(shards, slots))
    version = stored.edit(lambda placed: rebalance(placed, totals, tolerance))
    return assign(rows, stored.table(version)), stored, version


def shard_digests(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    rows, _, _ = shard(docs, shards=shards, slots=slots)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")
