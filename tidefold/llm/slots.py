"""Sharding by fixed virtual slots.

Every record is hashed into one of ``SLOTS`` slots. Bytes and records are added up for each slot; a versioned map
says which shard holds a slot. Version 1 deals the slots in turn; rebalancing edits it: slots move one at a time
from the fullest to the emptiest shard while that evens out their bytes, and the result is stored as the next
version. Only the map, of SLOTS rows whatever the input, passes through the driver and is broadcast.

A record's place in its shard is the number of records in the shard's earlier slots plus its place in its own
slot (in order of id, then checksum and size), so no task sorts a whole shard. The law is ``bytes``: shards hold nearly
equal bytes. Groups of equal texts are therefore not kept together, as one may hold a third of all bytes: records are
dealt by id and checksum, so copies of different ids lie in different slots. Records of equal id and text (or both
null) cannot be told apart and share a slot, and where these alone hold more than a shard's share, the law is lost.

Null texts have no bytes, null ids hash like a value of their own; equal rows share a slot in any order; a very long
text moves with its slot, so shards are even up to the largest slot; an empty table has a map and no rows. Only
DataFrame functions touch the records; other columns stay with them in ``assign``, but for those named like the
operator's own results (text_crc32, size, virtual_slot, shard, slot), which are replaced.
"""

from __future__ import annotations

import bisect
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 8192


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """The frame with text_crc32, size (UTF-8 bytes and 1) and virtual_slot."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    df = df.withColumn("text_crc32", F.crc32(raw)).withColumn("size", F.octet_length(raw).cast("long") + 1)
    return df.withColumn("virtual_slot", F.pmod(F.xxhash64(F.col(id_col), F.col("text_crc32")), F.lit(slots)).cast("int"))


class SlotMap:
    """One version: the shard of each slot."""

    def __init__(self, shards: int, of: list[int], version: int = 1):
        self.shards, self.of, self.version = shards, of, version

    @classmethod
    def dealt(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        return cls(shards, [k % shards for k in range(slots)])

    def rebalanced(self, sizes: list[int], shards: int | None = None) -> SlotMap:
        """The next version, evened out for the given bytes of each slot. Over more shards, if given, slots move to the
        new ones only."""
        n, of = shards or self.shards, list(self.of)
        takers = range(self.shards, n) if n > self.shards else range(n)
        held: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        total = [0] * n
        for slot, s in enumerate(of):
            held[s].append((sizes[slot], slot))
            total[s] += sizes[slot]
        for h in held:
            h.sort()
        while True:
            full, empty = max(range(n), key=lambda k: (total[k], -k)), min(takers, key=lambda k: (total[k], k))
            half = (total[full] - total[empty]) // 2
            at = bisect.bisect_right(held[full], (half, len(of))) - 1
            if at < 0 or held[full][at][0] <= 0:
                if n > self.shards:
                    return SlotMap(n, of, self.version + 1)
                # No move helps: exchange two slots, if that takes off a tenth of a percent of a shard.
                gap, best = total[full] - total[empty], (max(1, sum(total) // n // 1000), -1, -1)
                for i, (size, _) in enumerate(held[full]):
                    j = bisect.bisect_left(held[empty], (size - gap // 2, -1))
                    if j < len(held[empty]) and 0 < (d := size - held[empty][j][0]) < gap and min(d, gap - d) > best[0]:
                        best = min(d, gap - d), i, j
                if best[1] < 0:
                    return SlotMap(n, of, self.version + 1)
                (a, x), (b, y) = held[full].pop(best[1]), held[empty].pop(best[2])
                bisect.insort(held[full], (b, y))
                bisect.insort(held[empty], (a, x))
                of[x], of[y] = empty, full
                total[full], total[empty] = total[full] - a + b, total[empty] + a - b
                continue
            size, slot = held[full].pop(at)
            bisect.insort(held[empty], (size, slot))
            of[slot] = empty
            total[full], total[empty] = total[full] - size, total[empty] + size

    def save(self, spark: SparkSession, path: str, rows: list[int] | None = None) -> None:
        """Write as ``path/version=N``: slot, shard, and the records of the shard's earlier slots if counts are given."""
        before, first = [0] * self.shards, []
        for slot, s in enumerate(self.of):
            first.append(before[s])
            before[s] += rows[slot] if rows else 0
        text = json.dumps([{"shard": s, "first": f} for s, f in zip(self.of, first)])
        one = spark.range(1, numPartitions=1).select(F.posexplode(F.from_json(F.lit(text), "array<struct<shard:int,first:bigint>>")).alias("virtual_slot", "x"))
        one.select("virtual_slot", "x.shard", "x.first").write.parquet(f"{path}/version={self.version}")


def load(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("virtual_slot int, shard int, first long").parquet(f"{path}/version={version}")


def plan(records: DataFrame, path: str, shards: int, slots: int = SLOTS) -> int:
    """Add up the slots of measured records, store the dealt map and the rebalanced one, and return its version."""
    spark = records.sparkSession
    sizes, rows = [0] * slots, [0] * slots
    for r in records.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():  # SLOTS rows at most
        sizes[r.virtual_slot], rows[r.virtual_slot] = r.b, r.n
    first = SlotMap.dealt(shards, slots)
    first.save(spark, path, rows)
    last = first.rebalanced(sizes)
    last.save(spark, path, rows)
    return last.version


def assign(records: DataFrame, path: str, version: int, id_col: str = "doc_id") -> DataFrame:
    """Measured records with their shard and slot (place in the shard, from 0 without gaps)."""
    own = Window.partitionBy("virtual_slot").orderBy(id_col, "text_crc32", "size")
    placed = records.drop("shard", "slot").withColumn("_own", F.row_number().over(own))
    where = load(records.sparkSession, path, version).select("virtual_slot", F.struct("shard", "first").alias("_place"))
    placed = placed.join(F.broadcast(where), "virtual_slot")
    return placed.withColumn("shard", F.col("_place.shard")).withColumn("slot", F.col("_place.first") + F.col("_own") - 1).drop("_own", "_place")


def write_shards(records: DataFrame, path: str) -> None:
    """Write assigned records, one folder for each shard; a shard's slots may go to many files."""
    records.repartition("virtual_slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
