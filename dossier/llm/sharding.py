"""Minimax contiguous partition of documents into shards (op8), DataFrame functions only.

Equal texts form a group that no cut splits. Groups are dealt by the text's hash to UNITS ordered units, so the number of
atomic sizes the cuts are chosen among is bounded while every group stays whole. The smallest feasible shard capacity is
binary-searched over the units' prefix sums, each guess checked greedily, and the cuts are made there. A unit as large as
an even share of what is left (a hot group) comes first in the order and gets a shard of its own, so that it doesn't set
the others' capacity. Within the capacity, cuts go where shards come nearest to even.

Slots are numbered without sorting a shard in one task: rows of a unit are dealt to PARTS parts by id hash, parts are
prefix-summed, and only rows of one unit and part are sorted together.

Defined results: a null text has 0 bytes, crc32 0, and groups with the empty text. Null ids are allowed. Equal rows get
slots of their own. Fewer units than shards leave shards empty. Empty tables give no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossier.llm.common import cut, table, utf8

SHARDS = 40
UNITS = 1 << 16
PARTS = 64
OVERHEAD = 16


def feasible(total: list[int], shards: int, capacity: int) -> bool:
    """Whether greedy filling needs at most `shards` shards; total: prefix sums from 0."""
    at = 0
    for _ in range(shards):
        if (end := bisect_right(total, total[at] + capacity) - 1) == len(total) - 1:
            return True
        if end == at:
            return False
        at = end
    return False


def least_capacity(sizes: list[int], shards: int) -> int:
    """The smallest capacity with which the ordered sizes fit into `shards` contiguous shards."""
    total = [0, *accumulate(sizes)]
    lo, hi = max([-(-total[-1] // shards), *sizes]), total[-1]
    while lo < hi:
        mid = (lo + hi) // 2
        if feasible(total, shards, mid):
            hi = mid
        else:
            lo = mid + 1
    return lo


def cuts(sizes: list[int], shards: int) -> list[int]:
    """Ends of the shards (numbers of sizes before each cut): none above the least capacity, and as even as that allows."""
    capacity = least_capacity(sizes, shards)
    total = [0, *accumulate(sizes)]
    # earliest end of each shard such that the rest still fits behind it
    earliest, at = [len(sizes)], len(sizes)
    for _ in range(shards - 1):
        at = bisect_left(total, total[at] - capacity)
        earliest.append(at)
    earliest.reverse()
    out, at = [], 0
    for k in range(shards - 1):
        ideal = total[at] + (total[-1] - total[at]) / (shards - k)
        j = bisect_left(total, ideal)
        if j > 0 and (j == len(total) or ideal - total[j - 1] <= total[j] - ideal):
            j -= 1
        last = bisect_right(total, total[at] + capacity) - 1
        at = min(max(j, earliest[k], at), last)
        out.append(at)
    return [*out, len(sizes)]


def shard_of_units(units: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """(unit, its place in the order, its shard) for (unit, size) pairs."""
    left, weight = sorted(units), sum(s for _, s in units)
    alone = []
    for unit in sorted(units, key=lambda x: (-x[1], x[0])):
        if shards - len(alone) <= 1 or unit[1] * (shards - len(alone)) < weight:
            break
        alone.append(unit)
        weight -= unit[1]
    hot = {u for u, _ in alone}
    rest = [x for x in left if x[0] not in hot]
    out = [(u, i, i) for i, (u, _) in enumerate(alone)]
    if rest:
        shard, ends = 0, cuts([s for _, s in rest], shards - len(alone))
        for i, (u, _) in enumerate(rest):
            while i >= ends[shard]:
                shard += 1
            out.append((u, len(alone) + i, len(alone) + shard))
    return out


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    spark = docs.sparkSession
    text = utf8(F.col("text"))
    digest = F.sha2(text, 256)
    rows = docs.select(F.col("doc_id"), (F.length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text).alias("text_crc32"), F.conv(F.substring(digest, 1, 4), 16, 10).cast("int").alias("__unit"), digest.alias("__group"))
    spread = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), F.lit(PARTS)).cast("int")
    rows = cut(rows.withColumn("__part", spread), "shard")
    sizes = rows.groupBy("__unit").agg(F.sum("size").alias("n")).collect()  # bounded: UNITS rows
    placed = spark.createDataFrame(shard_of_units([(r[0], r[1]) for r in sizes], shards), "__unit int, __order int, shard int")
    placed = F.broadcast(placed)  # bounded: UNITS rows of three numbers
    cells = rows.groupBy("__unit", "__part").agg(F.count("*").alias("n")).join(placed, "__unit")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("__order", "__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = cells.select(F.col("__unit").alias("__u"), F.col("__part").alias("__p"), "shard", F.coalesce(before, F.lit(0)).alias("__offset"))
    within = F.row_number().over(Window.partitionBy("__unit", "__part").orderBy("__group", "doc_id")) - 1
    joined = rows.withColumn("__within", within).join(offsets, (F.col("__unit") == F.col("__u")) & (F.col("__part") == F.col("__p")))
    return joined.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("__offset") + F.col("__within")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
