"""Longest-processing-time sharding of groups that must stay together.

Groups (equal texts) sorted by size go one by one to the least-loaded shard, kept in a heap. Groups of
one size are dealt as one run: the shards whose loads lie within one size of the least take turns
until the next shard's load is reached, so a run is at most one cycle of turns per shard, whatever the
number of its groups. The driver reads the sizes from large to small, holds the heap and one block of
the cycles, and writes them; k different sizes need at least k^2 / 2 bytes of text, so 100 TB have 14
million at most. Each group takes the turn of its rank among the groups of its size: groups fall into
packs by hash, pack counts give each pack its first rank, and groups are ranked inside their pack only.

Slots number the rows of a shard without gaps in the same way: rows fall into buckets by hash, bucket
counts give each bucket its first slot. Groups with more than 1/1000 of all rows are at most 1000; they
meet their rows by broadcast, so that no task holds all copies of a text.

Defined cases: a null text has no bytes and stays with the empty texts; repeated rows are rows of
their own and stay together; very long texts are sizes like any other and leave the row by their
digest; an empty table gives no rows; null ids rank first; extra columns are ignored.
"""

import heapq

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import fresh_path, stage
from .files import Written
from .words import whole

SHARDS = 8
PER_BUCKET = 2_000
HOT_SHARE = 1_000
CYCLES = 100_000  # sizes whose cycles are written at a time
PLAN = pa.schema(
    [("bytes", pa.int64()), ("turns", pa.list_(pa.struct([("start", pa.int64()), ("shards", pa.list_(pa.int32()))])))]
)


def deal(size, count, heap):
    """[(start, shards)] for ``count`` groups of one size: from the group of rank ``start`` on the
    shards take turns. ``heap`` holds (load, shard) and is brought up to date."""
    turns, start = [], 0
    while start < count:
        cycle = [heapq.heappop(heap)]
        least = cycle[0][0]
        while heap and heap[0][0] < least + size:
            cycle.append(heapq.heappop(heap))
        n = count - start
        if heap:
            n = min(n, (heap[0][0] - least) // size * len(cycle))
        turns.append((start, [shard for _, shard in cycle]))
        for i, (load, shard) in enumerate(cycle):
            heapq.heappush(heap, (load + size * (n // len(cycle) + (i < n % len(cycle))), shard))
        start += n
    return turns


def write_turns(sizes, path, shards):
    """Deal runs of (bytes, groups), largest first, and write the turns of each size."""
    heap = [(0, s) for s in range(shards)]
    out = Written(f"{path}/turns.parquet")
    with pq.ParquetWriter(out.out, PLAN) as file:
        block = []
        for size, count in sizes:
            turns = [{"start": start, "shards": cycle} for start, cycle in deal(size, count, heap)]
            block.append({"bytes": size, "turns": turns})
            if len(block) == CYCLES:
                file.write_table(pa.Table.from_pylist(block, PLAN))
                block = []
        file.write_table(pa.Table.from_pylist(block, PLAN))
    out.close()


def _firsts(rows, key, bucket):
    """(key, bucket, first): rows of the key in lower buckets."""
    before = W.partitionBy(key).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy(key, bucket).agg(F.count(F.lit(1)).alias("_n"))
    return counts.select(key, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))


def place_groups(groups, shards=SHARDS, per_bucket=PER_BUCKET):
    """(group_key, n, shard) of groups (group_key, n, bytes)."""
    spark = groups.sparkSession
    packs = max(1, -(-groups.count() // per_bucket))
    groups = groups.withColumn("pack", F.pmod(F.xxhash64("group_key"), F.lit(packs)))
    sizes = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("bytes"))
    path = fresh_path(spark, "shard-turns")
    write_turns(sizes.toLocalIterator(), path, shards)
    turns = spark.read.schema("bytes long, turns array<struct<start:long,shards:array<int>>>").parquet(path)
    # The turns meet the packs, not the groups: a size that most groups have is in many packs.
    dealt = _firsts(groups, "bytes", "pack").join(turns, "bytes")
    nth = F.row_number().over(W.partitionBy("bytes", "pack").orderBy("group_key"))
    ranked = groups.withColumn("_nth", nth).join(dealt, ["bytes", "pack"])
    ranked = ranked.withColumn("_rank", F.col("_first") + F.col("_nth") - 1)
    own = F.element_at(F.filter("turns", lambda t: t["start"] <= F.col("_rank")), -1)
    at = F.pmod(F.col("_rank") - own["start"], F.size(own["shards"])).cast("int")
    return ranked.select("group_key", "n", F.get(own["shards"], at).alias("shard"))


def shard_rows(docs, shards=SHARDS, per_bucket=PER_BUCKET):
    """(doc_id, size, text_crc32, group_key, shard, slot) of every row."""
    text = whole(F.col("text"))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("group_key"),
    )
    rows = stage(rows, "shard-rows")
    n_rows = rows.count()
    groups = rows.groupBy("group_key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    placed = stage(place_groups(stage(groups, "shard-groups"), shards, per_bucket), "shard-places")
    hot = F.col("n") * HOT_SHARE > n_rows
    many = F.broadcast(placed.filter(hot).select("group_key", "shard"))  # at most HOT_SHARE rows
    few = placed.filter(~hot).select("group_key", "shard")
    rows = rows.join(many, "group_key").unionByName(rows.join(many, "group_key", "left_anti").join(few, "group_key"))
    buckets = max(1, -(-n_rows // (shards * per_bucket)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "group_key"), F.lit(buckets)))
    rows = stage(rows, "shard-placed")
    rank = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "group_key"))
    ranked = rows.withColumn("_rank", rank).join(_firsts(rows, "shard", "bucket"), ["shard", "bucket"])
    return ranked.select(
        "doc_id", "size", "text_crc32", "group_key", "shard", (F.col("_first") + F.col("_rank") - 1).alias("slot")
    )
