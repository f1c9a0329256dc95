"""Sharding by longest-processing-time scheduling; the law is `bytes`: the shards' sizes come out near equal.

Rows of equal text form a group that stays together. All groups, largest first and those of equal size in the order of
their text's hash, go each to the least-loaded shard through a heap. Groups of one size are interchangeable to the
schedule, so the driver sees one row a distinct size, (size, number of groups): with B bytes in all there are fewer
than sqrt(2 B) distinct sizes, as their sum is at most B. A run of equal groups is placed at once: the heap's picks are
the smallest members of the shards' arithmetic progressions of loads, which a search for the last pick's load counts.
Which group of a size goes where follows from its rank in that size; ranks and slots are two-level sums over parts of
about PART rows, so that no task holds a popular size or a whole shard.

A shard's size differs from another's by one group at most. Equal texts of a third of all rows are one group.

Shuffles: rows without their texts by text hash (hot texts are joined by broadcast) and by part. Texts are read once
and never shuffled.

Edge cases: null counts as an empty text (size 1, crc32 0); equal texts are one group whatever their doc_id (two texts
are equal if their length and two 64-bit hashes are); ties in load go to the shard of smaller number; rows keep no order within a
shard; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import delete, join_unique, materialise, table

SHARDS = 16
#: Rows of a part, on average.
PART = 1 << 13


def fill(load: list[int], size: int, count: int) -> list[int]:
    """How many of count items of one size each shard gets, if each goes to the least-loaded shard, of equal ones to the
    first: the count smallest of the pairs (load + j * size, shard), j = 0, 1, ..."""
    lo, hi = min(load), min(load) + size * count  # one shard alone has count picks below hi
    while lo < hi:  # the least load limit with count picks at or below it
        mid = (lo + hi) // 2
        if sum((mid - x) // size + 1 for x in load if x <= mid) >= count:
            hi = mid
        else:
            lo = mid + 1
    took = [(lo - 1 - x) // size + 1 if x < lo else 0 for x in load]
    left = count - sum(took)
    for s, x in enumerate(load):
        if left and x <= lo and (lo - x) % size == 0:
            took[s] += 1
            left -= 1
    return took


def schedule(classes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """For classes (size, number of groups) in descending order of size: the size, and (end, shard) ranges of ranks."""
    heap = [(0, s) for s in range(shards)]
    for size, count in classes:
        ranges, end = [], 0
        if count <= shards:
            for _ in range(count):
                load, shard = heap[0]
                heapq.heapreplace(heap, (load + size, shard))
                end += 1
                ranges.append((end, shard))
        else:
            load = [x for x, _ in sorted(heap, key=lambda h: h[1])]
            for shard, n in enumerate(fill(load, size, count)):
                if n:
                    load[shard] += n * size
                    end += n
                    ranges.append((end, shard))
            heap = [(x, s) for s, x in enumerate(load)]
            heapq.heapify(heap)
        yield size, ranges


def ranked(rows: DataFrame, by: str, hashed: Column, order: list[str], parts: int, out: str) -> DataFrame:
    """Adds out: the rank from 0 of each row among those of equal `by`, ordered by part and within a part by `order`. The
    column hashed deals rows to the parts evenly."""
    keyed = rows.withColumn("part", F.pmod(hashed, F.lit(parts)))
    sums = keyed.groupBy(by, "part").agg(F.count("*").alias("n_part"))
    before = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    bases = sums.select(by, "part", F.coalesce(F.sum("n_part").over(before), F.lit(0)).alias("base"))
    within = keyed.withColumn("within", F.row_number().over(Window.partitionBy(by, "part").orderBy(*order)))
    return within.join(bases, [by, "part"]).withColumn(out, F.col("base") + F.col("within") - 1).drop("base", "within", "part")


def sharded(docs: DataFrame, shards: int = SHARDS, part: int = PART) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    if min(shards, part) < 1:
        raise ValueError("shards and part must be positive")
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
    # written once, so that the row numbers stay as they are
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    groups = materialise(rows.groupBy("h1", "h2", "size").agg((F.col("size") * F.count("*")).alias("bytes")), "groups")
    classes = groups.groupBy("bytes").agg(F.count("*").alias("n")).orderBy(F.col("bytes").desc())
    placed = list(schedule(((r.bytes, r.n) for r in classes.toLocalIterator()), shards))
    plan = pa.table({"bytes": pa.array([b for b, _ in placed], pa.int64()), "ranges": pa.array([[{"end": e, "s": s} for e, s in r] for _, r in placed], pa.list_(pa.struct([("end", pa.int64()), ("s", pa.int32())])))})
    plan = spark.createDataFrame(plan)
    parts = math.ceil(max(1, groups.count()) / part)
    numbered = ranked(join_unique(groups, plan, ["bytes"]), "bytes", F.col("h2"), ["h1", "h2", "size"], parts, "rank")
    shard = F.element_at(F.filter("ranges", lambda r: F.col("rank") < r["end"]), 1)["s"]
    homes = materialise(numbered.select("h1", "h2", "size", shard.alias("shard")), "homes")
    delete(groups)
    settled = materialise(join_unique(rows, homes, ["h1", "h2", "size"]).select("doc_id", "size", "text_crc32", "shard", "row"), "settled")
    delete(homes)
    delete(rows)
    parts = math.ceil(max(1, settled.count()) / part)
    return ranked(settled, "shard", F.xxhash64("row"), ["row"], parts, "slot").select("doc_id", "size", "text_crc32", "shard", "slot")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharded(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
