"""Distributed samplers as queries: which row each of several ranks reads, and in what order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.prefix import prefix_sum

#: Hexadecimal digits of the hash that number a bucket of the shuffled order (65,536); each is sorted by one task.
DIGITS = 4


def shuffle_key(seed: int, epoch: int, key: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(epoch)), F.col(key).cast("string")))


def rank_sampler(rows: DataFrame, key: str, world: int, seed: int = 0, epoch: int = 0, shuffle: bool = True, drop_last: bool = True) -> DataFrame:
    """(key, position, rank): rows in a seeded order (or that of the key), dealt out one after the other to `world` ranks.
    drop_last leaves out the rows that don't fill a round; otherwise the first rows fill it up again.

    The order of hashes is two-level: rows fall into buckets by the leading digits of their hash, so that positions come
    from bucket totals and a sort within each bucket. Without a shuffle positions are prefix sums over the key."""
    total = rows.agg(F.count("*").alias("n"))
    if shuffle:
        h = shuffle_key(seed, epoch, key)
        rows = rows.select(key, h.alias("_h"), F.conv(F.substring(h, 1, DIGITS), 16, 10).cast("long").alias("_b"))
        before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
        bases = rows.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
        within = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)) - 1
        placed = rows.withColumn("_i", within).join(bases, "_b").select(key, (F.col("_base") + F.col("_i")).alias("position"))
    else:
        placed = prefix_sum(rows.select(key, F.lit(1).alias("_one")), "_one", key, out="position").drop("_one")
    placed = placed.join(F.broadcast(total))  # one row
    if drop_last:
        out = placed.where(F.col("position") < F.col("n") - F.col("n") % world)
    else:
        short = F.pmod(-F.col("n"), F.lit(world))
        # a table of fewer rows than ranks is repeated more than once
        again = F.expr(f"filter(transform(sequence(0, {world}), k -> position + k * n), p -> p < n + pmod(-n, {world}))")
        out = placed.withColumn("position", F.explode(again)).where(F.col("position") < F.col("n") + short)
    return out.select(key, "position", F.pmod("position", F.lit(world)).cast("int").alias("rank"))


def first_per_group(rows: DataFrame, group: str, order: str, quota: int) -> DataFrame:
    """The first quota rows of each group."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("_n", n).where(F.col("_n") <= quota).drop("_n")
