"""Corpus size from samples, length statistics, and reports."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.hashing import sample_seed, shuffle_seed
from corpusloom.functions.text import grouped, human

PERCENTILES = (50, 75, 90, 95, 99, 99.9)


def shuffled_shards(shards: list[str], seed: int, subset: str) -> list[str]:
    """The reading order of a subset's shards: a seeded permutation of the sorted list. Metadata, so on the driver."""
    out = sorted(shards)
    random.Random(shuffle_seed(seed, subset)).shuffle(out)
    return out


def sampled_shards(shards: list[str], most: int, seed: int, subset: str) -> list[str]:
    """At most `most` shards, sorted: all of them, or a seeded sample."""
    shards = sorted(shards)
    return shards if len(shards) <= most else sorted(random.Random(sample_seed(seed, subset)).sample(shards, most))


def shard_quota(sample_docs: int, n_sampled: int) -> int:
    """Documents to read of each sampled shard; without shards there is nothing to read."""
    return max(1, math.ceil(sample_docs / n_sampled)) if n_sampled else 0


def hash_order(subset: Column, shard: Column, seed: int) -> Column:
    """A native shard order for sets of shards that are too many for the driver; another permutation than above."""
    return F.xxhash64(F.lit(seed), subset, shard)


def ratio_estimate(samples: DataFrame, totals: DataFrame) -> DataFrame:
    """samples: subset, sample_docs, sample_tokens, sample_bytes; totals: subset, total_bytes. Tokens are the sampled
    ratio times all bytes, rounded half to even; 0 without sampled bytes."""
    ratio = F.when(F.col("sample_bytes") > 0, F.col("sample_tokens") / F.col("sample_bytes")).otherwise(F.lit(0.0))
    rows = totals.join(samples, "subset", "left").na.fill(0, ["sample_docs", "sample_tokens", "sample_bytes"])
    return rows.withColumn("tokens_per_byte", ratio).withColumn("tokens", F.bround(F.col("tokens_per_byte") * F.col("total_bytes")).cast("long"))


def length_summary(lengths: DataFrame, n: str, context: int) -> DataFrame:
    """One row: count, extremes, mean, median, population deviation, percentiles by linear interpolation, and how many
    lengths are above the context. An empty table gives count 0 and nulls."""
    points = F.percentile(n, F.array(*(F.lit(p / 100) for p in PERCENTILES)))
    row = lengths.agg(
        F.count(n).alias("count"), F.min(n).alias("min"), F.max(n).alias("max"), F.avg(n).alias("mean"), F.median(n).alias("median"), F.stddev_pop(n).alias("std"),
        points.alias("_p"), F.count_if(F.col(n) > context).alias("n_over_context"), F.coalesce(F.sum(n), F.lit(0)).alias("tokens_total"),
    )
    named = [F.get("_p", F.lit(i)).alias(f"p{str(p).replace('.', '_')}") for i, p in enumerate(PERCENTILES)]
    return row.select("*", *named, (F.col("n_over_context") / F.when(F.col("count") > 0, F.col("count"))).alias("frac_over_context")).drop("_p")


def category_rollup(taxonomy: DataFrame, estimates: DataFrame) -> DataFrame:
    """Tokens by subset, by category (subset null) and in all (both null); level is 0, 1 or 2. Missing subsets count 0."""
    rows = taxonomy.join(estimates, "subset", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    return rows.rollup("category", "subset").agg(F.sum("tokens").cast("long").alias("tokens"), F.grouping_id().alias("_g")).withColumn("level", F.when(F.col("_g") == 0, 0).when(F.col("_g") == 1, 1).otherwise(2)).drop("_g")


def report(taxonomy: DataFrame, estimates: DataFrame) -> DataFrame:
    """Lines of the text report in their order: ord and line. taxonomy: category_ord, category, subset_ord, subset."""
    rows = taxonomy.join(estimates, "subset", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    sub = rows.select("category_ord", F.lit(1).alias("k"), "subset_ord", F.concat(F.lit("  data/"), "subset", F.lit(": "), grouped(F.col("tokens")), F.lit(" tokens")).alias("line"))
    by = rows.groupBy("category_ord", "category").agg(F.sum("tokens").alias("tokens"))
    head = by.select("category_ord", F.lit(0).alias("k"), F.lit(0).alias("subset_ord"), F.concat("category", F.lit(":")).alias("line"))
    amount = F.concat(grouped(F.col("tokens")), F.lit(" tokens ("), human(F.col("tokens")), F.lit(")"))
    foot = by.select("category_ord", F.lit(2).alias("k"), F.lit(0).alias("subset_ord"), F.concat(F.lit("  -> subtotal: "), amount).alias("line"))
    gap = by.select("category_ord", F.lit(3).alias("k"), F.lit(0).alias("subset_ord"), F.lit("").alias("line"))
    total = rows.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).select(F.lit(2**31 - 1).alias("category_ord"), F.lit(0).alias("k"), F.lit(0).alias("subset_ord"), F.concat(F.lit("TOTAL: "), amount).alias("line"))
    return head.unionByName(sub).unionByName(foot).unionByName(gap).unionByName(total).orderBy("category_ord", "k", "subset_ord").select("line")


def write_report(lines: DataFrame, path: str) -> None:
    lines.coalesce(1).write.mode("overwrite").text(path)
