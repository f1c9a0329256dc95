"""Joins of settings, taxonomies, vocabularies and file lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_subsets(mixture: DataFrame, found: DataFrame, skip_missing: bool = False) -> DataFrame:
    """Every subset of the mixture with what is found of it (subset, n_shards, ...); a missing one is an error, or with
    skip_missing a row of zeros that counts as completed."""
    rows = mixture.join(found.withColumn("_there", F.lit(True)), "subset", "left")
    numbers = [c for c, t in found.dtypes if c != "subset" and t in ("bigint", "int", "double")]
    if not skip_missing:
        gone = F.raise_error(F.concat(F.lit("missing subset: "), F.col("subset"))).cast("boolean")
        return rows.withColumn("completed", F.when(F.col("_there").isNull(), gone).otherwise(F.lit(False))).drop("_there")
    return rows.withColumn("completed", F.col("_there").isNull()).na.fill(0, numbers).drop("_there")


#: Settings that may differ between a run and the one that resumes it.
FREE_KEYS = ("resume", "overwrite", "num_workers", "flush_batch_tokens", "checkpoint_interval_docs")


def differing_settings(current: DataFrame, previous: DataFrame, free: tuple[str, ...] = FREE_KEYS) -> DataFrame:
    """(key, current_value, previous_value) of current settings that are absent or different in the previous run."""
    now = current.where(~F.col("key").isin(*free)).select("key", F.col("value").alias("current_value"))
    then = previous.select("key", F.col("value").alias("previous_value"), F.lit(True).alias("_there"))
    rows = now.join(then, "key", "left")
    return rows.where(F.col("_there").isNull() | ~F.col("current_value").eqNullSafe(F.col("previous_value"))).drop("_there")


def orphans(files: DataFrame, expected: DataFrame, name: str = "name") -> DataFrame:
    return files.join(expected.select(name), name, "left_anti")


def unfinished(mixture: DataFrame, ledger: DataFrame) -> DataFrame:
    """Subsets of the mixture that the ledger does not list as committed."""
    return mixture.join(ledger.where("committed").select("subset"), "subset", "left_anti")


def plain_vocabulary(vocabulary: DataFrame, added: DataFrame) -> DataFrame:
    return vocabulary.join(added.select("token"), "token", "left_anti")
