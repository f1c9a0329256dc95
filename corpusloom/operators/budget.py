"""Token budgets: the budget cut, the document limit, the hash split and the greedy validation cap."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import hashing
from corpusloom.operators.prefix import CHUNK, prefix_fold, prefix_sum

MAX_VAL_TOKENS = 20_000_000


def budget_cut(docs: DataFrame, target: str = "target_tokens", order: str = "line_idx", major: list[str] | None = None, chunk: int = CHUNK, span: int | None = None) -> DataFrame:
    """Rows that are seen: a line is seen while what was accepted before it stays below the target; the last may overshoot.
    Rows after the cut count nowhere. docs: subset, n_framed, the target and the order."""
    summed = prefix_sum(docs, "n_framed", order, ["subset"], major, chunk, span=span)
    return summed.where(F.col("prior") < F.col(target))


def doc_limit(docs: DataFrame, limit: int, order: str = "line_idx", major: list[str] | None = None, chunk: int = CHUNK, span: int | None = None) -> DataFrame:
    """The first limit lines of each subset, whatever their status; 0 gives none."""
    counted = prefix_sum(docs.withColumn("_one", F.lit(1)), "_one", order, ["subset"], major, chunk, out="_seen", span=span)
    return counted.where(F.col("_seen") < limit).drop("_one", "_seen")


def hash_split(docs: DataFrame, fraction: float, seed: int, key: list[str], profile: str = "native") -> DataFrame:
    """Adds bucket and candidate (for validation) from the hash of the key columns; the native profile hashes the seed too."""
    text = hashing.address_key(seed if profile == "native" else None, *(F.col(k) for k in key))
    bucket = hashing.md5_bucket(text) if profile == "native" else hashing.blake2b_bucket(text)
    return docs.withColumn("bucket", bucket).withColumn("candidate", F.col("bucket") < hashing.threshold(fraction))


def greedy_cap(docs: DataFrame, cap: int = MAX_VAL_TOKENS, order: str = "line_idx", major: list[str] | None = None, weight: str = "n_framed") -> DataFrame:
    """Adds split: a candidate goes to val while its tokens still fit under the subset's cap, else to train; a later,
    smaller one may still fit. All others go to train.

    The fold is sequential within a subset by definition. It runs over the candidates' keys alone, sorted within one
    partition a subset and streamed in constant memory, and its decisions are joined back."""
    keys = ["subset", *(major or []), order]
    candidates = docs.where(F.col("candidate") & (F.col(weight) > 0)).select(*keys, F.col(weight).cast("long").alias("_w"))
    schema = candidates.schema

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subset, used, started = None, 0, False
        for batch in batches:
            keep = []
            for s, w in zip(batch.column(0).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if not started or s != subset:
                    subset, used, started = s, 0, True
                fits = used + w <= cap
                used += w * fits
                keep.append(fits)
            yield batch.filter(pa.array(keep, pa.bool_()))

    kept = candidates.repartition("subset").sortWithinPartitions(*keys).mapInArrow(fold, schema).select(*keys, F.lit(True).alias("_val"))
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"v.{k}")) for k in keys]
    out = docs.alias("d").join(kept.alias("v"), same, "left")
    return out.select("d.*", F.when(F.coalesce(F.col("v._val"), F.lit(False)), "val").otherwise("train").alias("split"))


def subset_counters(seen: DataFrame) -> DataFrame:
    """One row a subset: lines seen and what became of them, and tokens by split."""
    split = lambda s: F.coalesce(F.sum(F.when(F.col("split") == s, F.col("n_framed"))), F.lit(0))
    by = lambda s: F.count_if(F.col("status") == s)
    return seen.groupBy("subset").agg(
        F.count("*").alias("docs_seen"),
        by("written").alias("docs_written"),
        by("empty").alias("docs_skipped_empty"),
        by("short").alias("docs_skipped_short"),
        by("malformed").alias("docs_malformed_json"),
        F.count_if("is_long").alias("docs_split_long"),
        split("train").alias("train_tokens"),
        split("val").alias("val_tokens"),
        F.sum("n_framed").alias("actual_tokens"),
    )


def running(df: DataFrame, value: str, order: str, by: list[str] | None = None, span: int | None = None) -> DataFrame:
    """Adds best (running minimum), and is_best: strictly below all before it. order: an integer
    column."""
    out = prefix_fold(df, F.col(value), "min", order, by, out="_before", span=span)
    return out.withColumn("best", F.least("_before", value)).withColumn("is_best", F.col("_before").isNull() | (F.col(value) < F.col("_before"))).drop("_before")
