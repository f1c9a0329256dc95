"""Queries over training metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.prefix import prefix_fold


def weighted_mean(loss: str, weight: str) -> Column:
    """Sum of loss times weight over the sum of weights, which counts as one at least."""
    return F.coalesce(F.sum(F.col(loss) * F.col(weight)), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(weight), F.lit(0)), F.lit(1))


def throughput(rows: DataFrame, step: str, tokens: str, seconds: str, by: list[str] | None = None, span: int | None = None) -> DataFrame:
    """Adds tokens_per_second between a log point and the one before it, by an integer step; a time step counts as 1e-9 s at least."""
    point = F.struct(F.col(step).alias("step"), F.col(tokens).alias("tokens"), F.col(seconds).alias("seconds"))
    out = prefix_fold(rows, point, "max", step, by, out="_last", span=span)  # the last point before, as steps rise
    dt = F.greatest(F.col(seconds) - F.col("_last.seconds"), F.lit(1e-9))
    return out.withColumn("tokens_per_second", (F.col(tokens) - F.col("_last.tokens")) / dt).drop("_last")
