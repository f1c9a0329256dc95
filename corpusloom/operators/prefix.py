"""Running folds over an order, in levels, so that no task sees more than about one chunk of rows.

Rows fall into chunks of consecutive order values; rows are folded within their chunk, and the chunks' totals are
folded over the chunks before. Where the order is sparse (hashes, snowflake ids) there are about as many chunks as rows:
then the totals are folded in the same way, by chunks of chunks, until the order's whole span is one chunk of chunks. A
64-bit span takes three levels, a dense one of 2**32 values one. Chunks come from the data, so the result does not depend
on how Spark deals out partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 65_536
FOLDS = {"sum": F.sum, "min": F.min, "max": F.max}


def span_of(df: DataFrame, order: str) -> int:
    """The difference of the order's extremes, by one job that reads this column alone where df is a table."""
    ends = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    return 0 if ends.lo is None else int(ends.hi) - int(ends.lo)


def prefix_fold(df: DataFrame, value: Column, fold: str, order: str, by: list[str] | None = None, major: list[str] | None = None, chunk: int = CHUNK, out: str = "prior", tie: list[Column] | None = None, span: int | None = None) -> DataFrame:
    """Adds out: the fold (sum, min or max) of value over all rows before this one within `by`, in the order of
    (major..., order); null where there is none.

    order must be an integer column, unique within (by, major) unless tie breaks it. major holds leading ordinals. span is a
    bound on the difference of the order's extremes; where it is not given, span_of(df) runs a job, so that rows which are costly
    to make should bring the span of the table that they come from."""
    by, major, join = by or [], major or [], FOLDS[fold]
    span = span_of(df, order) if span is None else span
    keyed = df.withColumn("_value", value).withColumn("_chunk", F.floor(F.col(order) / chunk).cast("long") if span < 2**52 else F.expr(f"cast(floor(cast(`{order}` as decimal(20,0)) / {chunk}) as bigint)"))
    keys = [*by, *major, "_chunk"]
    totals = keyed.groupBy(*keys).agg(join("_value").alias("_total"))
    if span // chunk > chunk:
        fine = totals.withColumnRenamed("_chunk", "_fine")
        bases = prefix_fold(fine, F.col("_total"), fold, "_fine", by, major, chunk, "_base", span=span // chunk).select(*by, *major, F.col("_fine").alias("_chunk"), "_base")
    else:
        before = Window.partitionBy(*by).orderBy(*major, "_chunk").rowsBetween(Window.unboundedPreceding, -1)
        bases = totals.select(*keys, join("_total").over(before).alias("_base"))
    within = Window.partitionBy(*keys).orderBy(order, *(tie or [])).rowsBetween(Window.unboundedPreceding, -1)
    folded = keyed.withColumn("_within", join("_value").over(within))
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    joined = folded.alias("s").join(bases.alias("b"), same, "left")
    own, base = F.col("s._within"), F.col("b._base")
    if fold == "sum":
        both = F.coalesce(base + own, base, own)
    else:
        wins = own <= base if fold == "min" else own >= base
        both = F.when(base.isNull() | wins, F.coalesce(own, base)).otherwise(base)
    return joined.select("s.*", both.alias(out)).drop("_value", "_chunk", "_within")


def prefix_sum(df: DataFrame, value: str, order: str, by: list[str] | None = None, major: list[str] | None = None, chunk: int = CHUNK, out: str = "prior", tie: list[Column] | None = None, span: int | None = None) -> DataFrame:
    """Adds out: the sum of value over all rows before this one, 0 where there is none."""
    return prefix_fold(df, F.col(value), "sum", order, by, major, chunk, out, tie, span).withColumn(out, F.coalesce(F.col(out), F.lit(0)).cast("long"))
