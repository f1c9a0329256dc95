"""Shared helpers of the llm operators: table access, shared-folder materialisation, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import shared_dir

#: Most bytes of one Arrow batch handed to a Python worker, so that very long texts keep its memory bounded.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes; the row bound alone does not hold very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends, columns stay prunable."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(df: DataFrame) -> None:
    """Delete the files behind a DataFrame made by materialise()."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def trim(spark: SparkSession) -> None:
    """Let go of what earlier jobs left with the driver: plans, and by them the cluster's shuffle files and broadcast blocks,
    which Spark removes when the driver's heap is collected; and give freed memory back, where the C library can."""
    gc.collect()
    spark._jvm.System.gc()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


#: A key is hot if more than HOT rows have it and it is among the HOT most frequent ones.
HOT = 1024


def hot_keys(rows: DataFrame, keys: list[str]) -> list:
    """The hot keys of rows, HOT at most. Of n rows, a key that is not hot has n / HOT rows at most, or HOT."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > HOT)
    return counts.orderBy(F.col("n_rows").desc()).limit(HOT).select(*keys).collect()


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined (inner or left) with right, which has one narrow row a key. Hot keys of left are joined by broadcast,
    HOT rows at most, so that no task reads a large share of left; all others by a shuffle. Null keys match nothing. left
    and right are read twice: written tables or cheap plans."""
    hot = hot_keys(left, keys)
    if not hot:
        return left.join(right, keys, how)
    spark = left.sparkSession
    marks = F.broadcast(spark.createDataFrame(hot, left.select(*keys).schema).select(*(F.col(k).alias(f"hot_{k}") for k in keys)))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"hot_{k}")) for k in keys))
    few = right.join(marks, same, "left_semi")
    out = left.join(marks, same, "left_semi").join(F.broadcast(few), keys, how)
    return out.unionByName(left.join(marks, same, "left_anti").join(right, keys, how))


def smallest_hashes(rows: DataFrame, key: Column, limit: int) -> DataFrame:
    """About the limit rows of smallest hash of key, and never fewer unless rows are: a filter by a threshold that the
    number of distinct keys gives, so that no task sends more than its share to the driver. Sort and limit afterwards."""
    h = F.xxhash64(key)
    n = rows.agg(F.approx_count_distinct(key, 0.02)).first()[0]
    share = min(1.0, (1.25 * limit + 200) / max(1, n))
    return rows if share >= 1 else rows.where(h < int(-(2**63) + share * 2**64))


def map_rows(columns: list[str], schema: pa.Schema, make: Callable[[], Callable[..., dict]]) -> Callable:
    """A mapInArrow function: make() runs once a task and returns a function from column lists to output lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                out = work(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns))
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return run
