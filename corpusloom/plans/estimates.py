"""Corpus sizes from samples: choose shards, read some texts of each, scale tokens by compressed bytes.

Shards are listed on the driver (metadata); a task reads one sampled shard, and stops when it has its share."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import tokenizers
from corpusloom.operators import estimate
from corpusloom.sources import jsonl
from corpusloom.sources.manifest import filesystem

READ = 1 << 16
SCHEMA = "subset string, shard_ord int, doc_ord long, n_tokens long, bytes_after long"


def _reader(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encode = tokenizers.load(tokenizer).encode
        for batch in batches:
            for row in batch.to_pylist():
                store, place = filesystem(row["path"].removeprefix("file:") if row["path"].startswith("file:/") else row["path"])
                found = []
                with store.open_input_file(place) as raw:
                    stream = zstandard.ZstdDecompressor().stream_reader(raw, read_size=READ, read_across_frames=True)
                    for line in io.TextIOWrapper(io.BufferedReader(stream), encoding="utf-8", errors="replace"):
                        try:
                            value = json.loads(line)
                        except ValueError:
                            continue
                        text = value.get("text", "") if isinstance(value, dict) else None
                        if not isinstance(text, str) or not text.strip():
                            continue
                        found.append((len(encode(text)), raw.tell()))
                        if len(found) >= row["quota"]:
                            break
                    else:
                        if found:  # read to its end
                            found[-1] = (found[-1][0], row["bytes"])
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([row["subset"]] * n, pa.string()), pa.array([row["shard_ord"]] * n, pa.int32()), pa.array(range(n), pa.int64()), pa.array([t for t, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["subset", "shard_ord", "doc_ord", "n_tokens", "bytes_after"])

    return run


def sample(spark: SparkSession, root: str, subsets: list[str], tokenizer: str = "utf8_bytes", sample_docs: int = 12_000, max_shards: int = 64, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Sampled documents, and one row a subset: total_bytes, n_shards and the names of the sampled shards."""
    chosen, totals = [], []
    for subset in subsets:
        files = {r.shard: r for r in jsonl.list_shards(spark, root, subset).collect()}
        names = estimate.sampled_shards(list(files), max_shards, seed, subset)
        quota = estimate.shard_quota(sample_docs, len(names))
        chosen += [(subset, i, files[n].path, files[n].bytes, quota) for i, n in enumerate(names)]
        totals.append((subset, sum(f.bytes for f in files.values()), len(files), names))
    listing = spark.createDataFrame(chosen, "subset string, shard_ord int, path string, bytes long, quota int").repartition(max(1, len(chosen)), "path")
    docs = listing.mapInArrow(_reader(tokenizer), SCHEMA)
    order = F.row_number().over(Window.partitionBy("subset").orderBy("shard_ord", "doc_ord"))
    docs = docs.withColumn("_n", order).where(F.col("_n") <= sample_docs).drop("_n")  # sample_docs rows a subset at most
    return docs, spark.createDataFrame(totals, "subset string, total_bytes long, n_shards int, sampled_shard_names array<string>")


def estimates(spark: SparkSession, root: str, subsets: list[str], tokenizer: str = "utf8_bytes", sample_docs: int = 12_000, max_shards: int = 64, seed: int = 42, specials_per_doc: int = 0) -> DataFrame:
    """One row a subset: the sample, the ratio and the estimated tokens."""
    docs, totals = sample(spark, root, subsets, tokenizer, sample_docs, max_shards, seed)
    shards = docs.groupBy("subset", "shard_ord").agg(F.count("*").alias("n"), F.sum(F.col("n_tokens") + specials_per_doc).alias("t"), F.max("bytes_after").alias("b"))
    sums = shards.groupBy("subset").agg(F.sum("n").alias("sample_docs"), F.sum("t").alias("sample_tokens"), F.sum("b").alias("sample_bytes"))
    out = estimate.ratio_estimate(sums, totals)
    return out.withColumn("n_sampled_shards", F.size("sampled_shard_names")).withColumn("mode", F.lit("sample"))
