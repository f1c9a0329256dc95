"""Binary token shards as a data source: headerless files of little-endian unsigned integers.

Reading makes one partition for each range of tokens of a file, so that a large shard is read by many tasks. Writing
takes Arrow batches of (split, shard, shard_off, tokens) that are grouped and ordered by shard; each file is written
aside, its size is checked, and the driver renames all of them when every task has ended."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from corpusloom.operators.estimate import shuffled_shards
from corpusloom.sources.manifest import filesystem, qualify, read_manifest

SCHEMA = "split string, shard int, start long, tokens array<long>"
RANGE = 1 << 20
WIDTH = {"uint16": 2, "uint32": 4}


@dataclass
class Range(InputPartition):
    file: str
    split: str
    shard: int
    start: int
    count: int
    dtype: str


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str, str, int, int]]  # aside, target, split, shard, tokens


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root, self.split, self.range = options["path"], options.get("split"), int(options.get("range", RANGE))

    def partitions(self):
        out = []
        for split, found in read_manifest(self.root)["splits"].items():
            for i, s in enumerate(found["shards"] if self.split in (None, split) else []):
                store, place = filesystem(f"{self.root}/{s['filename']}")
                size = store.get_file_info(place).size
                if size != s["tokens"] * WIDTH[s["dtype"]]:
                    raise ValueError(f"{s['filename']} has {size} bytes, not {s['tokens']} tokens")
                out += [Range(f"{self.root}/{s['filename']}", split, i, a, min(self.range, s["tokens"] - a), s["dtype"]) for a in range(0, s["tokens"], self.range)]
        return out

    def read(self, part):
        store, place = filesystem(part.file)
        width = WIDTH[part.dtype]
        with store.open_input_file(place) as f:
            data = f.read_at(part.count * width, part.start * width)
        tokens = np.frombuffer(data, np.dtype(part.dtype).newbyteorder("<")).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([part.split]), pa.array([part.shard], pa.int32()), pa.array([part.start], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(tokens)], pa.int32()), pa.array(tokens))], names=["split", "shard", "start", "tokens"])


class _Writer(DataSourceArrowWriter):
    def __init__(self, options):
        self.root, self.dtype = options["path"], options.get("dtype", "uint16")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, out, key, used = [], None, None, 0
        width = np.dtype(self.dtype).newbyteorder("<")

        def close():
            if out is not None:
                out.close()
                store, place = filesystem(files[-1][0])
                if store.get_file_info(place).size != used * WIDTH[self.dtype]:
                    raise OSError(f"{files[-1][0]} is not complete")
                files[-1] = (*files[-1][:4], used)

        def pieces(batch):
            tokens = batch.column(3)
            flat, ends = tokens.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *tokens.value_lengths().to_pylist()])
            keys = (batch.column(i).to_pylist() for i in range(3))
            return ((split, shard, at, flat[a:b]) for split, shard, at, a, b in zip(*keys, ends, ends[1:]))

        for split, shard, at, tokens in (p for batch in iterator for p in pieces(batch)):
            if (split, shard) != key:
                close()
                key, used = (split, shard), 0
                target = f"{self.root}/{split}/tokens_{shard:06d}.bin"
                aside = f"{target}.{uuid.uuid4().hex}.tmp"
                store, place = filesystem(aside)
                store.create_dir(place.rpartition("/")[0], recursive=True)
                out = store.open_output_stream(place)
                files.append((aside, target, split, shard, 0))
            if at != used:
                raise ValueError(f"tokens of shard {key} are not in order: {at} after {used}")
            out.write(tokens.astype(width).tobytes())
            used += len(tokens)
        close()
        return Written(files)

    def commit(self, messages):
        for m in messages:
            for aside, target, *_ in m.files if m else ():
                store, a = filesystem(aside)
                store.move(a, filesystem(target)[1])

    def abort(self, messages):
        for m in messages:
            for aside, *_ in m.files if m else ():
                store, a = filesystem(aside)
                store.delete_file(a)


class TokenShards(DataSource):
    @classmethod
    def name(cls):
        return "token_shards"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TokenShards)


def read(spark: SparkSession, root: str, split: str | None = None, tokens_per_row: int = RANGE) -> DataFrame:
    register(spark)
    root = qualify(spark, root)
    reader = spark.read.format("token_shards").option("range", tokens_per_row)
    return (reader.option("split", split) if split else reader).load(root)


def read_blocks(spark: SparkSession, root: str, split: str, context: int, seed: int | None = None) -> DataFrame:
    """Training blocks of a split: shard, block, input_ids and labels; with a seed also turn, the shard's place in the
    seeded order in which shards are read. Rows of the scan hold whole blocks and are joined with
    the one token after them, so a shard is never held whole."""
    from pyspark.sql import functions as F

    rows = read(spark, root, split, context * max(1, RANGE // context))
    n = F.size("tokens")
    heads = rows.select("split", "shard", F.col("start").alias("end"), F.slice("tokens", 1, 1).alias("after")).where("end > 0")
    whole = rows.withColumn("end", F.col("start") + n).join(heads, ["split", "shard", "end"], "left")
    t = F.concat("tokens", F.coalesce("after", F.array().cast("array<long>")))
    whole = whole.select("split", "shard", "start", t.alias("t")).where(F.size("t") > context)
    blocks = whole.withColumn("i", F.explode(F.sequence(F.lit(0), F.floor((F.size("t") - 1) / context).cast("int") - 1)))
    out = blocks.select("split", "shard", (F.col("start") / context + F.col("i")).cast("long").alias("block"), F.slice("t", F.col("i") * context + 1, F.lit(context)).alias("input_ids"), F.slice("t", F.col("i") * context + 2, F.lit(context)).alias("labels"))
    if seed is None:
        return out
    names = [s["filename"] for s in read_manifest(root)["splits"][split]["shards"]]
    turns = {name: i for i, name in enumerate(shuffled_shards(names, seed, split))}
    order = spark.createDataFrame([(i, turns[name]) for i, name in enumerate(names)], "shard int, turn int")
    return out.join(F.broadcast(order), "shard")  # the manifest's rows, one a shard


def complete(root: str, shards: list[dict]) -> set[tuple[str, int]]:
    """Of the shards (split, shard, tokens, dtype) those whose files are there and whole; all other files of the splits'
    folders are deleted: left-overs of a run that was cut off. One listing a split."""
    want = {f"{s['split']}/tokens_{s['shard']:06d}.bin": s for s in shards}
    found = set()
    for split in ("train", "val"):
        store, place = filesystem(f"{root}/{split}")
        for f in store.get_file_info(fs.FileSelector(place, allow_not_found=True)):
            s = want.get(f"{split}/{f.base_name}")
            if s and f.size == s["tokens"] * WIDTH[s["dtype"]]:
                found.add((split, s["shard"]))
            elif f.type == fs.FileType.File:
                store.delete_file(f.path)
    return found


def write(pieces: DataFrame, root: str, dtype: str) -> None:
    """Write rows (split, shard, shard_off, tokens); one task writes a shard, a shard is one file."""
    register(pieces.sparkSession)
    rows = pieces.select("split", "shard", "shard_off", "tokens").repartition("split", "shard").sortWithinPartitions("split", "shard", "shard_off")
    rows.write.format("token_shards").option("dtype", dtype).mode("append").save(root)
