"""Compressed JSON-lines shards: listing and a numbered, strictly parsed scan.

A compressed file is never split, so a task reads each of its files from the first line on and lines can be numbered as
they pass, without a shuffle. Invalid UTF-8 is replaced before parsing."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.pieces import pieces
from corpusloom.sources.manifest import filesystem, qualify

SUFFIXES = (".jsonl.zst", ".jsonl.gz")
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
#: Files up to which their places are broadcast.
MAX_BROADCAST_SHARDS = 1_000_000
SCHEMA = "subset string, shard string, line_idx long, parse_status string, text string"


def list_shards(spark: SparkSession, root: str, subset: str, suffix: str = SUFFIXES[0]) -> DataFrame:
    """(subset, shard, path, bytes) of a subset's files, in the order of their names. Contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(f"{root}/{subset}")
    return files.select(F.lit(subset).alias("subset"), F.element_at(F.split("path", "/"), -1).alias("shard"), "path", F.col("length").alias("bytes")).orderBy("path")


def parse_line(raw: str) -> tuple[str, str | None]:
    """(malformed or parsed, stripped text) of one line."""
    try:
        row = json.loads(raw)
    except (ValueError, RecursionError):
        return "malformed", None
    if not isinstance(row, dict):
        return "malformed", None
    text = row.get("text", "")
    return "parsed", text.encode("utf-8", "replace").decode().strip() if isinstance(text, str) else ""


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path, line = None, 0
    for batch in batches:
        for start, rows in pieces(batch.column(1)):
            out: list[list] = [[], [], [], [], []]
            for at, raw in zip(*(c.slice(start, rows).to_pylist() for c in batch.columns[:2])):
                if at != path:
                    path, line = at, 0
                status, text = parse_line(raw)
                for column, value in zip(out, (posixpath.basename(posixpath.dirname(at)), posixpath.basename(at), line, status, text)):
                    column.append(value)
                line += 1
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string()), pa.array(out[4], pa.string())], names=["subset", "shard", "line_idx", "parse_status", "text"])


def scan(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Every line of compressed shards named <subset>/<shard>: its address, status and text. Blank lines are malformed and
    numbered like any other."""
    odd = [p for p in paths if not p.rstrip("*").endswith(SUFFIXES)]
    if odd:
        raise ValueError(f"only unsplittable shards ({', '.join(SUFFIXES)}) can be numbered as they are read: {odd[0]}")
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.expr("make_valid_utf8(value)").alias("raw"))
    return lines.mapInArrow(_numbered, SCHEMA)


def reader(spark: SparkSession, root: str, suffix: str = SUFFIXES[0]) -> Callable[[list[str]], DataFrame]:
    """A function that scans all shards of some subsets under root, each with its place in the order of names (shard_ord):
    the documents of dataset.build. Folders are only listed."""

    def read(subsets: list[str]) -> DataFrame:
        rows = scan(spark, [f"{root}/{s}/*{suffix}" for s in subsets])
        listed = reduce(DataFrame.unionByName, [list_shards(spark, root, s, suffix) for s in subsets])
        places = listed.select("subset", "shard", (F.row_number().over(Window.partitionBy("subset").orderBy("shard")) - 1).alias("shard_ord"))  # a row a file
        return rows.join(F.broadcast(places) if places.count() <= MAX_BROADCAST_SHARDS else places, ["subset", "shard"])

    return read


def write(lines: DataFrame, root: str) -> None:
    """Write rows (subset, shard, line_idx, raw) as <root>/<subset>/<shard>.jsonl.zst, the lines of a shard in the order of
    line_idx. One task writes a shard, aside, and renames it when it is whole, so that a retry writes it again."""
    columns = ["subset", "shard", "raw"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, out, files = None, None, []

        def close():
            if out is not None:
                out.close()
                store, aside = filesystem(files[-1] + aside_end)
                store.move(aside, filesystem(files[-1])[1])

        aside_end = f".{uuid.uuid4().hex}.tmp"
        for batch in batches:
            for start, rows in pieces(batch.column(2)):
                for subset, shard, raw in zip(*(c.slice(start, rows).to_pylist() for c in batch.columns)):
                    if (subset, shard) != key:
                        close()
                        key = (subset, shard)
                        files.append(f"{root}/{subset}/{shard}{SUFFIXES[0]}")
                        store, place = filesystem(files[-1] + aside_end)
                        store.create_dir(place.rpartition("/")[0], recursive=True)
                        out = pa.CompressedOutputStream(store.open_output_stream(place, compression=None), "zstd")
                    out.write(raw.encode() + b"\n")
        close()
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string())], names=["file"])

    root = qualify(lines.sparkSession, root)
    rows = lines.select(*columns, "line_idx").repartition("subset", "shard").sortWithinPartitions("subset", "shard", "line_idx")
    rows.select(*columns).mapInArrow(run, "file string").write.format("noop").mode("overwrite").save()
