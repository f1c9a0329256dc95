"""The manifest of a packed dataset, and mixture files. Driver-side metadata."""

from __future__ import annotations

import json
import uuid
from typing import Any

import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the on-disk format.
FORMAT = "raw_token_binary_v1"
MANIFEST, SETTINGS, DRY_SETTINGS = "manifest.json", "config_used.json", "dry_run_config_used.json"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path in it. A path without a scheme is one of a disk that driver and executors share;
    qualify() gives it the scheme that Spark would read it by."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def qualify(spark: SparkSession, path: str) -> str:
    """A path with the scheme of Spark's default store where it has none; local paths stay as they are."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return path if full.startswith("file:") else full


def write_json(path: str, payload: Any) -> None:
    """Sorted keys, two spaces, a newline at the end; written beside the target and renamed."""
    store, place = filesystem(path)
    store.create_dir(place.rpartition("/")[0], recursive=True)
    aside = f"{place}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(aside) as f:
        f.write((json.dumps(payload, sort_keys=True, indent=2, ensure_ascii=False) + "\n").encode())
    store.move(aside, place)


def read_json(path: str) -> Any:
    store, place = filesystem(path)
    with store.open_input_stream(place) as f:
        return json.loads(f.read().decode())


def exists(path: str) -> bool:
    store, place = filesystem(path)
    return store.get_file_info(place).type != fs.FileType.NotFound


def read_manifest(root: str) -> dict:
    found = read_json(f"{root}/{MANIFEST}")
    if found.get("format") != FORMAT:
        raise ValueError(f"format is {found.get('format')!r}, not {FORMAT!r}")
    return found


def build_manifest(settings: dict, shards: list[dict], subsets: dict[str, dict], dry_run: bool = False) -> dict:
    """shards: split, shard, tokens, dtype. subsets: counters by name. Totals must agree."""
    splits: dict[str, dict] = {s: {"tokens": 0, "shards": []} for s in ("train", "val")}
    for s in sorted(shards, key=lambda s: (s["split"], s["shard"])):
        if s["shard"] != len(splits[s["split"]]["shards"]):
            raise ValueError(f"shard {s['shard']} of {s['split']} is not the next one")
        splits[s["split"]]["tokens"] += s["tokens"]
        splits[s["split"]]["shards"].append({"filename": f"{s['split']}/tokens_{s['shard']:06d}.bin", "tokens": s["tokens"], "dtype": s["dtype"], "split": s["split"]})
    total = sum(v["tokens"] for v in splits.values())
    if total != sum(v["actual_tokens"] for v in subsets.values()):
        raise ValueError("the shards' tokens are not those of the subsets")
    return {**settings, "format": FORMAT, "created_by": "corpusloom", "dry_run": dry_run, "actual_total_tokens": total, "splits": splits, "subsets": subsets}


def load_mixture(path: str) -> tuple[list[tuple[str, int]], int]:
    """(subset, target tokens) in the file's order, and the total: given, or the sum."""
    data = read_json(path)
    subsets = data.get("subsets")
    if not isinstance(subsets, dict) or not subsets:
        raise ValueError("a mixture needs a non-empty object `subsets`")
    rows = [(k, int(v)) for k, v in subsets.items()]
    if any(v <= 0 for _, v in rows):
        raise ValueError("targets must be positive")
    return rows, int(data.get("total_target_tokens") or sum(v for _, v in rows))


def mixture_frame(spark: SparkSession, rows: list[tuple[str, int]]) -> DataFrame:
    return spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(rows)], "subset_ord int, subset string, target_tokens long")
