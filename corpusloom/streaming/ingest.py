"""Incremental ingest with Structured Streaming: new shards are parsed and laddered as they arrive, and each subset's token
budget goes on from trigger to trigger, so that a line is accepted while what its subset accepted before stays below the
target.

Within a trigger the budget is a prefix sum over narrow rows, as in the batch build: no task holds a subset. Between
triggers only one number a subset is kept, beside the stream's checkpoint. A trigger's output is a folder of its own that
a repeated trigger overwrites, and its numbers are kept with those before it, so that lines count exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators import ladder
from corpusloom.operators.prefix import prefix_sum
from corpusloom.sources import manifest
from corpusloom.sources.jsonl import SCHEMA, _numbered

COLUMNS = ["subset", "shard", "line_idx", "status", "n_framed", "prior"]


def lines(spark: SparkSession, glob: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of the parsed lines of new shards under <glob>/<subset>/."""
    raw = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_trigger).text(glob)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.expr("make_valid_utf8(value)").alias("raw")).mapInArrow(_numbered, SCHEMA)


def accepted(rows: DataFrame, used: dict[str, int], targets: dict[str, int]) -> DataFrame:
    """The lines of one trigger (subset, shard, line_idx, status, n_framed) that are seen under the budget, with prior: what
    their subset accepted before, in the order of shard and line. Subsets without a target are left out."""
    limits = rows.sparkSession.createDataFrame([(s, t, used.get(s, 0)) for s, t in targets.items()], "subset string, target long, base long")
    summed = prefix_sum(rows.join(F.broadcast(limits), "subset"), "n_framed", "line_idx", ["subset"], ["shard"])  # a row a subset
    return summed.withColumn("prior", F.col("base") + F.col("prior")).where("prior < target").select(*COLUMNS)


def start(docs: DataFrame, targets: dict[str, int], out: str, checkpoint: str, tokenizer: str = "utf8_bytes", min_tokens: int = ladder.MIN_TOKENS) -> StreamingQuery:
    """Write accepted lines as Parquet under out/batch=<number> until all that is there is read. docs: lines()."""
    rows = ladder.ladder(docs, tokenizer, min_tokens).select("subset", "shard", "line_idx", "status", "n_framed")
    state = f"{manifest.qualify(docs.sparkSession, checkpoint)}/budget.json"

    def trigger(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kept = manifest.read_json(state) if manifest.exists(state) else {"batch": -1, "before": {}, "used": {}}
        before = kept["before"] if kept["batch"] == number else kept["used"]
        batch.write.mode("overwrite").parquet(f"{checkpoint}/lines")  # tokenised once; read again for the sums
        place = f"{out}/batch={number}"
        accepted(spark.read.schema(batch.schema).parquet(f"{checkpoint}/lines"), before, targets).write.mode("overwrite").parquet(place)
        sums = spark.read.schema("subset string, n_framed long").parquet(place).groupBy("subset").agg(F.sum("n_framed").alias("n")).collect()  # a row a subset
        manifest.write_json(state, {"batch": number, "before": before, "used": before | {r.subset: before.get(r.subset, 0) + r.n for r in sums}})

    return rows.writeStream.foreachBatch(trigger).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()


def read(spark: SparkSession, out: str) -> DataFrame:
    """What was accepted so far."""
    return spark.read.schema("subset string, shard string, line_idx long, status string, n_framed long, prior long, batch long").parquet(out).select(*COLUMNS)
