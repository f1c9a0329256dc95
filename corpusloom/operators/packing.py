"""From documents to segments, shards and training blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.prefix import CHUNK, prefix_sum


def frame(ids: Column, bos: int, eos: int, longest: int) -> Column:
    """Segments of a document's ids: slices of at most `longest`, BOS before the first and EOS after the last."""
    n = F.size(ids)
    parts = F.greatest(F.ceil(n / F.lit(longest)), F.lit(1)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), parts - 1),
        lambda i: F.concat(F.when(i == 0, F.array(F.lit(bos))).otherwise(F.array().cast("array<int>")), F.slice(ids, i * longest + 1, F.lit(longest)), F.when(i == parts - 1, F.array(F.lit(eos))).otherwise(F.array().cast("array<int>"))),
    )


def segments(docs: DataFrame, bos: int = 1, eos: int = 2, longest: int = 65_536) -> DataFrame:
    """One row a segment: seg_idx and seg (its ids), instead of ids."""
    return docs.select(*(c for c in docs.columns if c != "ids"), F.posexplode(frame(F.col("ids"), bos, eos, longest)).alias("seg_idx", "seg"))


def segment_lengths(docs: DataFrame, n: str = "n_tokens", longest: int = 65_536) -> DataFrame:
    """As segments(), from counts alone: seg_idx, seg_tokens, has_bos, has_eos."""
    parts = F.greatest(F.ceil(F.col(n) / longest), F.lit(1)).cast("int")
    rows = docs.withColumn("_parts", parts).withColumn("seg_idx", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    first, last = F.col("seg_idx") == 0, F.col("seg_idx") == F.col("_parts") - 1
    inner = F.least(F.col(n) - F.col("seg_idx") * longest, F.lit(longest))
    return rows.select(*docs.columns, "seg_idx", (inner + first.cast("int") + last.cast("int")).cast("long").alias("seg_tokens"), first.alias("has_bos"), last.alias("has_eos"))


def offsets(docs: DataFrame, tokens: str = "n_framed", order: str = "line_idx", major: list[str] | None = None, chunk: int = CHUNK, span: int | None = None) -> DataFrame:
    """Adds off: where a document's tokens start in its split's stream."""
    return prefix_sum(docs, tokens, order, ["split"], major, chunk, out="off", span=span)


def shard_pieces(docs: DataFrame, limit: int, tokens: str = "n_framed", off: str = "off") -> DataFrame:
    """One row for each shard that a document's tokens fall into: shard, shard_off (where they start in the shard), skip
    (tokens of the document before the piece) and take."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    n, o = F.col(tokens), F.col(off)
    rows = docs.where(n > 0).withColumn("shard", F.explode(F.sequence(F.floor(o / limit), F.floor((o + n - 1) / limit))))
    start = F.greatest(o, F.col("shard") * limit)
    return rows.withColumn("shard_off", start - F.col("shard") * limit).withColumn("skip", start - o).withColumn("take", F.least(o + n, (F.col("shard") + 1) * limit) - start)


def shard_table(pieces: DataFrame) -> DataFrame:
    """One row a shard: its tokens and the documents in it; shards without tokens do not exist."""
    return pieces.groupBy("split", "shard").agg(F.sum("take").alias("tokens"), F.count("*").alias("pieces"))


def block_index(shards: DataFrame, context: int) -> DataFrame:
    """Adds blocks (whole blocks of context + 1 tokens that share one token with the next) and first_block, the number of
    blocks before the shard in its split; shards without a block are left out. One row a shard: metadata."""
    rows = shards.withColumn("blocks", F.greatest(F.floor((F.col("tokens") - 1) / context), F.lit(0)).cast("long")).where("blocks > 0")
    before = Window.partitionBy("split").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("first_block", F.coalesce(F.sum("blocks").over(before), F.lit(0)).cast("long"))


def lookup(indices: DataFrame, index: DataFrame, idx: str = "idx") -> DataFrame:
    """Shard and block within the shard of global block numbers of one split; a negative number counts from the end and
    one that is out of range raises an error.

    index has one row a shard. Blocks fall into buckets as wide as a mean shard; each shard is listed under the buckets
    that it reaches into (fewer than two rows a shard in all), so that an equi-join finds it."""
    total = F.col("_total")
    sums = index.agg(F.coalesce(F.sum("blocks"), F.lit(0)).alias("_total"), F.greatest(F.floor(F.sum("blocks") / F.count("*")), F.lit(1)).alias("_width"))
    rows = indices.join(F.broadcast(sums))  # one row
    at = F.when(F.col(idx) < 0, F.col(idx) + total).otherwise(F.col(idx))
    at = F.when((at < 0) | (at >= total), F.raise_error(F.lit("block out of range")).cast("long")).otherwise(at)
    rows = rows.select(*indices.columns, at.alias("_at"), F.floor(at / F.col("_width")).alias("_bucket"))
    last = F.col("first_block") + F.col("blocks") - 1
    listed = index.join(F.broadcast(sums)).select("shard", "first_block", last.alias("_last"), F.explode(F.sequence(F.floor(F.col("first_block") / F.col("_width")), F.floor(last / F.col("_width")))).alias("_bucket"))
    # a left join, so that numbers out of range are met even where no shard has their bucket
    found = rows.join(listed, (rows["_bucket"] == listed["_bucket"]) & (F.col("first_block") <= F.col("_at")) & (F.col("_at") <= F.col("_last")), "left")
    return found.select(*indices.columns, F.col("_at").alias("global_idx"), "shard", (F.col("_at") - F.col("first_block")).alias("block"))


def blocks(shards: DataFrame, context: int, tokens: str = "tokens") -> DataFrame:
    """Blocks of each row's token array: block, input_ids and labels, which are the inputs shifted by one."""
    t = F.col(tokens)
    n = F.greatest(F.floor((F.size(t) - 1) / context), F.lit(0)).cast("int")
    rows = shards.where(F.size(t) > context).withColumn("block", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.select(*(c for c in shards.columns if c != tokens), "block", F.slice(t, F.col("block") * context + 1, F.lit(context)).alias("input_ids"), F.slice(t, F.col("block") * context + 2, F.lit(context)).alias("labels"))


def last_tokens(ids: Column, n: int) -> Column:
    """The last n ids: a prompt or context cut on the left."""
    return F.slice(ids, F.greatest(F.size(ids) - n + 1, F.lit(1)), F.lit(n))


def batches(rows: DataFrame, order: str, size: int, accumulation: int, by: list[str] | None = None) -> DataFrame:
    """Adds batch and steps: whether an optimiser step follows the batch (each accumulation-th one, and the last)."""
    before = prefix_sum(rows.withColumn("_one", F.lit(1)), "_one", order, by, out="_n").drop("_one")
    out = before.withColumn("batch", F.floor(F.col("_n") / size).cast("long")).drop("_n")
    total = out.groupBy(*(by or [])).agg(F.max("batch").alias("_last"))
    out = out.join(F.broadcast(total), by) if by else out.join(F.broadcast(total))  # one row a group
    return out.withColumn("steps", ((F.col("batch") + 1) % accumulation == 0) | (F.col("batch") == F.col("_last"))).drop("_last")
