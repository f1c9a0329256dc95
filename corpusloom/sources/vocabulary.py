"""Vocabularies as tables: rank files, special tokens, and listings of remote corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.manifest import read_json


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    """(token BINARY, rank INT) of a rank file: lines of base64, a space and a rank; blank lines are skipped."""
    parts = F.split(F.trim("value"), " ")
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.unbase64(parts[0]).alias("token"), parts[1].cast("int").alias("rank"))


def rank_lines(vocabulary: DataFrame) -> DataFrame:
    """The rank file's lines in the order of rank."""
    return vocabulary.orderBy("rank").select(F.concat(F.regexp_replace(F.base64("token"), r"\s", ""), F.lit(" "), F.col("rank").cast("string")).alias("value"))


def special_tokens(spark: SparkSession, meta_path: str) -> DataFrame:
    """(token, id) of a tokenizer's meta file."""
    return spark.createDataFrame(sorted(read_json(meta_path)["special_tokens"].items(), key=lambda x: x[1]), "token string, id int")


def tokenizer_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token, id) of a tokenizer.json's model without its added tokens, which are joined away."""
    from corpusloom.operators.configs import plain_vocabulary

    data = read_json(path)
    if data["model"].get("type") != "BPE":
        raise ValueError("only BPE models have a vocabulary of ranks")
    vocab = spark.createDataFrame(list(data["model"]["vocab"].items()), "token string, id int")
    added = spark.createDataFrame([(t["content"], t["id"]) for t in data.get("added_tokens", [])], "token string, id int")
    return plain_vocabulary(vocab, added)


def corpus_listing(lines: DataFrame, line: str = "value") -> DataFrame:
    """(kind, name) of remote directories listed as .../data/<kind>-<name>; other lines are left out."""
    pattern = r"data/([a-z0-9_]+)-([^/\s]+)"
    return lines.where(F.col(line).rlike(pattern)).select(F.regexp_extract(line, pattern, 1).alias("kind"), F.regexp_extract(line, pattern, 2).alias("name"))
