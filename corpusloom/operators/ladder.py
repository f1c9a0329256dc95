"""The document ladder: every raw line lands in exactly one status, tested in this order:
malformed, empty, short, written (with a flag for texts above the longest segment)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.functions import tokenizers
from corpusloom.functions.text import strip

MIN_TOKENS, MAX_TOKENS = 32, 65_536


def _strict(raw: pd.Series) -> pd.DataFrame:
    """Parse as a strict JSON reader does. No object (null, list, number, text) counts as malformed; a text field that is
    missing or no string counts as the empty text; of repeated keys the last one counts."""
    statuses, texts = [], []
    for line in raw:
        try:
            row = json.loads(line)
        except (ValueError, RecursionError, TypeError):
            row = None
        if not isinstance(row, dict):
            statuses.append("malformed")
            texts.append(None)
        else:
            text = row.get("text", "")
            statuses.append("parsed")
            texts.append(text.encode("utf-8", "replace").decode() if isinstance(text, str) else "")
    return pd.DataFrame({"status": statuses, "text": texts})


def strict_json(raw: Column) -> Column:
    """_strict as an Arrow UDF: a struct of status and text."""
    return F.pandas_udf(_strict, StructType().add("status", "string").add("text", "string"))(raw)


def parse(lines: DataFrame, raw: str = "raw", fast: bool = False) -> DataFrame:
    """Adds parse_status (malformed or parsed) and the stripped text.

    fast parses on the JVM as a variant; it differs for NaN and for text after the object, and needs
    spark.sql.variant.allowDuplicateKeys to keep the last of repeated keys."""
    if fast:
        v = F.try_parse_json(F.col(raw))
        kind = F.schema_of_variant(v)
        parsed = v.isNotNull() & kind.startswith("OBJECT")
        field = F.try_variant_get(v, "$.text", "variant")
        text = F.when(F.schema_of_variant(field) == "STRING", F.try_variant_get(v, "$.text", "string")).otherwise("")
        out = lines.withColumn("parse_status", F.when(F.coalesce(parsed, F.lit(False)), "parsed").otherwise("malformed")).withColumn("text", F.when(F.col("parse_status") == "parsed", F.coalesce(text, F.lit(""))))
    else:
        out = lines.withColumn("_parsed", strict_json(F.col(raw))).withColumn("parse_status", F.col("_parsed.status")).withColumn("text", F.col("_parsed.text")).drop("_parsed")
    return out.withColumn("text", strip("text"))


def status(parse_status: Column, text: Column, n_tokens: Column, min_tokens: int = MIN_TOKENS) -> Column:
    return F.when(parse_status == "malformed", "malformed").when(F.length(text) == 0, "empty").when(n_tokens < min_tokens, "short").otherwise("written")


def ladder(docs: DataFrame, tokenizer: str = "utf8_bytes", min_tokens: int = MIN_TOKENS, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Adds status, n_tokens (0 unless counted), is_long and n_framed (tokens with BOS and EOS; 0 unless written) to rows
    with parse_status and text. Malformed and empty rows reach the tokenizer as nulls, which it skips."""
    live = F.when((F.col("parse_status") == "parsed") & (F.length("text") > 0), F.col("text"))
    out = docs.withColumn("n_tokens", F.coalesce(tokenizers.count(tokenizer, live), F.lit(0)).cast("long"))
    out = out.withColumn("status", status(F.col("parse_status"), F.col("text"), F.col("n_tokens"), min_tokens))
    written = F.col("status") == "written"
    return out.withColumn("is_long", written & (F.col("n_tokens") > max_tokens)).withColumn("n_framed", F.when(written, F.col("n_tokens") + 2).otherwise(F.lit(0)).cast("long"))


def from_table(docs: DataFrame, subset: str = "source", line: str = "doc_id") -> DataFrame:
    """Rows of a text table as parsed documents: a null text counts as malformed."""
    text = F.col("text")
    return docs.select(F.col(subset).alias("subset"), F.col(line).alias("line_idx"), F.when(text.isNull(), "malformed").otherwise("parsed").alias("parse_status"), strip(text).alias("text"))


def sampled_texts(texts: DataFrame) -> DataFrame:
    """The estimator's own filter: texts that are not blank, unstripped."""
    return texts.where(F.length(strip("text")) > 0)
