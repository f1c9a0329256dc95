"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Every stage function takes (spark, docs, sf_dir), works on all its predecessor kept, and returns a DataFrame; all but
the last return the columns of documents. Rows with nulls, empty texts and repeated rows pass through each stage as
its operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe_tree, decontaminate, ngram_join, quality_nbsvm, secrets_crf
from corpusloom.llm.common import delete, materialise, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents scored below the threshold go. Learnt from all labelled rows but the held-out ones.

    Null and empty texts score as the bias alone does; repeated rows go or stay alike; without labels all rows score
    even odds and go; an empty table stays empty; further columns pass through."""
    model = quality_nbsvm.train(docs, table(spark, sf_dir, "labels"), ~quality_nbsvm.held_out(F.col("doc_id")))
    return quality_nbsvm.kept(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each group of near duplicates (shingles of five words, similarity 0.8) one document stays.

    The first by doc_id stays; of rows that repeat a doc_id the first by text and columns. Rows without a text, without words
    or without a doc_id stay; copies that are less alike than 0.8 stay."""
    return ngram_join.deduplicated(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that hold a benchmark item go.

    Items and texts that are null or normalise to nothing match nothing; repeated rows are judged one by one; without items
    all documents stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: secrets are masked in the text; every document stays.

    Null texts stay null; spans that overlap share one mask; n_chars follows the text; without texts to learn from only the base
    patterns are masked."""
    return secrets_crf.redact(docs, secrets_crf.train(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: ids of every text, with their digests and those of the decoded text.

    A null text counts as empty (no ids); repeated rows give repeated results."""
    return bpe_tree.digests(docs)


STAGES = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secrets),
    ("bpe_encoding", encoding),
]

#: SQL cannot express the stages (a fitted model, set similarity components, edit distance); tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
            if i:
                delete(before)
    return docs
