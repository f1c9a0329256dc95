"""Queries and oracles of the llm subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import licenses, ngram_join, url_templates
from corpusloom.llm.bpe_tree import op9_bpe_tree
from corpusloom.llm.decontaminate import op6_decontaminate
from corpusloom.llm.ngram_join import op1_ngram_join
from corpusloom.llm.quality_nbsvm import op10_quality_nbsvm
from corpusloom.llm.secrets_crf import op7_secrets_crf
from corpusloom.llm.shards import op3_sharding
from corpusloom.llm.syncmers import op8_syncmers
from corpusloom.llm.token_counts import op5_token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_url_templates": url_templates.op2_url_templates,
        "op3_sharding": op3_sharding,
        "op4_licenses": licenses.op4_licenses,
        "op5_token_counts": op5_token_counts,
        "op6_decontaminate": op6_decontaminate,
        "op7_secrets_crf": op7_secrets_crf,
        "op8_syncmers": op8_syncmers,
        "op9_bpe_tree": op9_bpe_tree,
        "op10_quality_nbsvm": op10_quality_nbsvm,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_join": ngram_join.ORACLE,
        "op2_url_templates": url_templates.ORACLE,
        "op4_licenses": licenses.ORACLE,
    }
