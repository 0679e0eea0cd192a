"""The corpus operators as registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, centroids, filter_audit, iblt, neardup, packing, quality, sharding, telephony, tiktoken_bpe, token_counts, toxicity, url_filter
from tidemark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _documents(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


def _labelled(operator: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    return {
        "op1_url_filter": lambda spark, sf_dir: url_filter.op1(table(spark, sf_dir, "pages")),
        "op2_telephony_audio": _documents(telephony.op2),
        "op3_byte_network": _labelled(quality.op3),
        "op4_trie_bpe": _documents(bpe.op4),
        "op5_token_counts": _documents(token_counts.op5),
        "op6_pu_toxicity": _labelled(toxicity.op6),
        "op7_curve_packing": _documents(packing.op7),
        "op8_iblt_fingerprints": _documents(iblt.op8),
        "op9_jump_sharding": _documents(sharding.op9),
        "op10_minmax_neardup": _documents(neardup.op10),
        "op11_tiktoken_bpe": _documents(tiktoken_bpe.op11),
        "op12_filter_audit": _labelled(filter_audit.op12),
        "op13_pca_centroids": lambda spark, sf_dir: centroids.op13(table(spark, sf_dir, "embeddings")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": url_filter.oracle_sql(),
        "op9_jump_sharding": sharding.oracle_sql(),
        "op10_minmax_neardup": neardup.oracle_sql(),
        "op12_filter_audit": filter_audit.oracle_sql(),
        "op13_pca_centroids": centroids.oracle_sql(),
    }
