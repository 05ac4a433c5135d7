"""The training operators as registered queries, and SQL where it can express one."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: query name -> module of this subpackage with query(spark, sf_dir) and, where SQL can express it, ORACLE_SQL
MODULES = {
    "op1_embedding_dedup": "embedding_dedup",
    "op2_lm_scores": "lm",
    "op3_substring_dedup": "substring",
    "op4_vector_packing": "packing",
    "op5_token_files": "token_files",
    "op6_kd_sharding": "sharding",
    "op7_quality_rules": "quality",
    "op8_order_minhash": "order_minhash",
    "op9_prefix_table_pieces": "piece",
    "op10_compression_toxicity": "toxicity",
    "op11_prefix_trie": "trie",
    "op12_hard_negatives": "hard_negatives",
    "op13_chat_format": "chat",
}


def _module(name: str):
    return importlib.import_module(f"quillon.llm.{MODULES[name]}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, n=name: _module(n).query(spark, sf_dir) for name in MODULES}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(_module(name), "ORACLE_SQL", None) for name in MODULES}
    return {name: sql for name, sql in found.items() if sql}
