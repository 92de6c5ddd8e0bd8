"""Queries and oracle SQL of the training-data operators; each imports its module only when it runs."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from riftline.llm.common import read_table

#: Query name: module, and the tables that its ``query`` function takes in this order.
QUERIES: dict[str, tuple[str, tuple[str, ...]]] = {
    "op1_shard": ("sharding", ("documents",)),
    "op2_warc": ("warc", ("pages",)),
    "op3_simhash": ("simhash", ("documents",)),
    "op4_personal": ("pii", ("documents",)),
    "op5_decontaminate": ("decontaminate", ("documents", "benchmark")),
    "op6_licence": ("licenses", ("documents",)),
    "op7_language": ("langid", ("documents",)),
    "op8_vectors": ("embeddings", ("embeddings",)),
    "op9_pack": ("packing", ("documents",)),
    "op10_passages": ("substrings", ("documents",)),
    "op11_toxicity": ("toxicity", ("documents", "labels")),
    "op12_whitening": ("whitening", ("embeddings",)),
    "op13_negatives": ("hardneg", ("embeddings",)),
}


def _query(module: str, tables: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return import_module(f"riftline.llm.{module}").query(*(read_table(spark, sf_dir, t) for t in tables))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(*of) for name, of in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"riftline.llm.{module}"), "ORACLE_SQL", None) for name, (module, _) in QUERIES.items()}
    return {name: sql for name, sql in found.items() if sql}
