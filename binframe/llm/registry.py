"""The queries of the corpus operators, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

#: Query name: module of this subpackage with a function of that name and, where SQL can express it, its SQL.
QUERIES = {
    "op1_pii": "pii",
    "op2_fingerprint": "fingerprint",
    "op3_bpe": "bpe",
    "op4_langid": "langid",
    "op5_token_count": "token_count",
    "op6_toxicity": "toxicity",
    "op7_token_io": "token_io",
    "op8_jaccard_join": "jaccard_join",
    "op9_suffix_dedup": "suffix_dedup",
    "op10_decontaminate": "decontaminate",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"binframe.llm.{module}"), name) for name, module in QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    modules = {name: import_module(f"binframe.llm.{module}") for name, module in QUERIES.items()}
    found = {name: m.ORACLE_SQL for name, m in modules.items() if getattr(m, "ORACLE_SQL", None)}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
