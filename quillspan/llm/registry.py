"""Names of the training-data queries, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from .common import text_batches

#: query name -> module of this package that holds the function of that name
NAMES = {
    "op1_pii_surrogates": "pii_surrogates",
    "op2_language_id": "language_id",
    "op3_chat_formatting": "chat_template",
    "op4_token_binary": "token_binary",
    "op5_jaccard_join": "jaccard_join",
    "op6_embedding_caps": "embedding_caps",
    "op7_decontamination": "decontamination",
    "op8_token_counts": "token_counts",
    "op9_source_mixing": "mixing",
    "op10_rule_ensemble": "rule_ensemble",
    "near_vectors_derived": "embedding_caps",
}


def _asked(module: str, name: str) -> Callable[[SparkSession, str], DataFrame]:
    ask = getattr(import_module(f"{__package__}.{module}"), name)

    @wraps(ask)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text_batches(spark)
        return ask(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _asked(module, name) for name, module in NAMES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLES", {}).get(name) for name, module in NAMES.items()}
    return {name: sql for name, sql in found.items() if sql}
