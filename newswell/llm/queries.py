"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newswell.llm.shared import ship

#: Query name to module and SQL constant (or None).
_QUERIES = {
    "op1_quality_rules": ("quality", "OP1_SQL"),
    "op2_masked_lm_score": ("masked_lm", None),
    "op3_ngram_jaccard_join": ("jaccard", "OP3_SQL"),
    "op4_license_scan": ("licenses", None),
    "op5_token_bitpacking": ("bitpack", None),
    "op6_source_mixing": ("mixing", None),
    "op7_jump_sharding": ("jumphash", None),
    "op8_suffix_array_dedup": ("suffix", None),
    "op9_warc_zstd": ("warc", None),
    "op10_decontamination": ("decontam", None),
    "op11_token_counts": ("token_counts", None),
    "op12_hard_negatives": ("hard_negatives", "OP12_SQL"),
    "op13_token_alignment": ("alignment", None),
}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    run = getattr(importlib.import_module(f"newswell.llm.{_QUERIES[name][0]}"), name)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return run(spark, sf_dir)

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(name) for name in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(importlib.import_module(f"newswell.llm.{module}"), sql) for name, (module, sql) in _QUERIES.items() if sql}
