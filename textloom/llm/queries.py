"""Registered queries of the corpus operators: opN_<name> applies operator N to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import langid, lengths, licenses, media, mixing, neardup, packing, quality, sharding, suffix

#: name, query, DuckDB SQL; None where SQL has no tokenizer, no classifier, or no image operators.
_TABLE = [
    ("op1_token_counts", lengths.op1_token_counts, None),
    ("op2_license_scan", licenses.op2_license_scan, licenses.ORACLE),
    ("op3_quality_rules", quality.op3_quality_rules, quality.ORACLE),
    ("op4_media_copies", media.op4_media_copies, None),
    ("op5_mixing", mixing.op5_mixing, mixing.ORACLE),
    ("op6_language_id", langid.op6_language_id, None),
    ("op7_packing", packing.op7_packing, None),
    ("op8_minhash_neardup", neardup.op8_minhash_neardup, neardup.ORACLE),
    ("op9_suffix_dedup", suffix.op9_suffix_dedup, suffix.ORACLE),
    ("op10_sharding", sharding.op10_sharding, sharding.ORACLE),
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, query, _ in _TABLE}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, _, sql in _TABLE if sql}
