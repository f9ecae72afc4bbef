"""Queries of the training-data operators, one for each, and the SQL that some can be checked with."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from marketlab.llm import (
    chat, decontaminate, katz, langid, packing, passages, prefixes, quality, sharding, simhash, spelling,
    toxicity, vectors)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": simhash.query,
        "op2_mixture_langid": langid.query,
        "op3_schema_chat": chat.query,
        "op4_discriminant": quality.query,
        "op5_template_windows": decontaminate.query,
        "op6_histogram_sort": sharding.query,
        "op7_merged_transforms": passages.query,
        "op8_bin_completion": packing.query,
        "op9_katz": katz.query,
        "op10_multi_index": vectors.query,
        "op11_prefix_rollup": prefixes.query,
        "op12_convolution": toxicity.query,
        "op13_position_index": spelling.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_schema_chat": chat.ORACLE,
        "op7_merged_transforms": passages.ORACLE,
        "op10_multi_index": vectors.ORACLE,
        "op11_prefix_rollup": prefixes.ORACLE,
        "op13_position_index": spelling.ORACLE,
    }
