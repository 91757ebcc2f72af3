"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from larkspur.llm import bpe, exact_dedup, jaccard, lattice, mixing, quality, substring_dedup, suffix_dedup, token_counts, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_bpe": bpe.op2_bpe,
        "op3_mixing": mixing.op3_mixing,
        "op4_suffix_array_dedup": suffix_dedup.op4_suffix_array_dedup,
        "op5_exact_dedup": exact_dedup.op5_exact_dedup,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_ngram_jaccard": jaccard.op7_ngram_jaccard,
        "op8_quality": quality.op8_quality,
        "op9_lattice_neardup": lattice.op9_lattice_neardup,
        "op10_substring_dedup": substring_dedup.op10_substring_dedup,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    """Where SQL can express a query and is quick enough over whole tables."""
    return {
        "op3_mixing": mixing.SQL,
        "op5_exact_dedup": exact_dedup.SQL,
        "op7_ngram_jaccard": jaccard.SQL,
        "op9_lattice_neardup": lattice.SQL,
        "op10_substring_dedup": substring_dedup.SQL,
    }
