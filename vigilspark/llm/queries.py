"""The registered queries of this package and their SQL on DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vigilspark.llm import (
    binary_output,
    bpe,
    decontamination,
    exact_dedup,
    maxscore,
    mixing,
    ngram_join,
    periodic_runs,
    sharding,
    spelling,
    substring_dedup,
    toxicity,
    url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_toxicity": toxicity.query,
    "op3_ngram_join": ngram_join.query,
    "op4_exact_dedup": exact_dedup.query,
    "op5_mixing": mixing.query,
    "op6_sharding": sharding.query,
    "op7_bpe": bpe.query,
    "op8_url_filter": url_filter.query,
    "op9_maxscore": maxscore.query,
    "op10_binary_output": binary_output.query,
    "op11_spelling": spelling.query,
    "op12_periodic_runs": periodic_runs.query,
    "op13_decontamination": decontamination.query,
}

#: The others have no SQL that ends on whole tables, or none at all; their tests use brute force.
ORACLE: dict[str, str] = {
    "op4_exact_dedup": exact_dedup.SQL,
    "op9_maxscore": maxscore.SQL,
    "op11_spelling": spelling.SQL,
    "op13_decontamination": decontamination.SQL,
}
