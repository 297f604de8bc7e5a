"""Queries of the corpus operators with their DuckDB equivalents."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: query -> (module, name of its SQL or None)
QUERIES: dict[str, tuple[str, str | None]] = {
    "op1_ngram_join": ("ngram_join", None),
    "op2_mixing": ("mixing", "OP2_SQL"),
    "op3_pii": ("pii", None),
    "op4_fingerprints": ("fingerprint", None),
    "op5_quality": ("quality", None),
    "op6_packing": ("packing", None),
    "op7_exact_dedup": ("exact_dedup", "OP7_SQL"),
    "op8_toxicity": ("toxicity", None),
    "op9_line_dedup": ("line_dedup", None),
    "op10_url_filters": ("url_filter", "OP10_SQL"),
    "op11_fill_middle": ("fill_middle", "OP11_SQL"),
    "op12_neighbours": ("neighbours", None),
    "op13_lexical": ("lexical", "OP13_SQL"),
}


def _module(name: str):
    return importlib.import_module(f"lodestone.llm.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q: getattr(_module(m), q) for q, (m, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {q: getattr(_module(m), s) for q, (m, s) in QUERIES.items() if s}
