"""The corpus queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

NAMES = ["op1_extract", "op2_packing", "op3_lm", "op4_neardup", "op5_toxicity", "op6_fingerprint", "op7_vectors", "op8_license", "op9_substring", "op10_bpe"]

QUERIES = {n: getattr(import_module(f"{__package__}.{n}"), n) for n in NAMES}
ORACLE_SQL: dict[str, str] = {"op8_license": import_module(f"{__package__}.op8_license").oracle_sql()}
