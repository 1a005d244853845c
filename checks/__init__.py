"""Queries over the given tables that exercise every operator, with SQL to compare against."""

from importlib import import_module

ALL_MODULES = [import_module(f"checks.{name}") for name in ("q_text", "q_reviews", "q_reports", "q_ledger", "q_vectors")]
