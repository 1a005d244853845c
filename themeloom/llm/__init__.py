"""Operators of a training-data pipeline: text, archives, mixing, search and deduplication at corpus scale."""
