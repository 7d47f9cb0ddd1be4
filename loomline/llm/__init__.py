"""Operators of a training-data pipeline: packing, search, language, deduplication, archives."""
