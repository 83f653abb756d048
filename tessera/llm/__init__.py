"""Operators of a training-data pipeline: deduplication, mixing, packing, language ID, quality and token output."""
