"""Operators of a training-data pipeline: tokens, packing, filters, duplicates, extraction."""
