"""Operators for training-data pipelines: cleaning, extraction, search and packing of texts."""
