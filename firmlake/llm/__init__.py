"""Operators for training-data pipelines: dedup, classification, tokenisation and packing."""
