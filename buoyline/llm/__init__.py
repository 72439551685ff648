"""Operators for training-data pipelines: text, vectors and web archives."""
