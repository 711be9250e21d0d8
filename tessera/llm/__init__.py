"""Operators for large-scale training-data pipelines, each usable on its own."""
