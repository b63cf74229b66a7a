"""Operators of a large-scale training-data pipeline."""
