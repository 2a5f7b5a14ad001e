"""Operators of a training-data pipeline: search, packing, filtering, dedup, formats, scoring."""
