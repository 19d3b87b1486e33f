"""Operators for training-data pipelines: mixing, filtering, near duplicates, decontamination, search, encoding."""
