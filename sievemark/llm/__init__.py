"""Operators for large training-data pipelines: tokenizing, decontamination, deduplication, scans, archives."""
