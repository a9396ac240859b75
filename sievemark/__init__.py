"""Spark jobs for evidence retrieval, evidence ledgers, evaluation and training-data preparation."""
