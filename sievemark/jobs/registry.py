"""All registered queries outside the training-data subpackage, by name, and the SQL that says the same."""

from __future__ import annotations

from . import answers, audits, chunks, conversation, corpus, direct, evaluation, evidence, facts, files, grounded, plans, retrieval, streams, texts  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
