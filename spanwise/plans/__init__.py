"""Named queries, each with the SQL that says the same where SQL can."""

from . import facts, iterative, joins, measures, pairs, scores, sequences, state, structure, texts, vectors  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
