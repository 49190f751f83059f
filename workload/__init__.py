"""Registered queries over the given tables, each with the SQL that must give the same rows."""

from workload import chats, corpus, evaluation, questions, tokens  # noqa: F401
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
