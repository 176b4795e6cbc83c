"""Registered queries over the given tables, each with its SQL counterpart."""

from workload import answer_queries, corpus_queries, retrieval_queries, rewriting_queries, structure_queries, text_queries  # noqa: F401
from workload.registry import ORACLES, QUERIES  # noqa: F401
