"""All registered queries; importing the modules registers them."""

from . import aggregates, graph, learning, relational, retrieval, rules, sequences, streaming, text  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
