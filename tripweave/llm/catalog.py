"""Loads every query module of the subpackage."""

from . import q_documents, q_manifest, q_mixing, q_pages, q_tokens, q_vectors, q_words  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
