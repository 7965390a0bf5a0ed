"""Queries over the shared tables, each with the SQL it is held against."""

from . import curation, documents, index, keyvalue, learning, metrics, retrieval, streams, text, web  # noqa: F401
