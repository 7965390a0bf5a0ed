"""Every query of the engine with its SQL, by name."""

from .queries import *  # noqa: F403  (registers the queries)
from .registry import COVERS, ORACLE_SQL, QUERIES

__all__ = ["COVERS", "ORACLE_SQL", "QUERIES"]
