"""The registered queries of the relational engine and their SQL twins."""

from . import engine, joins, scalars, scans, sets, workloads  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
