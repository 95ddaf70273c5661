"""All registered queries of the engine and their DuckDB equivalents."""

from contactloom.plans import addresses, documents, more, pipelines, relations  # noqa: F401  they register themselves
from contactloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
