"""All registered queries by name, with the SQL that says the same."""

from .plans import audience, campaigns, enrich, fields, lists, people, quality, quotes, replies, surface, text, turns, work  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
