"""Where queries register themselves with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .roles import Roles, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, roles: str = ""):
    """Registers a function of Roles under name; sql reads the named roles and the supplied tables."""

    def add(f: Callable[[Roles], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Roles(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = oracle(sql, *roles.split())
        return f

    return add
