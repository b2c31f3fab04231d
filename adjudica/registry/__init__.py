"""Registered queries: each reads the test tables whole, and has its check in SQL where one exists."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(check: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        key = name or run.__name__
        if key in QUERIES:
            raise ValueError(f"query {key!r} is registered twice")
        QUERIES[key] = run
        if check is not None:
            CHECKS[key] = check
        return run

    return add


def r6(value: Column | str) -> Column:
    """Doubles are compared at six places: sums differ in the last bits between engines."""
    return F.round(F.col(value) if isinstance(value, str) else value, 6)


def names(violations: str = "payload.violations") -> Column:
    """Rule names of a violation list, in order."""
    return F.array_join(F.col(violations)["rule_name"], ",")


def load() -> None:
    """Import every module of this package, which registers its queries."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
