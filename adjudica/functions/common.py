"""Helpers shared by Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it as often as needed in ``body``."""
    return F.transform(F.array(value), body)[0]
