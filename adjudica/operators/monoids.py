"""Monoids over Columns: an identity, an associative ``combine``, and the fold of many values.

``fold`` must equal the left fold of ``combine`` from ``empty``; monoids override it only to hand
Catalyst one flat expression instead of a deep nest.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, StringType, StructField, StructType

from adjudica.schemas import VIOLATION

# Severity names from mildest to worst; a rank is the position in this list.
SEVERITIES = ["NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL"]


class Monoid:
    dtype: DataType

    def empty(self) -> Column:
        raise NotImplementedError

    def combine(self, x: Column, y: Column) -> Column:
        raise NotImplementedError

    def fold(self, values: Sequence[Column]) -> Column:
        return reduce(self.combine, values, self.empty())


@dataclass(frozen=True)
class ListOf(Monoid):
    """Free monoid: lists under concatenation, order kept."""

    element: DataType = VIOLATION

    @property
    def dtype(self) -> DataType:
        return ArrayType(self.element)

    def empty(self) -> Column:
        return F.array().cast(self.dtype)

    def combine(self, x: Column, y: Column) -> Column:
        return F.concat(x, y)

    def fold(self, values: Sequence[Column]) -> Column:
        return F.concat(*values) if values else self.empty()


@dataclass(frozen=True)
class Score(Monoid):
    """Non-negative reals under addition."""

    dtype: DataType = DoubleType()

    def empty(self) -> Column:
        return F.lit(0.0)

    def combine(self, x: Column, y: Column) -> Column:
        return x + y


@dataclass(frozen=True)
class Worst(Monoid):
    """Severity ranks under maximum."""

    dtype: DataType = IntegerType()

    def empty(self) -> Column:
        return F.lit(0)

    def combine(self, x: Column, y: Column) -> Column:
        return F.greatest(x, y)


@dataclass(frozen=True)
class Product(Monoid):
    """Componentwise product, as a struct with one named slot per component."""

    parts: tuple[tuple[str, Monoid], ...]

    @property
    def dtype(self) -> DataType:
        return StructType([StructField(n, m.dtype) for n, m in self.parts])

    def of(self, **values: Column) -> Column:
        """An element with the given slots; the others hold their identity."""
        unknown = values.keys() - {n for n, _ in self.parts}
        if unknown:
            raise ValueError(f"no such component: {sorted(unknown)}")
        return F.struct(*[values.get(n, m.empty()).alias(n) for n, m in self.parts])

    def empty(self) -> Column:
        return self.of()

    def combine(self, x: Column, y: Column) -> Column:
        return self.of(**{n: m.combine(x[n], y[n]) for n, m in self.parts})

    def fold(self, values: Sequence[Column]) -> Column:
        return self.of(**{n: m.fold([v[n] for v in values]) for n, m in self.parts})


def product(**parts: Monoid) -> Product:
    return Product(tuple(parts.items()))


VIOLATIONS = ListOf()
SCORE = Score()
JOINT = product(violations=VIOLATIONS, score=SCORE)
RISK_PROFILE = product(score=SCORE, severity=Worst())
ADVISED_SCORE = product(score=SCORE, advisories=ListOf(StringType()))
