"""Who may see a row, as a lattice: visible, restricted to some roles, erased.

An element is a struct ``(erased, roles)``; NULL roles mean everyone. The meet of two elements is
the more restrictive one: erased wins, and role sets intersect.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, StringType, StructField, StructType

from adjudica.operators.decisions import AnyDecision, Decision, evaluate
from adjudica.operators.monoids import Monoid

# The role that may see erased rows, and the roles of a litigation hold.
AUDITOR = "PRIVACY_OFFICER"
LITIGATION_ROLES = ["LITIGATION", "PRIVACY_OFFICER"]

_TYPE = StructType(
    [StructField("erased", BooleanType()), StructField("roles", ArrayType(StringType()))]
)


def everyone() -> Column:
    return F.struct(F.lit(False).alias("erased"), F.lit(None).cast("array<string>").alias("roles"))


def erased() -> Column:
    return F.struct(F.lit(True).alias("erased"), F.lit(None).cast("array<string>").alias("roles"))


def restricted_to(roles: Sequence[str]) -> Column:
    return F.struct(
        F.lit(False).alias("erased"), F.array(*[F.lit(r) for r in roles]).alias("roles")
    )


@dataclass(frozen=True)
class Visibility(Monoid):
    dtype: DataType = _TYPE

    def empty(self) -> Column:
        return everyone()

    def combine(self, x: Column, y: Column) -> Column:
        roles = (
            F.when(x["roles"].isNull(), y["roles"])
            .when(y["roles"].isNull(), x["roles"])
            .otherwise(F.array_intersect(x["roles"], y["roles"]))
        )
        return F.struct((x["erased"] | y["erased"]).alias("erased"), roles.alias("roles"))


def erasure_rule() -> Decision:
    return Decision(
        "erasure",
        lambda: F.when(F.coalesce("erased", F.lit(True)), erased()).otherwise(everyone()),
    )


def hold_rule(name: str, held, roles: Sequence[str]) -> Decision:
    """Rows under a hold are shown to some roles only."""
    return Decision(name, lambda: F.when(held(), restricted_to(roles)).otherwise(everyone()))


def admits(role: str):
    def adm(v: Column) -> Column:
        allowed = v["roles"].isNull() | F.array_contains(v["roles"], role)
        return allowed if role == AUDITOR else ~v["erased"] & allowed

    return adm


def visible_to(df: DataFrame, rules: Sequence[AnyDecision], role: str) -> DataFrame:
    return df.where(F.coalesce(admits(role)(evaluate(rules, Visibility())), F.lit(False)))
