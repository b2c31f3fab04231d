"""The gate before the underwriting rules: rows go by their contract first, then by the rules."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from adjudica import schemas
from adjudica.operators import versions
from adjudica.operators.decisions import AnyDecision, adm_no_violation, validate
from adjudica.operators.monoids import VIOLATIONS, Monoid

REFUSED = "refused"
ADMITTED = "admitted"
REJECTED = "rejected"


class Gated(NamedTuple):
    """``judged`` are the rows that met the contract, with payload and ``admitted``; ``refused`` the others,
    with what is wrong with them and the row as it came."""

    judged: DataFrame
    refused: DataFrame


def gate(
    df: DataFrame,
    system: Sequence[AnyDecision],
    monoid: Monoid = VIOLATIONS,
    adm: Callable[[Column], Column] = adm_no_violation,
    contract: StructType = schemas.UNDERWRITING,
    keep: Sequence[str] = (),
) -> Gated:
    """Judge the rows that meet the contract, refuse the others with every reason.

    A field that is absent, NULL, of another type or not among its allowed values is refused, and so
    is a list that holds a NULL; the prior premium may be missing. NaN is a number to the contract,
    and the rules fire on it. One projection reads the rows for both sides.
    """
    typed, errors = versions.validate_columns(df, contract)
    labelled = df.select("*", errors.alias("__errors"))
    good = labelled.where(F.col("__errors") == "").select(*keep, *[c.alias(n) for n, c in typed.items()])
    refused = labelled.where(F.col("__errors") != "").select(
        *keep, F.col("__errors").alias("detail"), F.struct(*df.columns).alias("raw_row")
    )
    return Gated(validate(good, system, monoid, adm), refused)


def outcomes(gated: Gated, keep: Sequence[str]) -> DataFrame:
    """One row per input row: its side, and why (names of the rules that fired, or what is missing)."""
    judged = gated.judged.select(
        *keep,
        F.when(F.col("admitted"), ADMITTED).otherwise(REJECTED).alias("side"),
        F.array_join(F.col("payload")["rule_name"], ",").alias("why"),
    )
    refused = gated.refused.select(*keep, F.lit(REFUSED).alias("side"), F.col("detail").alias("why"))
    return judged.unionByName(refused)
