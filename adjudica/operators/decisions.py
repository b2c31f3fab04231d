"""Decisions, their evaluation over rows, and admission.

A decision is a name and a Column builder valued in some monoid. Evaluating a decision system is
one projection: Catalyst sees plain expressions, prunes unused inputs and compiles them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from adjudica import schemas
from adjudica.operators.monoids import JOINT, VIOLATIONS, Monoid, Product

ColumnBuilder = Callable[[], Column]


@dataclass(frozen=True)
class Decision:
    """Any decision; one made by :func:`lift` remembers what it lifted, and into which slot."""

    name: str
    value: ColumnBuilder
    lifted: AnyDecision | None = None
    slot: str | None = None


@dataclass(frozen=True)
class Rule:
    """Binary decision: one violation when ``fires`` is true, none when it is false or NULL."""

    name: str
    fires: ColumnBuilder
    message: ColumnBuilder
    context: Callable[[], dict[str, Column]] = dict

    def fired(self) -> Column:
        return F.coalesce(self.fires(), F.lit(False))

    def violation(self) -> Column:
        entries: list[Column] = []
        for key, value in self.context().items():
            entries += [F.lit(key), value.cast("string")]
        context = F.create_map(*entries) if entries else F.create_map()
        return F.struct(
            F.lit(self.name).alias("rule_name"),
            self.message().cast("string").alias("message"),
            context.cast("map<string,string>").alias("context"),
        )

    def value(self) -> Column:
        return F.when(self.fired(), F.array(self.violation())).otherwise(VIOLATIONS.empty())


@dataclass(frozen=True)
class Score:
    """Graded decision: the amount of risk a row adds. An unknown amount is above every budget."""

    name: str
    amount: ColumnBuilder

    def value(self) -> Column:
        return F.coalesce(self.amount().cast("double"), F.lit(float("inf")))


AnyDecision = Decision | Rule | Score


def guarded(guard: ColumnBuilder, rule: Rule) -> Rule:
    """The rule, asked where ``guard`` holds or is unknown: what may apply is asked."""
    return replace(rule, fires=lambda: F.when(F.coalesce(guard(), F.lit(True)), rule.fires()).otherwise(F.lit(False)))


def for_jurisdiction(code: str, rule: Rule) -> Rule:
    return guarded(lambda: F.col("jurisdiction") == code, rule)


def for_product_line(line: str, rule: Rule) -> Rule:
    return guarded(lambda: F.col("product_line") == line, rule)


def lift(decision: AnyDecision, slot: str, monoid: Product = JOINT) -> Decision:
    """Place a decision in one component of a product; the others get their identity."""
    return Decision(
        decision.name, lambda: monoid.of(**{slot: decision.value()}), lifted=decision, slot=slot
    )


def lift_all(decisions: Sequence[AnyDecision], monoid: Product = JOINT) -> list[Decision]:
    """Rules to the violation slot, scores to the score slot."""
    return [
        d
        if isinstance(d, Decision)
        else lift(d, "violations" if isinstance(d, Rule) else "score", monoid)
        for d in decisions
    ]


def evaluate(system: Sequence[AnyDecision], monoid: Monoid) -> Column:
    """Fold of all decisions over a row; an empty system gives the identity."""
    return monoid.fold([d.value() for d in system])


def plain_rules(system: Sequence[AnyDecision], slot: str = "violations") -> list[Rule] | None:
    """The rules behind a system's violations, in order; None when some are not plain rules."""
    found: list[Rule] = []
    for d in system:
        source = d.lifted if isinstance(d, Decision) and d.slot == slot else d
        if isinstance(source, Rule):
            found.append(source)
        elif isinstance(source, Decision) and source.slot in (None, slot):
            return None
    return found


def fired_names(rules: Sequence[Rule]) -> Column:
    """Names of the rules that fire, in order, without building their violations."""
    return F.array_compact(F.array(*[F.when(r.fired(), F.lit(r.name)) for r in rules])).cast(
        "array<string>"
    )


# Admission predicates -----------------------------------------------------------------------


class Admission:
    """Predicate over a payload.

    ``over`` may use the system that makes the payload: whether no rule fires is a plain boolean
    over the inputs, much cheaper than building the violation list and asking for its size.
    """

    def __call__(self, payload: Column) -> Column:
        raise NotImplementedError

    def over(self, system: Sequence[AnyDecision], payload: Column) -> Column:
        return self(payload)


class NoViolation(Admission):
    def __call__(self, payload: Column) -> Column:
        return F.size(payload) == 0

    def over(self, system: Sequence[AnyDecision], payload: Column) -> Column:
        rules = plain_rules(system)
        if rules is None:
            return self(payload)
        fired = F.lit(False)
        for rule in rules:
            fired = fired | rule.fired()
        return ~fired


@dataclass(frozen=True)
class Below(Admission):
    """Strictly below the cap."""

    cap: float

    def __call__(self, payload: Column) -> Column:
        return payload < F.lit(float(self.cap))


@dataclass(frozen=True)
class Joint(Admission):
    """No violation, and a score below the cap."""

    cap: float

    def __call__(self, payload: Column) -> Column:
        return NoViolation()(payload["violations"]) & Below(self.cap)(payload["score"])

    def over(self, system: Sequence[AnyDecision], payload: Column) -> Column:
        clean = NoViolation().over(system, payload["violations"])
        return clean & Below(self.cap)(payload["score"])


adm_no_violation = NoViolation()
adm_below = Below
adm_joint = Joint


def adm_risk_profile(cap: float, critical: int) -> Callable[[Column], Column]:
    return lambda m: (m["score"] < F.lit(float(cap))) & (m["severity"] < F.lit(critical))


def adm_always(_: Column) -> Column:
    return F.lit(True)


def admitted(adm: Callable[[Column], Column], system: Sequence[AnyDecision], payload: Column) -> Column:
    return adm.over(system, payload) if isinstance(adm, Admission) else adm(payload)


def validate(
    df: DataFrame,
    system: Sequence[AnyDecision],
    monoid: Monoid,
    adm: Callable[[Column], Column],
    payload: str = "payload",
) -> DataFrame:
    """Add the folded ``payload`` and ``admitted``. The payload stays on the row either way."""
    value = evaluate(system, monoid)
    return df.withColumns({payload: value, "admitted": admitted(adm, system, value)})


def payload_json(payload: Column, monoid: Monoid) -> Column:
    """JSON text of a payload. A product becomes an array, one element per component."""
    if isinstance(monoid, Product):
        parts = [payload_json(payload[n], m) for n, m in monoid.parts]
        return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))
    if monoid.dtype.typeName() in ("array", "struct", "map"):
        return F.to_json(payload)
    return payload.cast("string")


# Row-callable surface -----------------------------------------------------------------------
#
# For rules that cannot be written as Columns. A callable gets one row as a dict and returns an
# element of a Python monoid, given here as its identity and its combine function.

OUTCOME = StructType([StructField("admitted", BooleanType()), StructField("payload_json", StringType())])


def validator_udf(
    schema: StructType,
    decisions: Sequence[Callable[[dict[str, Any]], Any]],
    adm: Callable[[Any], bool],
    empty: Callable[[], Any] = list,
    combine: Callable[[Any, Any], Any] = lambda x, y: x + y,
):
    """Arrow-batched validator over a contract's domain columns, in contract order."""
    names = list(schemas.udf_argument_types(schema))
    rules = list(decisions)

    @F.pandas_udf(OUTCOME)
    def run(*columns: pd.Series) -> pd.DataFrame:
        admitted: list[bool] = []
        payloads: list[str] = []
        for values in zip(*columns, strict=True):
            row = dict(zip(names, values, strict=True))
            total = empty()
            for rule in rules:
                total = combine(total, rule(row))
            admitted.append(bool(adm(total)))
            payloads.append(json.dumps(total, default=str))
        return pd.DataFrame({"admitted": admitted, "payload_json": payloads})

    return run


def register(spark: SparkSession, name: str, schema: StructType, decisions, adm, **monoid) -> str:
    """Make a validator callable from SQL; returns the call text over the domain columns."""
    spark.udf.register(name, validator_udf(schema, decisions, adm, **monoid))
    return f"{name}({', '.join(schemas.udf_argument_types(schema))})"
