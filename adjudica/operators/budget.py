"""Token budgets: who is paid for before the cap is passed."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from adjudica.operators import ordered
from adjudica.sources.scratch import materialise

#: Ranges a stretch of the order is cut into at a time.
RANGES = 64


class Budgeted(NamedTuple):
    """Calls charged before the first one that would pass the cap."""

    rows: DataFrame
    breached: bool
    spent: int


class Threshold(NamedTuple):
    """The first key at which the running sum passes the cap: the sum before it, its rows and their cost."""

    key: dict
    before: int
    cost: int


def _splitters(rows: DataFrame, key: Column, ranges: int) -> list:
    """Up to ``ranges`` - 1 different keys, drawn by their hash, in order."""
    drawn = rows.select(key.alias("k")).distinct().orderBy(F.xxhash64("k")).limit(ranges - 1)
    return [r["k"] for r in drawn.orderBy("k").collect()]


def first_beyond(narrow: DataFrame, order: Sequence[str], cost: str, cap: int, ranges: int = RANGES) -> Threshold | None:
    """The key of (order) at which the sum of ``cost``, taken in key order, passes the cap; None if it does not.

    A search in ever narrower stretches of the order: some keys, drawn by hash, cut the stretch, one
    aggregation gives the sum of each part, and the part that crosses the cap is next. It ends at one
    key, however many rows share it. No rows are sorted or brought together, and the driver gets
    as many sums as there are parts. ``narrow`` is read twice in each of about log(keys) / log(ranges) rounds.
    """
    key, types = F.struct(*order), narrow.select(*order).schema
    inside, before = narrow, 0
    while True:
        cuts = _splitters(inside, key, ranges)
        if not cuts:
            return None
        bounds = F.array(*[_literal(cut, types) for cut in cuts])
        # A part for each cut's own key, and one for the keys between two cuts.
        part = 2 * F.size(F.filter(bounds, lambda x: x < key)) + F.array_contains(bounds, key).cast("int")
        sums = inside.groupBy(part.alias("part")).agg(
            F.coalesce(F.sum(cost), F.lit(0)).alias("sum"), F.min(key).alias("lo"), F.max(key).alias("hi"), F.max(cost).alias("cost")
        )
        crossed = None
        for row in sorted(sums.collect(), key=lambda r: r["part"]):
            if before + row["sum"] > cap:
                crossed = row
                break
            before += row["sum"]
        if crossed is None:
            return None
        if crossed["lo"] == crossed["hi"]:
            return Threshold(crossed["lo"].asDict(), int(before), int(crossed["cost"]))
        inside = narrow.where((key >= _literal(crossed["lo"], types)) & (key <= _literal(crossed["hi"], types)))


def within_budget(
    df: DataFrame,
    order: Sequence[str],
    tokens: Column,
    cap: int,
    segments: int | None = None,
) -> Budgeted:
    """Charge calls in order and stop at the first that would pass ``cap``; reaching it is fine.

    Calls with equal keys are charged from the cheapest on, and calls of equal cost there in the
    order of a hash of their content; calls that are equal in all are alike, and so many of them are
    charged as the cap allows. The wide rows are read twice: for their narrow (order, cost, hash)
    rows, which are stored, and for the result, a filter on the threshold. ``segments`` is the number
    of parts of each round of the search for it.
    """
    content = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    extra = {
        "__cost": tokens.cast("bigint"),
        "__h1": F.xxhash64(F.lit(1), content),
        "__h2": F.xxhash64(F.lit(2), content),
    }
    full = [*order, *extra]
    narrow = materialise(df.select(*order, *[c.alias(n) for n, c in extra.items()]), "budget")
    total = narrow.agg(F.coalesce(F.sum("__cost"), F.lit(0))).first()[0]
    stop = first_beyond(narrow, full, "__cost", cap, max(segments or RANGES, 2))
    if stop is None:
        return Budgeted(df, False, int(total))
    at = _literal(stop.key, narrow.select(*full).schema)
    keyed = df.select("*", *[c.alias(n) for n, c in extra.items()])
    # All calls at the threshold are alike: some of their copies are still paid for.
    paid = max((cap - stop.before) // stop.cost, 0)
    earlier = keyed.where(F.struct(*full) < at).select(*df.columns)
    rows = earlier
    if paid:
        one = keyed.where(F.struct(*full) == at).agg(F.first(content).alias("__row"))
        rows = earlier.unionByName(one.select("__row", F.explode(F.sequence(F.lit(1), F.lit(paid)))).select("__row.*"))
    return Budgeted(rows, True, int(stop.before + paid * stop.cost))


def _literal(row, schema: StructType) -> Column:
    return F.struct(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in schema.fields])


def running_spend(df: DataFrame, order: Sequence[str], tokens: Column, cap: int) -> DataFrame:
    """Every call with the total it would bring the run to, and whether it is still charged."""
    total = ordered.running_sums(df, [], order, {"running_tokens": tokens.cast("bigint")})
    return total.withColumn("within", F.col("running_tokens") <= cap)
