"""Reports over outcomes: rule counts, violation facts, score statistics, spend, labels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from adjudica.operators import ordered
from adjudica.operators.decisions import (
    AnyDecision,
    admitted,
    evaluate,
    fired_names,
    plain_rules,
    validate,
)
from adjudica.operators.monoids import Monoid
from adjudica.schemas import PII_CATEGORIES


def violation_facts(outcomes: DataFrame, row_id: str, violations: str = "payload.violations") -> DataFrame:
    """One row per violation, with its place in the row's list."""
    return outcomes.select(row_id, F.posexplode(violations).alias("position", "v")).select(
        row_id, "position", "v.rule_name", "v.message", "v.context"
    )


def rejection_summary(rejections: DataFrame, violations: str = "payload.violations") -> DataFrame:
    """Rejections per rule, most frequent first. Score-only rejections have no rule to count."""
    fired = F.col("rules") if "rules" in rejections.columns else F.col(violations)["rule_name"]
    return (
        rejections.select(F.explode(fired).alias("rule_name"))
        .groupBy("rule_name")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "rule_name")
    )


def rejection_counts(
    df: DataFrame,
    system: Sequence[AnyDecision],
    adm: Callable[[Column], Column],
    monoid: Monoid,
) -> DataFrame:
    """The same summary straight from proposals, when the rejections table is not needed: only
    the rules' conditions are computed, no message and no violation is built."""
    rules = plain_rules(system)
    if rules is None:
        return rejection_summary(validate(df, system, monoid, adm).where(~F.col("admitted")))
    rejected = df.where(~admitted(adm, system, evaluate(system, monoid)))
    return (
        rejected.select(F.explode(fired_names(rules)).alias("rule_name"))
        .groupBy("rule_name")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "rule_name")
    )


def score_statistics(outcomes: DataFrame, by: Sequence[str], score: Column, outlier: float = 0.9) -> DataFrame:
    """Distribution of scores per group.

    The exact median is the score whose place in the ordered counts is the middle one (or the mean of
    both middle ones). Counts are summed up along range segments of (group, score), so no task holds a
    group, also where nearly all its scores differ.
    """
    counted = outcomes.groupBy(*by, score.alias("score")).agg(F.count(F.lit(1)).alias("n"))
    placed = ordered.running_sums(counted, by, ["score"], {"__upto": F.col("n")})
    key = F.struct(*by).alias("__key")
    totals = counted.groupBy(key).agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("mean_score"),
        F.max("score").alias("max_score"),
        F.sum(F.when(F.col("score") > outlier, F.col("n")).otherwise(0)).alias("n_outliers"),
    )

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("__upto") >= place, F.col("score")))

    lower, upper = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    middle = (
        placed.select(key, "score", "__upto")
        .join(totals.select("__key", "n"), "__key")
        .groupBy("__key")
        .agg(((at(lower) + at(upper)) / 2).alias("median_score"))
    )
    return totals.join(middle, "__key").select(
        "__key.*", "n", "mean_score", "median_score", "max_score", "n_outliers"
    )


def run_log(calls: DataFrame, job: str, run: str, tokens: Column) -> DataFrame:
    """Spend per run, and its change against the job's run before."""
    runs = calls.groupBy(job, run).agg(F.sum(tokens).alias("tokens"), F.count(F.lit(1)).alias("calls"))
    with_prior = ordered.previous(runs, [job], [run], {"prior_tokens": "tokens"})
    return with_prior.withColumn("change", F.col("tokens") - F.col("prior_tokens"))


def merge_labels(labels: DataFrame, field: str = "field") -> DataFrame:
    """One label per field out of several rule sets: the most protective category, all regimes.

    ``labels`` has ``field``, ``category`` and a ``regimes`` array; a NULL category says nothing.
    """
    rank, name = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, category in enumerate(PII_CATEGORIES):
        rank = F.when(F.col("category") == category, i).otherwise(rank)
        name = F.when(F.col("__rank") == i, category).otherwise(name)
    # Sets of distinct regime lists are combined before the shuffle and stay few per field.
    tags = F.array_sort(F.array_distinct(F.flatten(F.collect_set("regimes"))))
    merged = labels.groupBy(field).agg(F.min(rank).alias("__rank"), tags.alias("regimes"))
    return merged.select(field, name.alias("category"), "regimes")
