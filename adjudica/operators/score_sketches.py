"""Score distributions kept over days: one sketch per group and day, merged when asked.

A day's scores are read once. A question over any span of days reads the sketches of those days, a
few kilobytes a group, whatever the number of scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

K = 400
OUTLIER = 0.9


def rank_error(k: int = K) -> float:
    """Bound on how far, as a share of a group's rows, a quantile's rank may be off.

    Twice the error that a single quantile of a sketch of size ``k`` keeps in 99 of 100 cases
    (2.296 / k ** 0.9723), so that it may be asked of very many groups at once.
    """
    return 2 * 2.296 / k**0.9723


def daily(outcomes: DataFrame, by: Sequence[str], day: Column, score: Column, k: int = K, outlier: float = OUTLIER) -> DataFrame:
    """One row per group and day: sketch, counts and sums. Combined before the shuffle.

    Unknown scores are counted in ``n_unknown`` and are in no other figure. NaN counts as unknown.
    """
    known = F.when(~F.isnan(score), score.cast("double"))
    rows = outcomes.select(*by, day.alias("day"), known.alias("__score"))
    return rows.groupBy(*by, "day").agg(
        F.kll_sketch_agg_double("__score", k).alias("sketch"),
        F.count("__score").alias("n"),
        F.count_if(F.col("__score").isNull()).alias("n_unknown"),
        F.sum("__score").alias("total"),
        F.max("__score").alias("max_score"),
        F.count_if(F.col("__score") > outlier).alias("n_outliers"),
    )


def store(days: DataFrame, path: str) -> None:
    """Write days; a day that is written again replaces itself, other days stay.

    All rows of a day belong to one call, so late rows of a day mean computing that day again.
    """
    (
        days.repartition("day")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .parquet(path)
    )


def merge(days: DataFrame, by: Sequence[str]) -> DataFrame:
    """The days' rows as one per group, with the same columns but ``day``."""
    return days.groupBy(*by).agg(
        F.kll_merge_agg_double("sketch").alias("sketch"),
        *[F.sum(c).alias(c) for c in ("n", "n_unknown", "total")],
        F.max("max_score").alias("max_score"),
        F.sum("n_outliers").alias("n_outliers"),
    )


def statistics(merged: DataFrame, by: Sequence[str], quantiles: dict[str, float] | None = None) -> DataFrame:
    """What :func:`analytics.score_statistics` gives, and further quantiles.

    Count, mean, largest score and outliers are exact, quantiles keep :func:`rank_error`. Groups without
    a known score have NULL figures.
    """
    asked = {"median_score": 0.5} | (quantiles or {})
    filled = F.col("n") > 0
    return merged.select(
        *by,
        "n",
        "n_unknown",
        F.when(filled, F.col("total") / F.col("n")).alias("mean_score"),
        *[F.when(filled, F.kll_sketch_get_quantile_double("sketch", F.lit(q))).alias(name) for name, q in asked.items()],
        "max_score",
        "n_outliers",
    )


def share_below(merged: DataFrame, by: Sequence[str], score: float) -> DataFrame:
    """Share of each group's scores up to ``score``, within :func:`rank_error`."""
    rank = F.when(F.col("n") > 0, F.kll_sketch_get_rank_double("sketch", F.lit(float(score))))
    return merged.select(*by, rank.alias("share"))
