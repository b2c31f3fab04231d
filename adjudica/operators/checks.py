"""Data and schema checks. Each returns a frame; ``passed`` tells the outcome where one row does."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from adjudica import schemas

# Thresholds of the stock checks.
MAX_MEAN_SCORE = 0.6
WARN_UTILISATION = 0.9
WARN_HOURS = 12
FAIL_HOURS = 24
ERASURE_DAYS = 45

DRIFT = "column string, problem string, expected string, actual string"


def schema_drift(df: DataFrame, contract: StructType = schemas.PROPOSAL, fold_widths: bool = True) -> DataFrame:
    """Columns of ``df`` that are missing, extra or of another type; no rows means no drift."""
    expected = schemas.sql_types(contract)
    actual = {f.name: schemas.sql_type(f.dataType, fold_widths) for f in df.schema.fields}
    return df.sparkSession.createDataFrame(_drift_rows(expected, actual), DRIFT)


def _drift_rows(expected: Mapping[str, str], actual: Mapping[str, str]) -> list[tuple]:
    rows = [(n, "missing", expected[n], None) for n in sorted(expected.keys() - actual.keys())]
    rows += [(n, "extra", None, actual[n]) for n in sorted(actual.keys() - expected.keys())]
    rows += [
        (n, "type", expected[n], actual[n])
        for n in sorted(expected.keys() & actual.keys())
        if expected[n] != actual[n]
    ]
    return rows


def contract_drift(declared: DataFrame, actual: DataFrame, on: Sequence[str] = ("column",)) -> DataFrame:
    """Same three findings between two ``(column, type)`` tables, types compared exactly.

    ``on`` may add a table name, to compare a whole catalog at once.
    """
    d = declared.select(*on, F.col("type").alias("expected"))
    a = actual.select(*on, F.col("type").alias("actual"))
    problem = (
        F.when(F.col("actual").isNull(), "missing")
        .when(F.col("expected").isNull(), "extra")
        .when(F.col("expected") != F.col("actual"), "type")
    )
    return d.join(a, list(on), "full").withColumn("problem", problem).where("problem is not null")


def guardrail_stability(outcomes: DataFrame, score: Column, cap: float = MAX_MEAN_SCORE) -> DataFrame:
    """Mean score strictly below the cap; an empty frame passes."""
    return outcomes.agg(
        F.coalesce(F.avg(score), F.lit(0.0)).alias("mean_score"), F.count(F.lit(1)).alias("n_rows")
    ).withColumn("passed", (F.col("n_rows") == 0) | (F.col("mean_score") < F.lit(cap)))


def budget(calls: DataFrame, tokens: Column, cap: int, warn: float = WARN_UTILISATION) -> DataFrame:
    """Utilisation strictly below the warning share; no cap passes."""
    total = calls.agg(F.coalesce(F.sum(tokens), F.lit(0)).cast("bigint").alias("total_tokens"))
    share = F.col("total_tokens") / F.lit(float(cap)) if cap > 0 else F.lit(0.0)
    return total.select(
        "total_tokens",
        F.lit(cap).cast("bigint").alias("cap"),
        share.alias("utilisation"),
        ((share < F.lit(warn)) | F.lit(cap <= 0)).alias("passed"),
    )


def views_hide_erased(views: Mapping[str, DataFrame]) -> DataFrame:
    """Erased rows that a consumer view still shows, per view."""
    counted = [
        df.agg(F.count_if(F.col("erased")).alias("n_exposed"))
        .select(F.lit(name).alias("view_name"), "n_exposed")
        .withColumn("passed", F.col("n_exposed") == 0)
        for name, df in views.items()
    ]
    return functools.reduce(DataFrame.unionByName, counted)


def not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULLs per column, all columns in one pass."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    entries: list[Column] = []
    for c in columns:
        entries += [F.lit(c), F.col(c)]
    return counted.select(F.explode(F.create_map(*entries)).alias("column", "n_null")).withColumn(
        "passed", F.col("n_null") == 0
    )


def unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Key values that occur more than once; NULL keys are not duplicates."""
    complete = df.dropna(how="any", subset=list(columns))
    return complete.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def freshness(
    df: DataFrame, ts: str, as_of: Column, by: Sequence[str] = (), warn: int = WARN_HOURS, fail: int = FAIL_HOURS
) -> DataFrame:
    """Hours since the last row, and pass, warn or fail."""
    last = df.groupBy(*by).agg(F.max(ts).alias("last_ts"))
    hours = F.timestamp_diff("MICROSECOND", F.col("last_ts"), as_of) / F.lit(3.6e9)
    return last.withColumn("age_hours", hours).withColumn(
        "status",
        F.when(F.col("last_ts").isNull() | (F.col("age_hours") > fail), "fail")
        .when(F.col("age_hours") > warn, "warn")
        .otherwise("pass"),
    )


def quarantine_latest(quarantine: DataFrame, landed: DataFrame, day: str = "day") -> DataFrame:
    """Quarantined rows of the latest day that landed anything; any row there fails."""
    latest = landed.agg(F.max(day).alias("latest_day"))
    per_day = quarantine.groupBy(F.col(day).alias("latest_day")).agg(F.count(F.lit(1)).alias("n"))
    return latest.join(per_day, "latest_day", "left").select(
        "latest_day",
        F.coalesce("n", F.lit(0)).alias("n_quarantined"),
        F.col("n").isNull().alias("passed"),
    )


def erasure_latency(
    requests: DataFrame, audit: DataFrame, as_of: Column, days: int = ERASURE_DAYS
) -> DataFrame:
    """Days from each request to its erasure, or to ``as_of`` while it is open."""
    keys = ["table_name", "where_column", "where_value"]
    done = audit.groupBy(*keys).agg(F.min("erased_at").alias("erased_at"))
    waited = F.datediff(
        F.coalesce(F.col("erased_at").cast("date"), as_of.cast("date")),
        F.col("requested_at").cast("date"),
    )
    return requests.join(done, keys, "left").withColumn("days", waited).withColumn(
        "within_window", F.col("days") <= days
    )
