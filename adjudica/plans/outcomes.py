"""Validated rows to contracts and rejections, and the counts of a run."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from adjudica.operators.decisions import (
    AnyDecision,
    fired_names,
    payload_json,
    plain_rules,
    validate,
)
from adjudica.operators.monoids import JOINT, Monoid
from adjudica.operators.views import visible


class Outcomes(NamedTuple):
    contracts: DataFrame
    rejections: DataFrame


def judged(
    df: DataFrame,
    system: Sequence[AnyDecision],
    adm: Callable[[Column], Column],
    monoid: Monoid = JOINT,
    release: str | None = None,
) -> DataFrame:
    """Rows with typed payload, its JSON form, ``admitted`` and, if given, the release that judged
    them. Tombstoned rows never get here: they are filtered first.

    Names of the fired rules are kept in a column of their own: reports read it instead of the
    whole violations, and over unsaved rows the messages are then never built.
    """
    rows = df.where(visible()) if "erased" in df.columns else df
    out = validate(rows, system, monoid, adm)
    rules = plain_rules(system)
    if rules:
        out = out.withColumn("rules", fired_names(rules))
    out = out.withColumn("payload_json", payload_json(F.col("payload"), monoid))
    return out if release is None else out.withColumn("decision_version", F.lit(release))


def split_outcomes(judged_rows: DataFrame) -> Outcomes:
    """Two filters over one frame; nothing is computed until one side is used."""
    admitted = F.col("admitted")
    return Outcomes(
        judged_rows.where(admitted).drop("admitted"),
        judged_rows.where(~admitted).drop("admitted"),
    )


def write_outcomes(judged_rows: DataFrame, path: str) -> Outcomes:
    """Write both sides in one pass, partitioned by ``admitted``; read back by partition.

    The rules run once per row, and reading one side never touches the other side's files.
    """
    judged_rows.write.mode("overwrite").partitionBy("admitted").parquet(path)
    spark = judged_rows.sparkSession
    return split_outcomes(spark.read.schema(judged_rows.schema).parquet(path))


def run_summary(judged_rows: DataFrame) -> DataFrame:
    return judged_rows.agg(
        F.count_if("admitted").alias("contracts"), F.count_if(~F.col("admitted")).alias("rejections")
    )

