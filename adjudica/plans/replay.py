"""Decision releases, and replay of judged rows under another release."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from adjudica.operators.decisions import AnyDecision, admitted, evaluate
from adjudica.operators.monoids import JOINT, Monoid


RELEASES = "decision_version string, position int, decision string, released_on string"


@dataclass(frozen=True)
class Release:
    """An immutable, named bundle of decisions with its admission predicate."""

    version: str
    released_on: str
    system: Sequence[AnyDecision]
    adm: Callable[[Column], Column]
    monoid: Monoid = JOINT


def releases_table(spark: SparkSession, releases: Sequence[Release]) -> DataFrame:
    """One row per decision of each release."""
    rows = [
        (r.version, i, d.name, r.released_on) for r in releases for i, d in enumerate(r.system)
    ]
    return spark.createDataFrame(rows, RELEASES).withColumn("released_on", F.col("released_on").cast("date"))


def apply_release(
    df: DataFrame, releases: Mapping[str, Release], version: str | Column
) -> DataFrame:
    """Judge rows under a release and stamp its version on them.

    ``version`` may be a column, when each row names the release in force for it; all releases
    must then share one monoid, and rows naming an unknown release are rejected with no payload.
    """
    stamped = df.withColumn(
        "decision_version", F.lit(version) if isinstance(version, str) else version
    )
    wanted = [version] if isinstance(version, str) else sorted(releases)
    payload = F.when(F.lit(False), evaluate(releases[wanted[0]].system, releases[wanted[0]].monoid))
    verdict = F.when(F.lit(False), F.lit(False))
    for v in wanted:
        mine = F.col("decision_version") == v
        payload = payload.when(mine, evaluate(releases[v].system, releases[v].monoid))
        release = releases[v]
        verdict = verdict.when(mine, admitted(release.adm, release.system, F.col("payload")))
    judged = stamped.withColumn("payload", payload)
    return judged.withColumn("admitted", F.coalesce(verdict, F.lit(False)))


def replay(df: DataFrame, old: Release, new: Release) -> DataFrame:
    """Both releases over each row in one pass: admission and score before and after."""
    both = df.withColumns(
        {"__old": evaluate(old.system, old.monoid), "__new": evaluate(new.system, new.monoid)}
    )
    return both.select(
        *df.columns,
        admitted(old.adm, old.system, F.col("__old")).alias("admitted_before"),
        admitted(new.adm, new.system, F.col("__new")).alias("admitted_after"),
        F.col("__old.score").alias("score_before"),
        F.col("__new.score").alias("score_after"),
    )


def replay_summary(replayed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    before, after = F.col("admitted_before"), F.col("admitted_after")
    return replayed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(before & ~after).alias("approved_to_rejected"),
        F.count_if(~before & after).alias("rejected_to_approved"),
        F.avg(F.col("score_after") - F.col("score_before")).alias("mean_score_shift"),
    )
