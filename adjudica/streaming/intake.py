"""Versioned rows as a stream: each micro-batch is dispatched, judged and appended.

Every step before the sinks is row-wise, so the batch functions are used as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from adjudica.operators import versions
from adjudica.operators.decisions import AnyDecision
from adjudica.operators.monoids import JOINT, Monoid
from adjudica.operators.views import visible
from adjudica.plans import outcomes


def judge_stream(
    stream: DataFrame,
    out: str,
    checkpoint: str,
    system: Sequence[AnyDecision],
    adm: Callable[[Column], Column],
    monoid: Monoid = JOINT,
    known: Sequence[versions.Version] = (versions.FIRST,),
    keep: Sequence[str] = (),
) -> StreamingQuery:
    """Start a query that drains what is there and stops.

    A micro-batch writes into folders named by its number and overwrites them when it is run
    again after a failure, so no row is ever written twice.
    """
    def write(batch: DataFrame, number: int) -> None:
        # Two sinks read the batch; without this the source would be read for each.
        rows = batch.persist()
        try:
            sinks(rows, number)
        finally:
            rows.unpersist()

    def sinks(rows: DataFrame, number: int) -> None:
        # Dispatch comes first, so that every row reaches one side, as in a batch.
        parted = versions.dispatch(rows, known, keep=keep)
        hides = "erased" in parted.merged.columns
        shown = parted.merged.where(visible()) if hides else parted.merged
        parted.quarantined.select(
            *keep,
            "schema_version_seen",
            "reason",
            "detail",
            F.to_json("raw_row", {"ignoreNullFields": "false"}).alias("raw_payload"),
        ).write.mode("overwrite").parquet(f"{out}/quarantine/batch={number}")
        judged = outcomes.judged(shown, system, adm, monoid)
        judged.write.mode("overwrite").parquet(f"{out}/outcomes/batch={number}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
