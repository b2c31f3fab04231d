"""Credibility state as a running aggregation over an observation stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def running_credibility(stream: DataFrame, delay: str | None = None) -> DataFrame:
    """Posterior per learner, updated by every micro-batch.

    By default every observation counts, however late it comes, so the state is the batch one. With
    ``delay``, repeats of (learner_id, ts) within that watermark count once, and observations that
    come later than the watermark are left out: bounded state for lost late rows. Only counts and
    sums are kept as state, so a hot learner costs as much as any other.
    """
    rows = stream
    if delay is not None:
        # Watermarks need an instant. Zoneless times are read in the session's zone for that, but
        # compared as they are: two of them may be one instant where clocks go back.
        rows = rows.withColumn("__instant", F.col("ts").cast("timestamp"))
        rows = rows.withWatermark("__instant", delay)
        rows = rows.dropDuplicatesWithinWatermark(["learner_id", "ts"])
    grouped = rows.groupBy("learner_id").agg(
        F.first("mu0").alias("mu0"),
        F.first("kappa0").alias("kappa0"),
        F.first("sigma2").alias("sigma2"),
        F.count(F.lit(1)).alias("n"),
        F.sum("observation").alias("total"),
    )
    precision = F.col("kappa0") + F.col("n") / F.col("sigma2")
    mean = (F.col("kappa0") * F.col("mu0") + F.col("total") / F.col("sigma2")) / precision
    return grouped.select(
        "learner_id",
        precision.alias("posterior_precision"),
        mean.alias("posterior_mean"),
        "n",
    )


def write_states(states: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch's changed states; the newest batch of a learner is its state."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        states.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_states(log: DataFrame) -> DataFrame:
    """Newest state per learner out of the appended ones."""
    state = F.struct("posterior_precision", "posterior_mean", "n")
    return (
        log.groupBy("learner_id")
        .agg(F.max_by(state, "batch").alias("state"))
        .select("learner_id", "state.*")
    )
