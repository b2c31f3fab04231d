"""Streams that need state of their own: repeats counted once, and learners that depend on order.

Both keep their state in the engine's store and lose no row for being late: there is no watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Order of rows without a time: before all others, as in the batch form.
UNTIMED = -(2**63)


# With processing time the engine always sees a reason for one more micro-batch without rows, and a
# drained run would not end. Timers and time-to-live are then looked at in micro-batches with rows.
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """A query takes its settings from the session when it starts."""
    wanted = {PROVIDER: ROCKSDB, NO_DATA: "false"}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def _start(out: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    with _settings(out.sparkSession):
        return (
            out.writeStream.outputMode("update")
            .foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


def micros(ts: Column) -> Column:
    """A zoneless time as microseconds, whatever the session's zone."""
    days = F.date_diff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    minutes = (days * 24 + F.hour(ts)) * 60 + F.minute(ts)
    seconds = F.extract(F.lit("SECOND"), ts).cast("decimal(18,6)")
    return F.coalesce(minutes * 60_000_000 + (seconds * 1_000_000).cast("bigint"), F.lit(UNTIMED))


# Repeats counted once -----------------------------------------------------------------------


NUMBERS = ("observation", "sigma2", "mu0", "kappa0")


def _first_seen(rows: DataFrame) -> DataFrame:
    """Rows whose (learner_id, at) came in no earlier micro-batch, by an aggregation with state.

    ``current_timestamp`` is one instant for a whole micro-batch, and the same when it is run again.
    """
    now = F.current_timestamp()
    # NaN counts as NULL, and a NULL observation is larger than any other.
    numbers = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in NUMBERS]
    dated = rows.select("learner_id", "at", now.alias("came"), *numbers)
    row = F.struct("came", F.col("observation").isNull().alias("none"), *NUMBERS)
    seen = dated.groupBy("learner_id", "at").agg(F.min(row).alias("first"), F.max("came").alias("last"))
    # Both ends are asked for, so that a clock set back between micro-batches makes no row fresh again.
    fresh = seen.where((F.col("first.came") == now) & (F.col("last") == now))
    return fresh.select("learner_id", *[f"first.{c}" for c in NUMBERS])


class _Unseen(StatefulProcessor):
    """Rows whose time was not seen before in their bucket, or so long ago that it is forgotten."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "at array<bigint>", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True)
        # Of several rows of one time in a batch the smallest observation counts, whatever their order.
        frame = frame.sort_values(["at", "observation"]).drop_duplicates("at")
        held = self.seen.get() if self.seen.exists() else None
        known = np.array(held[0] if held else [], dtype="int64")
        fresh = frame[~frame["at"].isin(known)]
        if len(fresh):
            self.seen.update(([int(v) for v in np.union1d(known, fresh["at"])],))
            yield fresh[["learner_id", *NUMBERS]]

    def close(self) -> None:
        pass


def distinct_observations(stream: DataFrame, bucket_seconds: int = 3600, ttl_ms: int | None = None) -> DataFrame:
    """Observations with repeats of (learner_id, ts) taken once, however late the repeat or the row.

    Of rows of one (learner_id, ts) in a micro-batch the smallest observation counts. NULL times are
    one time. Without ``ttl_ms`` times are kept for good, so the store grows with the distinct times:
    state is one row for each, and a hot learner spreads over tasks. With it, state is the list of
    times seen per learner and bucket of ``bucket_seconds``, which is forgotten that long after its
    last change: a repeat after it counts again. Then a bucket's rows of one micro-batch and its
    times must fit one task, and each bucket with rows costs a call of Python.
    """
    rows = stream.select(
        "learner_id", micros(F.col("ts")).alias("at"), *[F.col(c).cast("double").alias(c) for c in NUMBERS]
    )
    if ttl_ms is None:
        return _first_seen(rows)
    bucket = F.floor(F.col("at") / (bucket_seconds * 1_000_000))
    return rows.withColumn("bucket", bucket).groupBy("learner_id", "bucket").transformWithStateInPandas(
        _Unseen(ttl_ms),
        "learner_id string, observation double, sigma2 double, mu0 double, kappa0 double",
        outputMode="Update",
        timeMode="ProcessingTime",
    )


def write_sums(observations: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Sums per learner of each micro-batch. Sums add up, so a batch written again after a crash
    replaces itself and no state but the seen times is kept."""

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy("learner_id").agg(
            *[F.min(c).alias(c) for c in ("mu0", "kappa0", "sigma2")],
            F.count(F.lit(1)).alias("n"),
            F.sum("observation").alias("total"),
        ).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return _start(observations, write, checkpoint)


def credibility_of_sums(sums: DataFrame) -> DataFrame:
    """Posterior per learner out of the micro-batches' sums."""
    whole = sums.groupBy("learner_id").agg(
        *[F.min(c).alias(c) for c in ("mu0", "kappa0", "sigma2")], F.sum("n").alias("n"), F.sum("total").alias("total")
    )
    precision = F.col("kappa0") + F.col("n") / F.col("sigma2")
    mean = (F.col("kappa0") * F.col("mu0") + F.coalesce("total", F.lit(0.0)) / F.col("sigma2")) / precision
    return whole.select("learner_id", precision.alias("posterior_precision"), mean.alias("posterior_mean"), "n")


# Learners that depend on order ---------------------------------------------------------------

Vector = list[float]


@dataclass(frozen=True)
class RowLearner:
    """A learner over numbers, asked row by row inside a task. States and inputs are lists."""

    initial: Vector
    implement: Callable[[Vector, Vector], float]
    update: Callable[[Vector, Vector, float], Vector]
    request: Callable[[Vector, Vector, float], Vector]


def linear(eta: float, initial: Sequence[float]) -> RowLearner:
    """Linear model under gradient steps; asks for the inputs that would have fit better."""

    def predicted(w: Vector, x: Vector) -> float:
        return sum(a * b for a, b in zip(w, x, strict=True))

    def moved(value: Vector, along: Vector, w: Vector, x: Vector, y: float) -> Vector:
        step = eta * (predicted(w, x) - y)
        return [v - step * a for v, a in zip(value, along, strict=True)]

    return RowLearner(
        initial=[float(v) for v in initial],
        implement=predicted,
        update=lambda w, x, y: moved(w, x, w, x, y),
        request=lambda w, x, y: moved(x, w, w, x, y),
    )


def compose(g: RowLearner, f: RowLearner) -> RowLearner:
    """``f`` then ``g``, which takes one number. The state is that of ``f`` followed by that of ``g``."""
    cut = len(f.initial)

    def target(s: Vector, a: Vector, c: float) -> tuple[Vector, float]:
        between = [f.implement(s[:cut], a)]
        return between, g.request(s[cut:], between, c)[0]

    def update(s: Vector, a: Vector, c: float) -> Vector:
        between, wanted = target(s, a, c)
        return f.update(s[:cut], a, wanted) + g.update(s[cut:], between, c)

    return RowLearner(
        initial=f.initial + g.initial,
        implement=lambda s, a: g.implement(s[cut:], [f.implement(s[:cut], a)]),
        update=update,
        request=lambda s, a, c: f.request(s[:cut], a, target(s, a, c)[1]),
    )


STATE, LATE = "state", "late"

_OUT = "learner_id string, kind string, state array<double>, n bigint, at bigint, tie bigint, inputs array<double>, target double"


class _InOrder(StatefulProcessor):
    """Rows younger than the key's horizon wait; the others are folded for good, in order."""

    def __init__(self, learner: RowLearner, delay: int, idle_ms: int | None):
        self.learner, self.delay, self.idle_ms = learner, delay, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.folded = handle.getValueState("folded", "state array<double>, n bigint, horizon bigint")
        self.waiting = handle.getListState("waiting", "at bigint, tie bigint, inputs array<double>, target double")

    def _held(self) -> tuple[Vector, int, int]:
        if not self.folded.exists():
            return list(self.learner.initial), 0, UNTIMED
        state, n, horizon = self.folded.get()
        return [float(v) for v in state], int(n), int(horizon)

    def _fold(self, state: Vector, rows: Sequence[tuple]) -> Vector:
        for _, _, inputs, target in rows:
            state = self.learner.update(state, inputs, target)
        return state

    def _keep(self, state: Vector, n: int, horizon: int, rows: Sequence[tuple]) -> None:
        self.folded.update((state, n, horizon))
        if rows:
            self.waiting.put(list(rows))
        else:
            self.waiting.clear()

    def _rows(self, rows) -> list[tuple]:
        return [(int(at), int(tie), [float(v) for v in x], float(y)) for at, tie, x, y in rows]

    def _result(self, key: Any, state: Vector, n: int, late: Sequence[tuple] = ()) -> pd.DataFrame:
        out = [(key[0], STATE, state, n, None, None, None, None)]
        out += [(key[0], LATE, None, None, *row) for row in late]
        names = [part.split()[0] for part in _OUT.split(", ")]
        frame = pd.DataFrame(out, columns=names)
        return frame.astype({"n": "Int64", "at": "Int64", "tie": "Int64", "target": "Float64"})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state, n, horizon = self._held()
        came = self._rows(
            row for frame in rows for row in frame[["at", "tie", "inputs", "target"]].itertuples(index=False)
        )
        late = [row for row in came if row[0] < horizon]
        # Place in the order names a row, so a repeat of a waiting row changes nothing.
        placed = {row[:2]: row for row in self._rows(self.waiting.get())}
        for row in sorted(came):
            if row[0] >= horizon:
                placed.setdefault(row[:2], row)
        ordered = [placed[place] for place in sorted(placed)]
        if ordered:
            # Rows without a time sit at the lower end of the range, where nothing can be taken off.
            horizon = max(horizon, max(ordered[-1][0] - self.delay, UNTIMED))
        done = [row for row in ordered if row[0] < horizon]
        rest = ordered[len(done) :]
        state, n = self._fold(state, done), n + len(done)
        self._keep(state, n, horizon, rest)
        if self.idle_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._result(key, self._fold(state, rest), n + len(rest), late)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        state, n, horizon = self._held()
        rest = sorted(self._rows(self.waiting.get()))
        if rest:
            state, n, horizon = self._fold(state, rest), n + len(rest), rest[-1][0] + 1
        self._keep(state, n, horizon, [])
        yield self._result(key, state, n)

    def close(self) -> None:
        pass


def running_learner(
    stream: DataFrame,
    learner: RowLearner,
    at: Column,
    tie: Column,
    inputs: Column,
    target: Column,
    delay_seconds: int,
    idle_ms: int | None = None,
) -> DataFrame:
    """State of each learner after every micro-batch it has rows in, as if they had come in order.

    ``at`` (a time) and ``tie`` (an integer) give the order; the pair names a row, so repeats of rows
    that wait count once. Rows wait until their key has seen one ``delay_seconds`` younger, then they
    are folded for good. The state given out has the waiting rows folded in as well. A row older than
    what is folded for good cannot be put in its place: it comes out with ``kind`` late, for a later
    batch fit, and changes no state. After ``idle_ms`` without rows a key folds all,
    in the next micro-batch with any rows.
    Rows with a NULL in inputs or target belong in quarantine before. A key's waiting rows and its rows
    of one micro-batch must fit one task (``maxFilesPerTrigger`` bounds them).
    """
    rows = stream.select(
        "learner_id",
        micros(at).alias("at"),
        tie.cast("bigint").alias("tie"),
        inputs.cast("array<double>").alias("inputs"),
        target.cast("double").alias("target"),
    )
    return rows.groupBy("learner_id").transformWithStateInPandas(
        _InOrder(learner, delay_seconds * 1_000_000, idle_ms),
        _OUT,
        outputMode="Update",
        timeMode="None" if idle_ms is None else "ProcessingTime",
    )


def write_learner(results: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch's results, states and late rows apart (``kind=state``, ``kind=late``)."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("kind").parquet(f"{out}/batch={number}")

    return _start(results, write, checkpoint)


RESULT = f"{_OUT}, batch bigint"


def newest_learners(log: DataFrame) -> DataFrame:
    """Newest state per learner."""
    return (
        log.where(F.col("kind") == STATE)
        .groupBy("learner_id")
        .agg(F.max_by(F.struct("state", "n"), "batch").alias("s"))
        .select("learner_id", "s.*")
    )


def late_rows(log: DataFrame) -> DataFrame:
    """Rows that came after their place was folded."""
    return log.where(F.col("kind") == LATE).select("learner_id", "at", "tie", "inputs", "target")
