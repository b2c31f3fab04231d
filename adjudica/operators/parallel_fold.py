"""Folding one key's long history in parallel, for learners whose update is neither a sum nor affine.

The history is cut into chunks. If the state before every chunk were known, all chunks could be
folded at once. So all of these states are guessed and then corrected together: every chunk is
folded from its guess, and from guesses moved a little along each component, which gives the
chunk as an affine map near the guess. Chaining these small maps gives the next guesses (Newton's
method for the whole trajectory). Guesses that the folds reproduce are the states of the fold in
order. The number of rounds depends on how far the update is from affine, not on the length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, StructType

from adjudica.operators import ordered
from adjudica.operators.learners import CHUNK_ROWS, Learner, fit_in_order
from adjudica.sources.scratch import materialise

#: A guess is good when the folds reproduce it to this part of its size.
TOLERANCE = 1e-10
ROUNDS = 20
#: By this part of its size (or of 1) a component is moved to see what a chunk does with it.
STEP = 1e-6


class Flat:
    """A state as a list of numbers and back, by the type and lengths of an initial state."""

    def __init__(self, kind: DataType, example):
        self.kind, self.example = kind, example
        self.size = self._size(kind, example)

    def _size(self, kind: DataType, example) -> int:
        if isinstance(kind, DoubleType):
            return 1
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, DoubleType):
            return len(example)
        if isinstance(kind, StructType):
            return sum(self._size(f.dataType, example[f.name]) for f in kind.fields)
        raise TypeError(f"a state of {kind.simpleString()} has no derivative; fold it in order")

    def numbers(self, state: Column) -> Column:
        return self._numbers(state, self.kind)

    def _numbers(self, state: Column, kind: DataType) -> Column:
        if isinstance(kind, DoubleType):
            return F.array(state)
        if isinstance(kind, ArrayType):
            return state
        return F.concat(*[self._numbers(state[f.name], f.dataType) for f in kind.fields])

    def state(self, numbers: Column) -> Column:
        return self._state(numbers, self.kind, self.example, 0)[0]

    def _state(self, numbers: Column, kind: DataType, example, at: int) -> tuple[Column, int]:
        if isinstance(kind, DoubleType):
            return numbers[at], at + 1
        if isinstance(kind, ArrayType):
            return F.slice(numbers, at + 1, len(example)), at + len(example)
        parts = []
        for f in kind.fields:
            part, at = self._state(numbers, f.dataType, example[f.name], at)
            parts.append(part.alias(f.name))
        return F.struct(*parts), at


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The next guess before each chunk of one key, whose chunks' maps come in order.

    ``off`` tells how much the guess before a chunk and what the chunk before it reached differ.
    """
    state, reached = None, None
    for batch in batches:
        guesses, maps = batch.column("guess").to_pylist(), batch.column("moved").to_pylist()
        ends, steps = batch.column("reached").to_pylist(), batch.column("steps").to_pylist()
        out, off = [], []
        for guess, end, moved, step in zip(guesses, ends, maps, steps):
            guess, end = np.array(guess), np.array(end)
            if state is None:
                state = guess  # the first chunk starts from the initial state, which is no guess
            difference = 0.0 if reached is None else float(np.max(np.abs(reached - guess) / np.maximum(np.abs(guess), 1.0)))
            out.append(state.tolist())
            off.append(difference if np.isfinite(difference) else np.inf)
            slopes = (np.array(moved) - end) / np.array(step)[:, None]
            with np.errstate(all="ignore"):
                following = end + (state - guess) @ slopes
            # A step to nowhere is replaced by what was reached.
            state, reached = (following if np.all(np.isfinite(following)) else end), end
        yield pa.RecordBatch.from_arrays(
            [batch.column("__key"), batch.column("__chunk"), pa.array(out, pa.list_(pa.float64())), pa.array(off, pa.float64())],
            names=["__key", "__chunk", "guess", "off"],
        )


def fit_in_parallel(
    df: DataFrame,
    learner: Learner,
    order: Sequence[str],
    inputs: Column,
    target: Column,
    keys: Sequence[str] = ("learner_id",),
    chunk_rows: int = CHUNK_ROWS,
    tolerance: float = TOLERANCE,
    rounds: int = ROUNDS,
) -> DataFrame:
    """The states of :func:`learners.fit_in_order`, with all chunks of a key folded at once in each round.

    States are numbers, lists of numbers and structs of them. Keys of one chunk need one round. A
    task holds one chunk of rows; one key's chunks, a few numbers each, are chained in one task. Keys
    whose guesses have not settled after ``rounds`` rounds are folded in order. NULL keys are keys
    like others, and rows of equal place are taken in the order of their values.
    """
    spark = df.sparkSession
    first = spark.range(1).select(learner.initial().alias("s"))
    flat = Flat(first.schema["s"].dataType, first.first()["s"])
    narrow = df.select(*keys, *order, inputs.alias("__a"), target.alias("__b"))
    placed = ordered.running_sums(narrow, keys, order, {"__position": F.lit(1).cast("bigint")})
    chunks = (
        placed.groupBy(F.struct(*keys).alias("__key"), F.floor((F.col("__position") - 1) / chunk_rows).alias("__chunk"))
        .agg(F.array_sort(F.collect_list(F.struct(*order, "__a", "__b"))).alias("__rows"), F.count("*").alias("__n"))
    )
    chunks = materialise(chunks, "fold-chunks")

    def fold(numbers: Column) -> Column:
        end = F.aggregate("__rows", flat.state(numbers), lambda s, p: learner.update(s, p["__a"], p["__b"]))
        return flat.numbers(end)

    def moved(numbers: Column, j: int) -> Column:
        return F.transform(numbers, lambda x, i: F.when(i == j, x + F.get("steps", F.lit(j))).otherwise(x))

    initial = flat.numbers(learner.initial())
    totals = chunks.groupBy("__key").agg(F.max("__chunk").alias("__last"), F.sum("__n").alias("n"))
    short = totals.where("__last = 0").select("__key", "n")
    done = [chunks.join(short, "__key").select("__key", fold(initial).alias("numbers"), "n")]
    long = materialise(totals.where("__last > 0"), "fold-keys")
    guesses = chunks.join(long.select("__key"), "__key", "left_semi").select("__key", "__chunk", initial.alias("guess"))
    open_ = long
    for _ in range(rounds):
        if open_.isEmpty():
            break
        # Derivatives are taken by a step against each number's size.
        size = F.transform("guess", lambda x: F.greatest(F.abs(x), F.lit(1.0)) * STEP)
        started = chunks.join(guesses, ["__key", "__chunk"]).withColumn("steps", size)
        maps = started.select(
            "__key", "__chunk", "guess", fold(F.col("guess")).alias("reached"),
            F.array(*[fold(moved(F.col("guess"), j)) for j in range(flat.size)]).alias("moved"), "steps",
        )
        maps = materialise(maps, "fold-maps")
        # Chunks of a key in order, a few keys' at a time in a task; each key is chained by itself.
        key_type = chunks.schema["__key"].dataType.simpleString()
        chained = maps.groupBy("__key").applyInArrow(
            lambda table: pa.Table.from_batches(list(_chained(iter(table.sort_by("__chunk").combine_chunks().to_batches())))),
            f"__key {key_type}, __chunk bigint, guess array<double>, off double",
        )
        chained = materialise(chained, "fold-guesses")
        settled = chained.groupBy("__key").agg(F.max("off").alias("__off")).where(F.col("__off") <= tolerance)
        ended = open_.join(settled.select("__key"), "__key", "left_semi")
        ends = maps.join(ended.select("__key", F.col("__last").alias("__chunk"), "n"), ["__key", "__chunk"])
        done.append(materialise(ends.select("__key", F.col("reached").alias("numbers"), "n"), "fold-done"))
        open_ = materialise(open_.join(settled.select("__key"), "__key", "left_anti"), "fold-keys")
        guesses = chained.select("__key", "__chunk", "guess").join(open_.select("__key"), "__key", "left_semi")
    states = reduce(DataFrame.unionByName, done).select("__key", flat.state(F.col("numbers")).alias("state"), "n")
    out = states.select(*[F.col("__key")[k].alias(k) for k in keys], "state", "n")
    if open_.isEmpty():
        return out
    left = df.withColumn("__key", F.struct(*keys)).join(open_.select("__key"), "__key", "left_semi").drop("__key")
    return out.unionByName(fit_in_order(left, learner, order, inputs, target, keys))
