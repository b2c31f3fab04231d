"""Learners over observation logs: credibility, online linear regression, and their algebra.

Three ways to rebuild a state, by what the update allows:

* credibility adds up, so it is an ordinary partial aggregation;
* one linear-regression step is an affine map of the weights, and affine maps compose, so a long
  history is cut into chunks, each chunk becomes one map, and the maps are chained in order;
* any other learner is folded in order, in slices of bounded length whose states are handed on.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from adjudica.functions.common import let
from adjudica.operators import ordered
from adjudica.sources.scratch import materialise

CHUNK_ROWS = 4096
SLICE_ROWS = 50_000


# Credibility --------------------------------------------------------------------------------


def _posterior(mu0: Column, kappa0: Column, sigma2: Column, n: Column, total: Column):
    precision = kappa0 + n / sigma2
    return precision, (kappa0 * mu0 + total / sigma2) / precision


def credibility_state(observations: DataFrame) -> DataFrame:
    """Posterior per learner in closed form; one prior per learner is assumed."""
    grouped = observations.groupBy("learner_id").agg(
        F.any_value("mu0").alias("mu0"),
        F.any_value("kappa0").alias("kappa0"),
        F.any_value("sigma2").alias("sigma2"),
        F.count(F.lit(1)).alias("n"),
        F.sum("observation").alias("total"),
    )
    precision, mean = _posterior(*[F.col(c) for c in ("mu0", "kappa0", "sigma2", "n", "total")])
    return grouped.select(
        "learner_id",
        precision.alias("posterior_precision"),
        mean.alias("posterior_mean"),
        "n",
    )


def prior_conflicts(observations: DataFrame) -> DataFrame:
    """Learners whose rows carry more than one prior; their state is not defined."""
    prior = F.struct("mu0", "kappa0", "sigma2")
    return (
        observations.groupBy("learner_id")
        .agg(F.min(prior).alias("lowest"), F.max(prior).alias("highest"))
        .where(~F.col("lowest").eqNullSafe(F.col("highest")))
        .select("learner_id")
    )


def credibility_replay(observations: DataFrame, order: Sequence[str] = ("ts",)) -> DataFrame:
    """State after replaying a learner's log from the prior of its first row.

    Updating a normal posterior adds to its precision and to its precision-weighted mean, so the
    replay is a sum; no history is sorted or collected.
    """
    head = F.min_by(F.struct("mu0", "kappa0", "sigma2"), F.struct(*order))
    grouped = observations.groupBy("learner_id").agg(
        head.alias("prior"),
        F.count(F.lit(1)).alias("n"),
        F.sum("observation").alias("total"),
    )
    precision, mean = _posterior(
        F.col("prior.mu0"), F.col("prior.kappa0"), F.col("prior.sigma2"), F.col("n"), F.col("total")
    )
    return grouped.select(
        "learner_id", mean.alias("mean"), precision.alias("precision"), "n"
    )


def credibility_path(observations: DataFrame, order: Sequence[str] = ("ts",)) -> DataFrame:
    """State of each learner after every one of its observations."""
    summed = ordered.running_sums(
        observations,
        ["learner_id"],
        order,
        {"n": F.lit(1).cast("bigint"), "total": F.col("observation")},
    )
    precision, mean = _posterior(*[F.col(c) for c in ("mu0", "kappa0", "sigma2", "n", "total")])
    return summed.withColumns({"mean": mean, "precision": precision}).drop("total")


def credibility_as_of(
    observations: DataFrame,
    questions: DataFrame,
    question_id: str,
    default_prior: tuple[float, float, float] | None = None,
) -> DataFrame:
    """State of ``learner_id`` as it stood at each question's own ``ts`` (that instant included).

    Questions and observations are merged into one ordered log and summed together, so there is
    no range join. Before its first observation a learner answers with its prior; one that is
    never observed has ``default_prior`` as ``(mu0, kappa0, sigma2)``, or no state.
    """
    log = observations.select(
        "learner_id",
        "ts",
        F.lit(0).alias("after"),
        F.col("observation").alias("x"),
        F.lit(1).cast("bigint").alias("one"),
        F.lit(None).cast(questions.schema[question_id].dataType).alias(question_id),
    ).unionByName(
        questions.select(
            "learner_id",
            "ts",
            F.lit(1).alias("after"),
            F.lit(0.0).alias("x"),
            F.lit(0).cast("bigint").alias("one"),
            question_id,
        )
    )
    summed = ordered.running_sums(
        log,
        ["learner_id"],
        ["ts", "after", question_id, "x"],
        {"n": F.col("one"), "total": F.col("x")},
    ).where(F.col("after") == 1)
    names = ("mu0", "kappa0", "sigma2")
    # The prior a learner starts from is that of its first observation.
    head = F.min_by(F.struct(*names), F.struct("ts", *names)).alias("__prior")
    priors = observations.groupBy(F.struct("learner_id").alias("__key")).agg(head)
    known = (
        summed.withColumn("__key", F.struct("learner_id"))
        .join(priors, "__key", "left")
        .select(*summed.columns, "__prior.*")
    )
    filled = [
        F.coalesce(c, F.lit(float(v))) if default_prior else F.col(c)
        for c, v in zip(names, default_prior or names, strict=True)
    ]
    precision, mean = _posterior(*filled, F.col("n"), F.col("total"))
    return known.select(
        question_id, "learner_id", "ts", "n", mean.alias("mean"), precision.alias("precision")
    )


def state_as_of(observations: DataFrame, at: Column) -> DataFrame:
    """Credibility states rebuilt from observations up to and including one instant."""
    return credibility_state(observations.where(F.col("ts") <= at))


def credibility_factor(observations: DataFrame) -> DataFrame:
    """Weight Z of a learner's own mean, and the blend of that mean with the prior."""
    grouped = observations.groupBy("learner_id").agg(
        F.any_value("mu0").alias("mu0"),
        F.any_value("kappa0").alias("kappa0"),
        F.any_value("sigma2").alias("sigma2"),
        F.count(F.lit(1)).alias("n"),
        F.avg("observation").alias("own_mean"),
    )
    z = F.col("n") / (F.col("n") + F.col("kappa0") * F.col("sigma2"))
    return grouped.withColumn("z", z).select(
        "learner_id",
        "n",
        "own_mean",
        "z",
        (F.col("z") * F.col("own_mean") + (1 - F.col("z")) * F.col("mu0")).alias("mean"),
    )


def lookup(states: DataFrame, wanted: DataFrame) -> DataFrame:
    """States of the wanted learners."""
    return states.join(wanted.select("learner_id").distinct(), "learner_id", "left_semi")


def unknown(states: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted learners that have no state."""
    return wanted.select("learner_id").distinct().join(states, "learner_id", "left_anti")


def reconstruct(states: DataFrame, learner_id: str) -> tuple[float, float]:
    """Mean and precision of one learner; ``LookupError`` when there is none."""
    row = (
        states.where(F.col("learner_id") == learner_id)
        .select("posterior_mean", "posterior_precision")
        .first()
    )
    if row is None:
        raise LookupError(f"{learner_id!r} has never been observed")
    return row["posterior_mean"], row["posterior_precision"]


def append_observations(
    rows: DataFrame, log: DataFrame | None = None, dedup: bool = False, tie: Sequence[str] = ()
) -> DataFrame:
    """Log with ``rows`` added by column name; ``dedup`` keeps one row per learner and instant.

    The row that stays is the smallest by ``tie`` and then by all columns, so every run keeps the same.
    """
    merged = rows if log is None else log.unionByName(rows.select(*log.columns))
    if not dedup:
        return merged
    order = [*tie, *[c for c in merged.columns if c not in tie]]
    first = merged.groupBy("learner_id", "ts").agg(F.min(F.struct(*order)).alias("__first"))
    return first.select(*[F.col("__first")[c].alias(c) for c in merged.columns])


# Linear regression --------------------------------------------------------------------------


def dot(w: Column, x: Column) -> Column:
    return F.aggregate(F.zip_with(w, x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def sgd_step(w: Column, x: Column, y: Column, eta: float) -> Column:
    return let(
        F.lit(float(eta)) * (dot(w, x) - y),
        lambda g: F.zip_with(w, x, lambda a, b: a - g * b),
    )


def linear_predict(w: Column, x: Column) -> Column:
    return dot(w, x)


def linear_request(w: Column, x: Column, y: Column, eta: float) -> Column:
    """Input corrected towards the target."""
    return let(
        F.lit(float(eta)) * (dot(w, x) - y),
        lambda g: F.zip_with(x, w, lambda a, b: a - g * b),
    )


def _vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _identity_map(dim: int) -> Column:
    """An affine map of the weights, as its columns followed by its offset."""
    columns = [_vector([float(i == j) for i in range(dim)]) for j in range(dim)]
    return F.array(*columns, _vector([0.0] * dim))


def _linear_part(affine: Column, v: Column, dim: int, start: Column) -> Column:
    scaled = F.zip_with(
        F.slice(affine, 1, dim), v, lambda c, a: F.transform(c, lambda e: e * a)
    )
    return F.aggregate(scaled, start, lambda s, c: F.zip_with(s, c, lambda p, q: p + q))


def _apply(affine: Column, w: Column, dim: int) -> Column:
    return _linear_part(affine, w, dim, affine[dim])


def _chain(later: Column, earlier: Column, dim: int) -> Column:
    """The map that does ``earlier`` and then ``later``."""
    zero = _vector([0.0] * dim)
    return F.transform(
        earlier,
        lambda v, k: _linear_part(later, v, dim, F.when(k == dim, later[dim]).otherwise(zero)),
    )


def sgd_fit(
    points: DataFrame,
    order: Sequence[str],
    inputs: Sequence[str],
    target: str,
    eta: float,
    keys: Sequence[str] = ("learner_id",),
    epochs: int = 1,
    initial: Sequence[float] | None = None,
    segments: int | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Weights after online updates over each key's points, in order, ``epochs`` times.

    Arrays stay bounded however long one key's history is: points per chunk, chunks per segment,
    segments per key. Further epochs reuse the key's maps and never go back to the points.
    """
    dim = len(inputs)
    narrow = points.select(
        *keys,
        *order,
        F.array(*[F.col(c).cast("double") for c in inputs]).alias("__x"),
        F.col(target).cast("double").alias("__y"),
    )
    rows = ordered.split(narrow, keys, order, segments, "sgd")
    group = [*keys, ordered.SEGMENT]
    position = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    chunked = rows.withColumn("__chunk", F.floor((position - 1) / chunk_rows))

    def step(state: Column, p: Column) -> Column:
        # The offset column learns the target, the others only how weights are carried over.
        return F.transform(
            state,
            lambda v, k: sgd_step(v, p["__x"], F.when(k == dim, p["__y"]).otherwise(0.0), eta),
        )

    def chained(column: str, sort_key: str) -> Column:
        maps = F.array_sort(F.collect_list(F.struct(sort_key, column)))
        return F.aggregate(maps, _identity_map(dim), lambda s, m: _chain(m[column], s, dim))

    history = F.array_sort(F.collect_list(F.struct(*order, "__x", "__y")))
    per_chunk = chunked.groupBy(*group, "__chunk").agg(
        F.aggregate(history, _identity_map(dim), step).alias("__map"),
        F.count(F.lit(1)).alias("__n"),
    )
    per_segment = per_chunk.groupBy(*group).agg(
        chained("__map", "__chunk").alias("__map"), F.sum("__n").alias("__n")
    )
    per_key = per_segment.groupBy(*keys).agg(
        chained("__map", ordered.SEGMENT).alias("__map"), F.sum("__n").alias("n")
    )
    start = _vector(initial if initial is not None else [0.0] * dim)
    weights = F.aggregate(
        F.sequence(F.lit(1), F.lit(epochs)), start, lambda w, _: _apply(F.col("__map"), w, dim)
    )
    return per_key.select(*keys, weights.alias("w"), "n")


def linear_scores(points: DataFrame, weights: DataFrame, inputs: Sequence[str], target: str, eta: float) -> DataFrame:
    """Prediction and corrected input of every point under its learner's weights."""
    x = F.array(*[F.col(c).cast("double") for c in inputs])
    joined = points.join(weights.select("learner_id", "w"), "learner_id")
    return joined.select(
        *points.columns,
        linear_predict(F.col("w"), x).alias("prediction"),
        linear_request(F.col("w"), x, F.col(target), eta).alias("request"),
    )


# Learner algebra ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Learner:
    """Initial state, and how a state predicts, learns, and corrects its input."""

    initial: Callable[[], Column]
    implement: Callable[[Column, Column], Column]
    update: Callable[[Column, Column, Column], Column]
    request: Callable[[Column, Column, Column], Column]


def identity() -> Learner:
    return Learner(
        initial=lambda: F.lit(True),
        implement=lambda s, a: a,
        update=lambda s, a, b: s,
        request=lambda s, a, b: b,
    )


def credibility(mu0: float, kappa0: float, sigma2: float) -> Learner:
    gain = 1.0 / sigma2

    def update(s: Column, a: Column, b: Column) -> Column:
        precision = s["precision"] + F.lit(gain)
        mean = (s["precision"] * s["mean"] + F.lit(gain) * b) / precision
        return F.struct(mean.alias("mean"), precision.alias("precision"))

    return Learner(
        initial=lambda: F.struct(
            F.lit(float(mu0)).alias("mean"), F.lit(float(kappa0)).alias("precision")
        ),
        implement=lambda s, a: s["mean"],
        update=update,
        request=lambda s, a, b: a,
    )


def linear(eta: float, initial: Sequence[float]) -> Learner:
    return Learner(
        initial=lambda: _vector(initial),
        implement=dot,
        update=lambda w, x, y: sgd_step(w, x, y, eta),
        request=lambda w, x, y: linear_request(w, x, y, eta),
    )


def linear_scalar(eta: float, initial: float) -> Learner:
    """Linear learner of one number, for use after a learner that predicts one."""

    def moved(value: Column, w: Column, x: Column, y: Column, along: Column) -> Column:
        return value - F.lit(float(eta)) * (w * x - y) * along

    return Learner(
        initial=lambda: F.lit(float(initial)),
        implement=lambda w, x: w * x,
        update=lambda w, x, y: moved(w, w, x, y, x),
        request=lambda w, x, y: moved(x, w, x, y, w),
    )


def compose(g: Learner, f: Learner) -> Learner:
    """``f`` then ``g``. Both learn from the same old state; ``g`` tells ``f`` its target."""

    def through(s: Column, a: Column, c: Column, body: Callable[[Column, Column], Column]) -> Column:
        return let(
            f.implement(s["f"], a),
            lambda b: let(g.request(s["g"], b, c), lambda target: body(b, target)),
        )

    return Learner(
        initial=lambda: F.struct(f.initial().alias("f"), g.initial().alias("g")),
        implement=lambda s, a: g.implement(s["g"], f.implement(s["f"], a)),
        update=lambda s, a, c: through(
            s,
            a,
            c,
            lambda b, target: F.struct(
                f.update(s["f"], a, target).alias("f"), g.update(s["g"], b, c).alias("g")
            ),
        ),
        request=lambda s, a, c: through(s, a, c, lambda b, target: f.request(s["f"], a, target)),
    )


def parallel(f: Learner, g: Learner) -> Learner:
    """Both learners side by side; inputs and targets are structs with slots ``f`` and ``g``."""
    return Learner(
        initial=lambda: F.struct(f.initial().alias("f"), g.initial().alias("g")),
        implement=lambda s, a: F.struct(
            f.implement(s["f"], a["f"]).alias("f"), g.implement(s["g"], a["g"]).alias("g")
        ),
        update=lambda s, a, b: F.struct(
            f.update(s["f"], a["f"], b["f"]).alias("f"),
            g.update(s["g"], a["g"], b["g"]).alias("g"),
        ),
        request=lambda s, a, b: F.struct(
            f.request(s["f"], a["f"], b["f"]).alias("f"),
            g.request(s["g"], a["g"], b["g"]).alias("g"),
        ),
    )


def fit_in_order(
    df: DataFrame,
    learner: Learner,
    order: Sequence[str],
    inputs: Column,
    target: Column,
    keys: Sequence[str] = ("learner_id",),
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Fold any learner over each key's rows, in order.

    An update that is not a sum or an affine map has to see its rows one after another. Every key is
    folded in slices of at most ``slice_rows`` rows, of which a short history has one; a task holds
    one slice of a key, and only keys with rows left are handed on. NULL keys are keys like others.
    """
    narrow = df.select(*keys, *order, inputs.alias("__a"), target.alias("__b"))
    placed = ordered.running_sums(narrow, keys, order, {"__position": F.lit(1).cast("bigint")})
    sliced = materialise(
        placed.select(
            F.struct(*keys).alias("__key"),
            F.struct(*order, "__a", "__b").alias("__row"),
            F.floor((F.col("__position") - 1) / slice_rows).cast("int").alias("__slice"),
        ),
        "slices",
        partition_by=["__slice"],
    )
    slices = (sliced.agg(F.max("__slice")).first()[0] or 0) + 1

    def fold(start: Column, rows: Column) -> Column:
        return F.aggregate(rows, start, lambda s, p: learner.update(s, p["__a"], p["__b"]))

    states: list[DataFrame] = []
    for number in range(slices):
        rows = (
            sliced.where(F.col("__slice") == number)
            .groupBy("__key")
            .agg(F.array_sort(F.collect_list("__row")).alias("h"), F.count(F.lit(1)).alias("fresh"))
        )
        if states:
            # A struct of keys is never NULL, so plain equality also joins NULL keys.
            started = rows.join(states[-1], "__key")
            start, before = F.col("state"), F.col("n")
        else:
            started, start, before = rows, learner.initial(), F.lit(0)
        folded = started.select(
            "__key", fold(start, F.col("h")).alias("state"), (before + F.col("fresh")).alias("n")
        )
        states.append(materialise(folded, "state"))
    everything = reduce(DataFrame.unionByName, states)
    last = everything.groupBy("__key").agg(F.max_by(F.struct("state", "n"), "n").alias("__last"))
    return last.select(*[F.col("__key")[k].alias(k) for k in keys], "__last.state", "__last.n")


# Snapshots ----------------------------------------------------------------------------------


def snapshot(states: DataFrame, version: int | Column, ts: Column, columns: Sequence[str]) -> DataFrame:
    """Rows for the snapshot table: the state's columns as JSON."""
    number = F.lit(version) if isinstance(version, int) else version
    return states.select(
        "learner_id",
        number.cast("bigint").alias("version"),
        ts.cast("timestamp_ntz").alias("ts"),
        F.to_json(F.struct(*columns)).alias("state_json"),
    )


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """Newest version per learner, without sorting."""
    return (
        snapshots.groupBy("learner_id")
        .agg(F.max("version").alias("version"), F.max_by("state_json", "version").alias("state_json"))
    )


def restore(snapshots: DataFrame, state: str) -> DataFrame:
    """learner_id, version and the typed columns of each learner's newest state, to go on from.

    ``state`` names the columns with their types, as they were given to :func:`snapshot`.
    """
    newest = latest_snapshot(snapshots)
    parsed = F.from_json("state_json", state).alias("__state")
    return newest.select("learner_id", "version", parsed).select("learner_id", "version", "__state.*")


def latest_learner_state(snapshots: DataFrame, learner_id: str) -> tuple[int, str]:
    row = latest_snapshot(snapshots.where(F.col("learner_id") == learner_id)).first()
    if row is None:
        raise LookupError(f"{learner_id!r} has no stored state")
    return row["version"], row["state_json"]
