"""Learners against plain Python folds, with one hot learner that spans many segments."""

import random

import pytest
from pyspark.sql import functions as F

from adjudica.operators import learners, ordered

ETA = 0.01


@pytest.fixture(scope="module")
def history():
    """A third of all rows belong to one learner."""
    rng = random.Random(7)
    rows = []
    for i in range(600):
        who = "hot" if i % 3 == 0 else f"u{rng.randrange(12)}"
        rows.append((who, i // 4, i, rng.random() * 3, rng.random() * 10))
    return rows


@pytest.fixture(scope="module")
def points(spark, history):
    df = spark.createDataFrame(history, "learner_id string, ts int, event_id int, x double, y double")
    return df.withColumn("one", F.lit(1.0)).repartition(5)


def per_learner(history):
    out = {}
    for row in sorted(history, key=lambda r: (r[1], r[2])):
        out.setdefault(row[0], []).append(row)
    return out


def sgd(rows, epochs=1):
    w = [0.0, 0.0]
    for _ in range(epochs):
        for _, _, _, x, y in rows:
            error = w[0] * x + w[1] - y
            w = [w[0] - ETA * error * x, w[1] - ETA * error]
    return w


@pytest.mark.parametrize("segments, chunk_rows, epochs", [(1, 4096, 1), (7, 3, 1), (7, 3, 4)])
def test_chunked_sgd_equals_the_fold(points, history, segments, chunk_rows, epochs):
    fit = learners.sgd_fit(
        points, ["ts", "event_id"], ["x", "one"], "y", ETA, epochs=epochs, segments=segments, chunk_rows=chunk_rows
    )
    got = {r["learner_id"]: r for r in fit.collect()}
    for who, rows in per_learner(history).items():
        assert got[who]["w"] == pytest.approx(sgd(rows, epochs), rel=1e-9)
        assert got[who]["n"] == len(rows)


def test_sgd_recovers_a_plane(spark):
    rows = [("a", 2 * i + j, x, y) for i in range(500) for j, (x, y) in enumerate([(1.0, 3.0), (2.0, 5.0)])]
    df = spark.createDataFrame(rows, "learner_id string, ts int, x double, y double").withColumn("one", F.lit(1.0))
    w = learners.sgd_fit(df, ["ts"], ["x", "one"], "y", ETA).first()["w"]
    assert w[0] * 3 + w[1] == pytest.approx(7.0, abs=0.1)


@pytest.mark.parametrize("slice_rows", [1000, 20])
def test_sliced_fold_equals_the_fold(points, history, slice_rows):
    """Composed learners have no shortcut; with short slices the hot learner takes ten rounds."""
    both = learners.compose(learners.linear_scalar(ETA, 0.5), learners.linear(ETA, [0.1, 0.2]))
    out = learners.fit_in_order(
        points, both, ["ts", "event_id"], F.array("x", "one"), F.col("y"), slice_rows=slice_rows
    )
    got = {r["learner_id"]: r for r in out.collect()}
    for who, rows in per_learner(history).items():
        a, b, g = 0.1, 0.2, 0.5
        for _, _, _, x, y in rows:
            mid = a * x + b
            target = mid - ETA * (g * mid - y) * g
            a, b, g = (
                a - ETA * (mid - target) * x,
                b - ETA * (mid - target),
                g - ETA * (g * mid - y) * mid,
            )
        state = got[who]["state"]
        assert [*state["f"], state["g"]] == pytest.approx([a, b, g], rel=1e-9)
        assert got[who]["n"] == len(rows)


def test_running_sums_and_previous_cross_segments(points, history):
    sums = ordered.running_sums(points, ["learner_id"], ["ts", "event_id"], {"total": F.col("y")}, segments=9)
    lagged = ordered.previous(points, ["learner_id"], ["ts", "event_id"], {"before": "y"}, segments=9)
    got = {r["event_id"]: r["total"] for r in sums.collect()}
    back = {r["event_id"]: r["before"] for r in lagged.collect()}
    for rows in per_learner(history).values():
        total, last = 0.0, None
        for _, _, event, _, y in rows:
            total += y
            assert got[event] == pytest.approx(total)
            assert back[event] == last
            last = y


def test_rows_without_a_key_are_kept(spark):
    df = spark.createDataFrame([(None, 1, 2.0), (None, 2, 3.0), ("a", 1, 5.0)], "k string, ts int, v double")
    sums = ordered.running_sums(df, ["k"], ["ts"], {"total": F.col("v")}, segments=3)
    assert sorted((r["k"] or "", r["total"]) for r in sums.collect()) == [("", 2.0), ("", 5.0), ("a", 5.0)]


def test_segment_window_and_join_share_a_shuffle(points):
    # No broadcast, as with tables too large for one.
    points.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        sums = ordered.running_sums(points, ["learner_id"], ["ts", "event_id"], {"total": F.col("y")})
        plan = sums._jdf.queryExecution().executedPlan().toString()
    finally:
        points.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The rows move once; the other three move one small row per segment and key.
    assert plan.count("Exchange hashpartitioning(__key") == 4


def test_hot_learner_is_split(points):
    rows = ordered.split(points, ["learner_id"], ["ts", "event_id"], segments=9)
    spread = rows.where("learner_id = 'hot'").select(ordered.SEGMENT).distinct().count()
    assert spread >= 3


OBSERVED = [105.0, 95.0, 110.0, 100.0, 102.0]


@pytest.fixture(scope="module")
def observations(spark):
    rows = [("a", i, x, 25.0, 100.0, 0.5) for i, x in enumerate(OBSERVED)]
    rows += [("b", 0, 110.0, 25.0, 100.0, 0.01)]
    return spark.createDataFrame(
        rows, "learner_id string, ts int, observation double, sigma2 double, mu0 double, kappa0 double"
    )


def test_closed_form_equals_replay_and_fold(observations):
    state = {r["learner_id"]: r for r in learners.credibility_state(observations).collect()}
    replayed = {r["learner_id"]: r for r in learners.credibility_replay(observations).collect()}
    fold = learners.fit_in_order(
        observations.where("learner_id = 'a'"),
        learners.credibility(100.0, 0.5, 25.0),
        ["ts"],
        F.lit(0),
        F.col("observation"),
    ).first()["state"]
    assert state["a"]["posterior_mean"] == pytest.approx(replayed["a"]["mean"], rel=1e-9)
    assert state["a"]["posterior_mean"] == pytest.approx(fold["mean"], rel=1e-9)
    assert state["a"]["posterior_precision"] == pytest.approx(fold["precision"], rel=1e-9)
    # One observation, worked by hand.
    assert state["b"]["posterior_mean"] == pytest.approx(108.0)
    assert state["b"]["posterior_precision"] == pytest.approx(0.05)


def test_factor_form_gives_the_same_mean(observations):
    factor = {r["learner_id"]: r for r in learners.credibility_factor(observations).collect()}
    state = {r["learner_id"]: r for r in learners.credibility_state(observations).collect()}
    for who in ("a", "b"):
        assert factor[who]["mean"] == pytest.approx(state[who]["posterior_mean"])


def test_path_ends_at_the_state(observations):
    last = learners.credibility_path(observations).where("learner_id = 'a' and n = 5").first()
    state = learners.credibility_state(observations).where("learner_id = 'a'").first()
    assert last["mean"] == pytest.approx(state["posterior_mean"])


def test_as_of_uses_each_learners_own_prior(spark, observations):
    rows = [("q1", "a", 2), ("q2", "nobody", 9), ("q3", "b", -1), ("q4", "b", 0)]
    questions = spark.createDataFrame(rows, "question string, learner_id string, ts int")
    own = observations.withColumn("mu0", F.when(F.col("learner_id") == "b", 70.0).otherwise(F.col("mu0")))
    out = learners.credibility_as_of(own, questions, "question", (40.0, 0.5, 25.0))
    got = {r["question"]: (r["n"], r["mean"]) for r in out.collect()}
    assert got["q1"] == (3, pytest.approx((0.5 * 100 + 310 / 25) / (0.5 + 3 / 25)))
    assert got["q2"] == (0, 40.0)
    assert got["q3"] == (0, 70.0)
    assert got["q4"] == (1, pytest.approx((0.01 * 70 + 110 / 25) / (0.01 + 1 / 25)))
    without = learners.credibility_as_of(own, questions, "question")
    assert without.where("question = 'q2'").first()["mean"] is None


def test_lookup_errors(observations):
    states = learners.credibility_state(observations)
    assert learners.reconstruct(states, "b")[0] == pytest.approx(108.0)
    with pytest.raises(LookupError):
        learners.reconstruct(states, "nobody")


def test_mixed_priors_are_reported(observations):
    mixed = observations.withColumn("mu0", F.when(F.col("ts") == 0, 1.0).otherwise(F.col("mu0")))
    assert [r[0] for r in learners.prior_conflicts(mixed).collect()] == ["a"]
    assert learners.prior_conflicts(observations).count() == 0


def test_append_keeps_or_drops_repeats(observations):
    assert learners.append_observations(observations, observations).count() == 12
    assert learners.append_observations(observations, observations, dedup=True).count() == 6


def test_identity_laws(spark):
    """Composing with the identity on either side changes no prediction, update or request."""
    f = learners.linear(ETA, [0.3, -0.2])
    left = learners.compose(learners.identity(), f)
    right = learners.compose(f, learners.identity())
    a, y = F.array(F.lit(1.5), F.lit(2.0)), F.lit(0.7)
    row = spark.range(1).select(
        f.implement(f.initial(), a).alias("p"),
        left.implement(left.initial(), a).alias("lp"),
        right.implement(right.initial(), a).alias("rp"),
        f.update(f.initial(), a, y).alias("u"),
        left.update(left.initial(), a, y)["f"].alias("lu"),
        right.update(right.initial(), a, y)["g"].alias("ru"),
        f.request(f.initial(), a, y).alias("r"),
        left.request(left.initial(), a, y).alias("lr"),
        right.request(right.initial(), a, y).alias("rr"),
    ).first()
    assert row["p"] == row["lp"] == row["rp"]
    assert row["u"] == row["lu"] == row["ru"]
    assert row["r"] == row["lr"] == row["rr"]


def test_composition_is_associative(spark):
    f, g, h = learners.linear(ETA, [0.3, -0.2]), learners.linear_scalar(ETA, 0.4), learners.linear_scalar(ETA, -0.6)
    one = learners.compose(h, learners.compose(g, f))
    two = learners.compose(learners.compose(h, g), f)
    a, y = F.array(F.lit(1.5), F.lit(2.0)), F.lit(0.7)
    u, v = one.update(one.initial(), a, y), two.update(two.initial(), a, y)
    row = spark.range(1).select(
        one.implement(one.initial(), a).alias("p1"),
        two.implement(two.initial(), a).alias("p2"),
        u["f"]["f"].alias("f1"), u["f"]["g"].alias("g1"), u["g"].alias("h1"),
        v["f"].alias("f2"), v["g"]["f"].alias("g2"), v["g"]["g"].alias("h2"),
        one.request(one.initial(), a, y).alias("r1"),
        two.request(two.initial(), a, y).alias("r2"),
    ).first()
    assert row["p1"] == pytest.approx(row["p2"])
    assert row["f1"] == pytest.approx(row["f2"])
    assert (row["g1"], row["h1"]) == pytest.approx((row["g2"], row["h2"]))
    assert row["r1"] == pytest.approx(row["r2"])


def test_snapshots(spark):
    states = spark.createDataFrame([("a", 1.5), ("b", 2.5)], "learner_id string, mean double")
    at = F.lit("2026-01-01 00:00:00")
    log = learners.snapshot(states, 1, at, ["mean"]).unionByName(
        learners.snapshot(states.withColumn("mean", F.lit(9.0)).where("learner_id = 'a'"), 2, at, ["mean"])
    )
    got = {r["learner_id"]: (r["version"], r["state_json"]) for r in learners.latest_snapshot(log).collect()}
    assert got == {"a": (2, '{"mean":9.0}'), "b": (1, '{"mean":2.5}')}
    assert learners.latest_learner_state(log, "b") == (1, '{"mean":2.5}')
    with pytest.raises(LookupError):
        learners.latest_learner_state(log, "c")
