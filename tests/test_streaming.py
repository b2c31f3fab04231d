"""Streams over several files and several micro-batches give what the batch form gives."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from adjudica.operators import learners, regimes, versions
from adjudica.operators.decisions import adm_joint
from adjudica.plans import outcomes
from adjudica.sources import bindings
from adjudica.streaming import intake, state


def drop_files(df, folder, n):
    """The frame as ``n`` Parquet files."""
    df.repartition(n).write.parquet(folder)
    return df.schema


def test_outcomes_equal_the_batch(spark, sf_dir, tmp_path):
    df = bindings.proposals(spark, sf_dir)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = drop_files(df, folder, 4)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    system = regimes.proposal_joint(0.5, 0.6).decisions
    for _ in range(2):  # the second run finds nothing new and changes nothing
        intake.judge_stream(
            stream, out, str(tmp_path / "ck"), system, adm_joint(1.0), keep=["proposal_id"]
        ).awaitTermination()
    parted = versions.dispatch(df, keep=["proposal_id"])
    want = outcomes.judged(parted.valid[1].where("erased = false"), system, adm_joint(1.0))
    got = spark.read.parquet(f"{out}/outcomes")
    assert got.select("batch").distinct().count() == 4
    columns = ["proposal_id", "admitted", "payload_json"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert spark.read.parquet(f"{out}/quarantine").count() == parted.quarantined.count()


def test_states_equal_the_batch_and_repeats_count_once(spark, tmp_path):
    start = dt.datetime(2026, 1, 1)
    rows = [(f"u{i % 3}", start + dt.timedelta(minutes=i), float(i), 25.0, 50.0, 0.5) for i in range(60)]
    schema = "learner_id string, ts timestamp_ntz, observation double, sigma2 double, mu0 double, kappa0 double"
    once = spark.createDataFrame(rows, schema)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    drop_files(once.union(once.limit(10)), folder, 3)
    stream = spark.readStream.schema(once.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    # Files arrive in no order; a delay longer than the whole log keeps every row.
    states = state.running_credibility(stream, delay="1 day")
    state.write_states(states, out, str(tmp_path / "ck")).awaitTermination()
    got = {r["learner_id"]: r for r in state.current_states(spark.read.parquet(out)).collect()}
    for want in learners.credibility_state(once).collect():
        assert got[want["learner_id"]]["n"] == want["n"]
        assert got[want["learner_id"]]["posterior_mean"] == pytest.approx(want["posterior_mean"])


def test_states_without_delay_count_everything(spark, tmp_path):
    rows = [("a", dt.datetime(2026, 1, 1), 1.0, 25.0, 50.0, 0.5)] * 3
    df = spark.createDataFrame(rows, "learner_id string, ts timestamp_ntz, observation double, sigma2 double, mu0 double, kappa0 double")
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    drop_files(df, folder, 1)
    stream = spark.readStream.schema(df.schema).parquet(folder)
    state.write_states(state.running_credibility(stream), out, str(tmp_path / "ck")).awaitTermination()
    assert state.current_states(spark.read.parquet(out)).select(F.max("n")).first()[0] == 3
