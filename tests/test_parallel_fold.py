"""Chunks of one key folded at once, against the fold in order."""

import pytest
from pyspark.sql import functions as F

from adjudica.operators import learners, parallel_fold


def composed():
    return learners.compose(learners.linear_scalar(0.01, 0.5), learners.linear(0.01, [0.1, 0.2]))


def points(spark, length):
    """A key that holds a third of all rows, many short ones, and rows without a key."""
    rows = spark.range(3 * length).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 > 1, F.concat(F.lit("k"), F.col("id") % 40)).alias("learner_id"),
        F.col("id").alias("ts"),
        F.array(F.sin("id"), F.cos(F.col("id") * 3)).alias("x"),
        (F.sin("id") * 2 - F.cos(F.col("id") * 3) + F.sin(F.col("id") * 7) / 5).alias("y"),
    )
    return rows.repartition(5)


@pytest.mark.parametrize("length", [300, 3000])
def test_equals_the_fold_in_order(spark, monkeypatch, length):
    df = points(spark, length)
    args = (composed(), ["ts"], F.col("x"), F.col("y"))
    want = {r["learner_id"]: r for r in learners.fit_in_order(df, *args).collect()}
    # As many rounds for ten times the length, and no help from the fold in order.
    monkeypatch.setattr(parallel_fold, "fit_in_order", None)
    got = {r["learner_id"]: r for r in parallel_fold.fit_in_parallel(df, *args, chunk_rows=length // 12, rounds=8).collect()}
    assert got.keys() == want.keys()
    for key, row in want.items():
        assert got[key]["n"] == row["n"]
        a, b = got[key]["state"], row["state"]
        assert [*a["f"], a["g"]] == pytest.approx([*b["f"], b["g"]], rel=1e-9, abs=1e-9)


def test_falls_back_to_the_fold_in_order(spark):
    df = points(spark, 60)
    args = (composed(), ["ts"], F.col("x"), F.col("y"))
    want = {r["learner_id"]: r["state"] for r in learners.fit_in_order(df, *args).collect()}
    got = {r["learner_id"]: r["state"] for r in parallel_fold.fit_in_parallel(df, *args, chunk_rows=5, rounds=0).collect()}
    assert got == want


def test_states_without_numbers_are_refused(spark):
    with pytest.raises(TypeError):
        parallel_fold.fit_in_parallel(points(spark, 10), learners.identity(), ["ts"], F.col("x"), F.col("y"))
