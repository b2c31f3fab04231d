"""The stored log and its index against the whole log in memory."""

import pytest
from pyspark.sql import functions as F

from adjudica.operators import learners
from adjudica.sources.observation_log import ObservationLog

PRIOR = (50.0, 0.5, 25.0)


def rows_between(spark, low, high, step=1):
    """Two hours between rows; one learner has a third of them."""
    return spark.range(low, high, step).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), F.col("id") % 7)).alias("learner_id"),
        F.timestamp_add("HOUR", F.col("id") * 2, F.lit("2024-01-01 00:30:00").cast("timestamp_ntz")).alias("ts"),
        (F.col("id") % 13).cast("double").alias("observation"),
        F.lit(25.0).alias("sigma2"), F.lit(50.0).alias("mu0"), F.lit(0.5).alias("kappa0"),
    )


@pytest.fixture()
def questions(spark):
    asked = spark.range(40).select(
        F.col("id").alias("q"),
        F.when(F.col("id") % 4 == 0, "hot").when(F.col("id") == 7, "nobody").otherwise(F.concat(F.lit("u"), F.col("id") % 7)).alias("learner_id"),
        F.timestamp_add("HOUR", F.col("id") * 17, F.lit("2024-01-01 00:30:00").cast("timestamp_ntz")).alias("ts"),
    )
    return asked


def answers(frame):
    return sorted((r["q"], r["learner_id"], r["n"], round(r["mean"], 9), round(r["precision"], 9)) for r in frame.collect())


def test_answers_as_the_whole_log(spark, questions, tmp_path):
    log = ObservationLog(spark, f"file://{tmp_path}/log")
    assert log.read().count() == 0 and log.refresh() == 0
    # Two appends in order, one of rows that come late, one of them twice; the last is not yet covered.
    parts = {"a": rows_between(spark, 0, 100, 2), "b": rows_between(spark, 100, 200), "late": rows_between(spark, 1, 100, 2), "c": rows_between(spark, 200, 260)}
    whole = None
    for name in ("a", "b", "a", "late", "c"):
        fresh = name not in log.batches()
        assert log.append(parts[name], name) is fresh
        if fresh:
            whole = parts[name] if whole is None else whole.unionByName(parts[name])
        if name != "c":
            assert log.refresh() == int(fresh)
        assert answers(log.state_as_of(questions, "q", PRIOR)) == answers(learners.credibility_as_of(whole, questions, "q", PRIOR))
    assert log.covered() == {"a", "b", "late"}
    assert log.read().count() == 260
    log.refresh()
    assert answers(log.state_as_of(questions, "q", PRIOR)) == answers(learners.credibility_as_of(whole, questions, "q", PRIOR))


def test_reads_the_buckets_asked_for(spark, questions, tmp_path):
    log = ObservationLog(spark, f"file://{tmp_path}/log")
    log.append(rows_between(spark, 0, 200), "a")
    log.refresh()
    one = questions.where("q = 8")
    bucket = one.select(log.bucket(F.col("ts"))).first()[0]
    prefix = log._parts()[0].where(F.col("bucket") == bucket)
    assert all(f"bucket={bucket}/" in f for f in prefix.inputFiles()) or "PartitionFilters: [isnotnull(bucket" in prefix._jdf.queryExecution().toString()
    assert answers(log.state_as_of(one, "q", PRIOR)) == answers(learners.credibility_as_of(rows_between(spark, 0, 200), one, "q", PRIOR))
    from adjudica.operators import ordered

    seen = []
    was, ordered.running_sums = ordered.running_sums, lambda df, *a, **k: (seen.append(df._jdf.queryExecution().executedPlan().toString()), was(df, *a, **k))[1]
    try:
        log.state_as_of(one, "q", PRIOR)
    finally:
        ordered.running_sums = was
    # Both scans, of the index and of the covered log, are cut down to one bucket.
    assert seen[0].count(f"(bucket") >= 2 and f"= {bucket})" in seen[0].replace("L)", ")")


def test_append_by_name_and_bad_batches(spark, tmp_path):
    log = ObservationLog(spark, f"file://{tmp_path}/log")
    rows = rows_between(spark, 0, 5)
    with pytest.raises(ValueError):
        log.append(rows.drop("mu0"), "x")
    with pytest.raises(ValueError):
        log.append(rows, "../x")
    assert log.append(rows.select(*reversed(rows.columns)), "x") and log.read().where("observation = 4").count() == 1
