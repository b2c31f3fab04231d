"""Sketches of scores by day against exact ranks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from adjudica.operators import score_sketches as sketches

DAY = dt.date(2026, 1, 1)


def off(values, quantile, place):
    """How far the quantile's rank is from its place, as a share."""
    low = sum(v < quantile for v in values) / len(values)
    high = sum(v <= quantile for v in values) / len(values)
    return max(0.0, low - place, place - high)


def scored(spark):
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 11).cast("string"))).alias("g"),
        F.date_add(F.lit(DAY), (F.col("id") % 20).cast("int")).alias("on"),
        (F.pmod(F.hash("id"), F.lit(10_007)) / 10_007).alias("score"),
    )
    ties = spark.range(5_000).select(F.lit("ties").alias("g"), F.lit(DAY).alias("on"), F.lit(0.5).alias("score"))
    return rows.unionByName(ties)


def test_merged_days_keep_the_bound_and_equal_one_sketch(spark):
    df = scored(spark)
    days = sketches.daily(df, ["g"], F.col("on"), F.col("score"))
    asked = {"lower": 0.1, "upper": 0.95}
    merged = sketches.statistics(sketches.merge(days, ["g"]), ["g"], asked).collect()
    single = sketches.daily(df, ["g"], F.lit(DAY), F.col("score"))
    whole = {r["g"]: r for r in sketches.statistics(single, ["g"], asked).collect()}
    values = {}
    for g, _, v in df.collect():
        values.setdefault(g, []).append(v)
    assert set(values) == {r["g"] for r in merged} == set(whole)
    for row in merged:
        mine = values[row["g"]]
        assert (row["n"], row["max_score"]) == (len(mine), max(mine))
        assert row["mean_score"] == pytest.approx(sum(mine) / len(mine))
        assert row["n_outliers"] == sum(v > 0.9 for v in mine)
        for name, place in ({"median_score": 0.5} | asked).items():
            assert off(mine, row[name], place) <= sketches.rank_error()
            assert off(mine, whole[row["g"]][name], place) <= sketches.rank_error()
    shares = sketches.share_below(sketches.merge(days, ["g"]), ["g"], 0.25).collect()
    for row in shares:
        exact = sum(v <= 0.25 for v in values[row["g"]]) / len(values[row["g"]])
        assert abs(row["share"] - exact) <= sketches.rank_error()


def test_a_day_written_again_replaces_itself(spark, tmp_path):
    df, path = scored(spark), str(tmp_path / "days")
    days = sketches.daily(df, ["g"], F.col("on"), F.col("score"))
    sketches.store(days, path)
    sketches.store(days.where(F.col("day") == DAY), path)
    stored = spark.read.parquet(path)
    assert sketches.merge(stored, []).first()["n"] == df.count()
    plan = stored.where(F.col("day") == DAY)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_unknown_scores_and_empty_tables(spark):
    df = spark.createDataFrame(
        [("a", None), ("a", float("nan")), ("b", 1.0), (None, 2.0)], "g string, score double"
    )
    days = sketches.daily(df, ["g"], F.lit(DAY), F.col("score"))
    got = {r["g"]: r for r in sketches.statistics(sketches.merge(days, ["g"]), ["g"]).collect()}
    assert (got["a"]["n"], got["a"]["n_unknown"], got["a"]["median_score"], got["a"]["max_score"]) == (0, 2, None, None)
    assert (got["b"]["n"], got["b"]["median_score"], got["b"]["n_outliers"]) == (1, 1.0, 1)
    assert got[None]["median_score"] == 2.0
    none = sketches.daily(df.where("false"), ["g"], F.lit(DAY), F.col("score"))
    assert sketches.statistics(sketches.merge(none, ["g"]), ["g"]).count() == 0
