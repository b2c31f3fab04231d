"""Streams with state of their own: several micro-batches, late and repeated rows, a restart in between."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from adjudica.operators import learners
from adjudica.streaming import stateful

START = dt.datetime(2026, 1, 1)
OBSERVED = "learner_id string, ts timestamp_ntz, observation double, sigma2 double, mu0 double, kappa0 double"
POINTS = "learner_id string, ts timestamp_ntz, event_id bigint, x0 double, y double"


def drop_file(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def stream_of(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_micros_do_not_depend_on_the_zone(spark):
    rows = [(dt.datetime(2026, 3, 29, 2, 30, 1, 250001),), (dt.datetime(1969, 12, 31, 23, 59, 59, 999999),), (None,)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    zero = dt.datetime(1970, 1, 1)
    want = [(r[0] - zero) // dt.timedelta(microseconds=1) if r[0] else stateful.UNTIMED for r in rows]
    for zone in ("UTC", "Europe/Berlin"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert [r[0] for r in df.select(stateful.micros(F.col("ts"))).collect()] == want
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("ttl_ms", [None, 86_400_000])
def test_repeats_count_once_and_late_rows_count(spark, tmp_path, ttl_ms):
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "ck"))
    rows = [(f"u{i % 3}" if i % 7 else None, START + dt.timedelta(minutes=11 * i), float(i), 25.0, 50.0, 0.5) for i in range(90)]
    rows.append(("u0", None, 4.0, 25.0, 50.0, 0.5))
    first = rows[40:] + rows[60:70]
    later = rows[:40] + rows[50:80] + rows[-1:]  # days late, and repeats across micro-batches

    def run():
        once = stateful.distinct_observations(stream_of(spark, OBSERVED, folder), ttl_ms=ttl_ms)
        stateful.write_sums(once, out, mark).awaitTermination()

    drop_file(spark, first, OBSERVED, folder)
    run()
    drop_file(spark, later, OBSERVED, folder)
    run()  # a restart: times seen come from the checkpoint
    got = {r["learner_id"]: r for r in stateful.credibility_of_sums(spark.read.parquet(out)).collect()}
    want = learners.credibility_state(spark.createDataFrame(rows, OBSERVED)).collect()
    assert len(got) == len(want) == 4
    for w in want:
        assert got[w["learner_id"]]["n"] == w["n"]
        assert got[w["learner_id"]]["posterior_mean"] == pytest.approx(w["posterior_mean"])


def test_of_one_time_the_first_batch_counts_and_in_it_the_smallest(spark, tmp_path):
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "ck"))
    nan = float("nan")

    def at(minute, *values):
        return [("u", START + dt.timedelta(minutes=minute), v, 25.0, 50.0, 0.5) for v in values]

    for rows in (
        at(0, 3.0, 2.0, None, nan) + at(1, None, nan),
        at(0, 1.0) + at(1, 7.0) + at(2, -0.5, nan, 0.5),
        at(2, -9.0) + at(3, 4.0),
    ):
        drop_file(spark, rows, OBSERVED, folder)
        once = stateful.distinct_observations(stream_of(spark, OBSERVED, folder))
        stateful.write_sums(once, out, mark).awaitTermination()
    sums = {r["batch"]: (r["n"], r["total"]) for r in spark.read.parquet(out).collect()}
    assert sums == {0: (2, 2.0), 1: (1, -0.5), 2: (1, 4.0)}


def test_seen_times_are_kept_without_a_call_of_python_for_each_bucket(spark, tmp_path):
    folder = str(tmp_path / "in")
    drop_file(spark, [("u", START, 1.0, 25.0, 50.0, 0.5)], OBSERVED, folder)
    once = stateful.distinct_observations(stream_of(spark, OBSERVED, folder))
    plan = once._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "TransformWithState" not in plan


def composed():
    return stateful.compose(stateful.linear(0.01, [0.5]), stateful.linear(0.01, [0.1, 0.2]))


def by_hand(rows):
    """The composed learner over rows in order, from the formulas."""
    a, b, g = 0.1, 0.2, 0.5
    for _, _, _, x, y in sorted(rows, key=lambda r: (r[1] is not None, r[1] or START, r[2])):
        z = a * x + b
        err = g * z - y
        wanted = z - 0.01 * err * g
        g -= 0.01 * err * z
        a, b = a - 0.01 * (z - wanted) * x, b - 0.01 * (z - wanted)
    return a, b, g


def results(spark, folder, out, mark, delay, idle_ms=None):
    frames = stateful.running_learner(
        stream_of(spark, POINTS, folder), composed(), F.col("ts"), F.col("event_id"),
        F.array("x0", F.lit(1.0)), F.col("y"), delay_seconds=delay, idle_ms=idle_ms,
    )
    stateful.write_learner(frames, out, mark).awaitTermination()
    return spark.read.schema(stateful.RESULT).parquet(out)


def points(n):
    return [("h" if i % 3 else f"u{i % 2}", START + dt.timedelta(minutes=i // 2), i, (i % 10) / 10, (i % 7) / 3) for i in range(n)]


def check(log, rows):
    got = {r["learner_id"]: r for r in stateful.newest_learners(log).collect()}
    assert set(got) == {r[0] for r in rows}
    for key, row in got.items():
        mine = [r for r in rows if r[0] == key]
        assert row["n"] == len(mine)
        assert row["state"] == pytest.approx(by_hand(mine))


def test_learner_in_order_over_restarts(spark, tmp_path):
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "ck"))
    rows = points(240)
    mixed = rows[:]
    # Out of order by up to 40 rows, that is 20 minutes, less than the delay.
    random.Random(3).shuffle(shift := list(range(240)))
    mixed.sort(key=lambda r: r[2] + shift[r[2]] % 40)
    for cut in range(0, 240, 80):
        drop_file(spark, mixed[cut : cut + 80] + mixed[max(0, cut - 10) : cut], POINTS, folder)
        log = results(spark, folder, out, mark, delay=3600)
    assert log.select("batch").distinct().count() == 3
    assert stateful.late_rows(log).count() == 0
    check(log, rows)


def test_rows_behind_the_horizon_come_out_as_late(spark, tmp_path):
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "ck"))
    rows = points(120)
    gone = [r for r in rows if r[2] in (4, 8)]
    rest = [r for r in rows if r not in gone]
    drop_file(spark, rest, POINTS, folder)
    results(spark, folder, out, mark, delay=600)
    drop_file(spark, gone, POINTS, folder)
    log = results(spark, folder, out, mark, delay=600)
    assert sorted(r["tie"] for r in stateful.late_rows(log).collect()) == [4, 8]
    check(log, rest)


def test_untimed_rows_come_first_and_idle_keys_are_folded(spark, tmp_path):
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "ck"))
    rows = [*points(30), ("h", None, 1000, 0.5, 1.0), (None, START, 1001, 0.25, 2.0)]
    drop_file(spark, rows, POINTS, folder)
    check(results(spark, folder, out, mark, delay=600, idle_ms=1), rows)
    more = [("h", START + dt.timedelta(days=1, minutes=i), 2000 + i, 0.5, 1.0) for i in range(5)]
    drop_file(spark, more, POINTS, folder)
    check(results(spark, folder, out, mark, delay=600, idle_ms=1), rows + more)
