"""Snapshots under data keys: readable until their key goes, and the audit is never written again."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from adjudica.operators import sealed

AUDIT = "erasure_id string, kind string, value string, erased_at timestamp_ntz, pre_erasure_snapshot string"
MASTER = b"0123456789abcdef"


@pytest.fixture
def audit(spark):
    day = dt.datetime(2020, 2, 29, 12)
    rows = [
        ("a", "name", "x", day, '{"name":"x"}'),
        ("b", "name", "x", day, '{"name":"x","zip":1}'),
        ("c", "name", "y", day + dt.timedelta(days=3), ""),
        ("d", "name", None, day, "of no one"),
        ("e", "name", "z", None, "of no time"),
        ("f", "name", "z", day - dt.timedelta(days=4000), "long ago"),
        ("g", "name", "x", day + dt.timedelta(days=400), "x" * 200_000),
        ("h", "name", "y", day, None),
    ]
    return spark.createDataFrame(rows, AUDIT)


def opened(keys, stored):
    return {r["erasure_id"]: r["pre_erasure_snapshot"] for r in keys.open(stored).collect()}


def test_expiry_and_forgetting_touch_keys_only(spark, audit, tmp_path):
    keys = sealed.KeyStore(spark, str(tmp_path / "keys"), F.lit(MASTER), ["kind", "value"])
    assert keys.keys().isEmpty() and set(opened(keys, keys.seal(audit)).values()) == {None}
    keys.add(audit, as_of=F.lit("2020-03-01"))
    first = sorted(map(tuple, keys.keys().collect()))
    keys.add(audit, as_of=F.lit("2020-03-01"))  # again: no key is drawn anew
    assert sorted(map(tuple, keys.keys().collect())) == first
    assert len(first) == 5 and len({r[0] for r in first}) == 3 and len({bytes(r[2]) for r in first}) == 5

    keys.seal(audit).write.parquet(str(tmp_path / "audit"))
    files = sorted(p.name for p in (tmp_path / "audit").iterdir())
    stored = spark.read.parquet(str(tmp_path / "audit"))
    assert stored.columns == ["erasure_id", "kind", "value", "erased_at", "sealed_snapshot"]
    want = {r["erasure_id"]: r["pre_erasure_snapshot"] for r in audit.collect()} | {"e": None, "f": None}
    assert opened(keys, stored) == want

    assert keys.expire(F.lit("2027-02-28")) == 0  # the last day still counts
    assert opened(keys, stored) == want
    assert keys.expire(F.lit("2027-03-01")) == 1
    want |= {"a": None, "b": None, "d": None}
    assert opened(keys, stored) == want
    assert keys.forget({"kind": "name", "value": "x"}) == 1
    want |= {"g": None}
    assert opened(keys, stored) == want
    assert sorted(p.name for p in (tmp_path / "audit").iterdir()) == files


def test_a_key_of_a_shared_month_goes_alone(spark, tmp_path):
    rows = [(c, "name", c, dt.datetime(2020, 5, d), c) for c, d in (("p", 1), ("q", 20))]
    audit = spark.createDataFrame(rows, AUDIT)
    keys = sealed.KeyStore(spark, str(tmp_path / "keys"), F.lit(MASTER), ["value"])
    keys.add(audit, as_of=F.lit("2020-06-01"))
    stored = spark.createDataFrame(keys.seal(audit).collect(), keys.seal(audit).schema)
    keys.expire(F.lit("2027-05-10"))
    assert opened(keys, stored) == {"p": None, "q": "q"}


def test_no_plain_identifier_and_another_master_opens_nothing(spark, audit, tmp_path):
    keys = sealed.KeyStore(spark, str(tmp_path / "keys"), F.lit(MASTER), ["kind", "value"])
    keys.add(audit, as_of=F.lit("2020-03-01"))
    assert all(len(r["key_id"]) == 64 for r in keys.keys().collect())
    stored = spark.createDataFrame(keys.seal(audit).collect(), keys.seal(audit).schema)
    other = sealed.KeyStore(spark, keys.path, F.lit(b"fedcba9876543210"), ["kind", "value"])
    assert set(opened(other, stored).values()) == {None}
