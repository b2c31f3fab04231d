"""Dispatch, typed reading, quarantine, cross-version rows and compatibility."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from adjudica import schemas
from adjudica.operators import versions

V2 = StructType([*schemas.PROPOSAL.fields, schemas.field("policy_term_months", IntegerType())])


def registry():
    return versions.known_versions(versions.Version(2, "2027-01-01", V2), versions.FIRST)


def test_versions_are_ordered_and_each_given_once():
    assert [v.number for v in registry()] == [1, 2]
    with pytest.raises(ValueError):
        versions.known_versions(versions.FIRST, versions.FIRST)
    with pytest.raises(ValueError):
        versions.known_versions()


def feed(spark, rows):
    return spark.createDataFrame(
        rows,
        "id int, schema_version int, holder_name string, premium string, zip_code string, age string, policy_term_months int",
    )


ROWS = [
    (0, 1, "Alice", "100", "10001", "30", None),
    (1, None, "Bob", "1", "10001", "30", None),
    (2, 99, "Cid", "1", "10001", "30", None),
    (3, 1, None, "1", "10001", "30", None),
    (4, 1, "Eve", "x", "10001", "30.5", None),
    (5, 2, "Fay", "1e2", "10001", " 30.0 ", 12),
    (6, 2, "Gus", "1", "10001", "30", None),
]


def test_every_row_lands_on_one_side(spark):
    parted = versions.dispatch(feed(spark, ROWS), registry(), keep=["id"])
    assert [r["id"] for r in parted.valid[1].collect()] == [0]
    v2 = parted.valid[2].collect()
    assert [(r["id"], r["premium"], r["age"], r["policy_term_months"]) for r in v2] == [(5, 100.0, 30, 12)]
    bad = {r["id"]: (r["schema_version_seen"], r["reason"], r["detail"]) for r in parted.quarantined.collect()}
    assert bad == {
        1: (None, versions.MISSING, ""),
        2: (99, versions.UNKNOWN, "known versions: [1, 2]"),
        3: (1, versions.INVALID, "holder_name: missing"),
        4: (1, versions.INVALID, "premium: not a double; age: not a int"),
        6: (2, versions.INVALID, "policy_term_months: missing"),
    }
    counts = versions.dispatch_counts(parted).first()
    assert (counts["n_input"], counts["n_valid"], counts["n_quarantined"]) == (7, 2, 5)


def test_defaults_fill_absent_columns_only(spark):
    row = versions.dispatch(feed(spark, ROWS[:1])).valid[1].first()
    assert row["holder_kind"] == "individual" and row["erased"] is False
    assert row["schema_effective_date"] == dt.date(2026, 4, 30)
    explicit = feed(spark, ROWS[:1]).withColumn("erased", F.lit(None).cast("boolean"))
    parted = versions.dispatch(explicit)
    assert parted.quarantined.first()["detail"] == "erased: missing"


def test_closed_lists(spark):
    df = feed(spark, ROWS[:1]).withColumn("holder_kind", F.lit("trust"))
    parted = versions.dispatch(df)
    assert parted.quarantined.first()["detail"] == "holder_kind: not allowed"


@pytest.mark.parametrize(
    "value, ok",
    [("'yes'", True), ("'0'", False), ("'maybe'", None), ("1", True), ("2", None), ("true", True)],
)
def test_booleans(spark, value, ok):
    df = feed(spark, ROWS[:1]).withColumn("erased", F.expr(value))
    parted = versions.dispatch(df)
    row = parted.valid[1].first()
    assert (row["erased"] if row else None) == ok


def test_text_is_not_made_from_numbers(spark):
    df = feed(spark, ROWS[:1]).withColumn("zip_code", F.lit(10001))
    parted = versions.dispatch(df)
    assert parted.quarantined.first()["detail"] == "zip_code: not a string"


def test_stamp(spark):
    assert versions.stamp_default(spark.range(1)).first()["schema_version"] == 1
    explicit = spark.sql("select cast(null as int) as schema_version")
    assert versions.stamp_default(explicit).first()["schema_version"] is None


def test_quarantine_rows(spark):
    parted = versions.dispatch(feed(spark, ROWS), registry())
    rows = versions.to_quarantine(parted.quarantined).collect()
    assert len({r["quarantine_id"] for r in rows}) == 5
    payload = {json.loads(r["raw_payload"])["id"]: json.loads(r["raw_payload"]) for r in rows}
    assert payload[3]["holder_name"] is None and payload[4]["age"] == "30.5"
    names = versions.to_quarantine(parted.quarantined).schema.simpleString()
    assert names == schemas.QUARANTINE.simpleString()


def test_versions_in_one_shape(spark):
    parted = versions.dispatch(feed(spark, ROWS), registry(), keep=["id"])
    merged = {r["id"]: r for r in parted.merged.collect()}
    assert merged[0]["policy_term_months"] is None and merged[0]["schema_version"] == 1
    assert merged[5]["policy_term_months"] == 12


def changes(spark, old, new):
    frames = [
        spark.createDataFrame([(m, f, t, r) for m, fs in s.items() for f, (t, r) in fs.items()], versions.SNAPSHOT)
        for s in (old, new)
    ]
    return versions.diff(*frames)


A = {"a": ("int", True)}


@pytest.mark.parametrize(
    "old, new, want",
    [
        ({"M": A}, {"M": A}, []),
        ({"M": A}, {"M": {**A, "b": ("string", False)}}, [("b", "additive")]),
        ({"M": A}, {"M": {**A, "b": ("string", True)}}, [("b", "breaking")]),
        ({"M": {**A, "b": ("string", False)}}, {"M": A}, [("b", "breaking")]),
        ({"M": A}, {"M": {"a": ("string", True)}}, [("a", "breaking")]),
        ({"M": A}, {"M": {"a": ("int", False)}}, [("a", "additive")]),
        ({"M": {"a": ("int", False)}}, {"M": A}, [("a", "breaking")]),
        ({"M": A}, {"M": {"a": ("string", False)}}, [("a", "additive"), ("a", "breaking")]),
        ({"M": A, "N": A}, {"M": A}, [(None, "breaking")]),
        ({"M": A}, {"M": A, "N": A}, [(None, "additive")]),
    ],
)
def test_diff(spark, old, new, want):
    found = changes(spark, old, new)
    assert sorted(((r["field"], r["kind"]) for r in found.collect()), key=str) == want
    broken = any(kind == "breaking" for _, kind in want)
    assert versions.verdict(found).first()["passed"] is not broken
    assert versions.verdict(found, acknowledged=True).first()["passed"]


def test_snapshot_of_contracts(spark):
    rows = {(r["model"], r["field"]): (r["type"], r["required"]) for r in versions.snapshot(spark, schemas.TRACKED_MODELS).collect()}
    assert rows["CanonicalProposal", "premium"] == ("double", True)
    assert rows["CanonicalProposal", "holder_kind"] == ("one of individual, entity", False)
    assert rows["Proposal", "erased"] == ("boolean", False)
    assert len(rows) == 3 + 8 + 2 + 2


def test_changes_since_a_stored_baseline(spark, tmp_path):
    path = f"file://{tmp_path}/baseline"
    versions.store_baseline(spark, path, schemas.TRACKED_MODELS)
    assert versions.changes_since(spark, path, schemas.TRACKED_MODELS).count() == 0
    retyped = [
        schemas.field(f.name, IntegerType()) if f.name == "premium" else f
        for f in schemas.TRACKED_MODELS["CanonicalProposal"].fields
    ]
    now = {**schemas.TRACKED_MODELS, "CanonicalProposal": StructType(retyped)}
    found = {(r["field"], r["change"]) for r in versions.changes_since(spark, path, now).collect()}
    assert ("premium", "type changed from double to int") in found
