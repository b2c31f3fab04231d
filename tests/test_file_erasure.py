"""Erasure by files against erasure of the whole table."""

import os
import urllib.parse

import pytest
from pyspark.sql import functions as F

from adjudica import schemas
from adjudica.operators import erasure, file_erasure
from adjudica.sources import file_table

N_FILES = 200


@pytest.fixture(scope="module")
def people(spark):
    return spark.range(4000).select(
        F.lit("individual").alias("holder_kind"),
        F.concat(F.lit("holder "), (F.col("id") % 1500).cast("string")).alias("holder_name"),
        (F.col("id") / 7).alias("premium"),
        F.when(F.col("id") % 9 > 0, F.lpad((F.col("id") % 700).cast("string"), 5, "0")).alias("zip_code"),
        (F.col("id") % 60).cast("int").alias("age"),
        F.lit(1).alias("schema_version"),
        F.to_date(F.lit("2026-04-30")).alias("schema_effective_date"),
        F.lit(False).alias("erased"),
        "id",
    )


@pytest.fixture()
def table(spark, people, tmp_path):
    return file_table.create(people.repartition(N_FILES, "id"), f"file://{tmp_path}/t", ["holder_name", "zip_code"])


def options():
    return {
        "table_name": "proposals", "erased_by": "desk", "reason": "request",
        "at": F.lit("2026-06-01 00:00:00").cast("timestamp_ntz"),
        "erasure_id": F.concat_ws("-", F.lit("e"), "where_column", "where_value"),
    }


def requests(spark, *pairs):
    return spark.createDataFrame(pairs, "where_column string, where_value string")


def no_audit(spark):
    return spark.createDataFrame([], schemas.ERASURE_AUDIT)


def rows(frame):
    return sorted((tuple(r[c] for c in sorted(frame.columns)) for r in frame.collect()), key=repr)


def modified(paths):
    return {p: os.stat(urllib.parse.urlparse(p).path).st_mtime_ns for p in paths}


def test_equals_erasure_of_the_whole_table(spark, people, table, tmp_path):
    wanted = requests(spark, ("holder_name", "holder 17"), ("zip_code", "00003"), ("holder_name", "nobody"), ("zip_code", None))
    before = table.paths()
    times = modified(before)
    result = file_erasure.erase(table, wanted, no_audit(spark), schemas.PROPOSAL, **options())
    whole = erasure.erase(people, wanted, no_audit(spark), schemas.PROPOSAL, **options())
    assert rows(result.erasure.audit.drop("pre_erasure_snapshot")) == rows(whole.audit.drop("pre_erasure_snapshot"))
    assert rows(result.erasure.statuses) == rows(whole.statuses)
    assert rows(result.erasure.snapshots) == rows(whole.snapshots)
    assert rows(table.read()) == rows(people)  # not yet visible
    assert file_erasure.publish(table, result, f"file://{tmp_path}/audit") == 2
    assert rows(table.read()) == rows(whole.table)

    # Only files with a match were written anew, and few others were read.
    matching = "holder_name = 'holder 17' or zip_code = '00003'"
    holding = {r[0] for r in table.read(before).where(matching).select("_metadata.file_path").collect()}
    assert set(result.hit) == holding and 0 < len(holding) < 15
    assert holding <= set(result.candidates) and len(result.candidates) < len(holding) + 10
    kept = file_erasure.untouched(before, result)
    assert set(kept) < set(table.paths()) and len(kept) == len(before) - len(holding)
    assert modified(kept) == {p: times[p] for p in kept}
    assert len(result.erasure.matched.inputFiles()) > 0

    # The subject is gone from the index's new files; asking again changes nothing.
    audit = spark.read.parquet(f"file://{tmp_path}/audit")
    again = file_erasure.erase(table, wanted, audit, schemas.PROPOSAL, **options())
    assert again.hit == [] and file_erasure.publish(table, again, f"file://{tmp_path}/audit") == 2
    assert {r["status"] for r in again.erasure.statuses.collect()} == {"already_erased", "not_found"}
    # Earlier versions stay readable until their files are removed.
    assert rows(table.read(table.paths(1))) == rows(people)


def test_a_column_without_index_reads_all_files(spark, people, table):
    wanted = requests(spark, ("age", "59"))
    result = file_erasure.erase(table, wanted, no_audit(spark), schemas.PROPOSAL, **options())
    assert len(result.candidates) == len(table.paths())
    assert result.erasure.statuses.first()["n_rows"] == people.where("age = 59").count()
    with pytest.raises(ValueError):
        file_erasure.erase(table, requests(spark, ("shoe", "44")), no_audit(spark), schemas.PROPOSAL, **options())


def test_two_writers(spark, table, tmp_path):
    first = file_erasure.erase(table, requests(spark, ("holder_name", "holder 1")), no_audit(spark), schemas.PROPOSAL, **options())
    second = file_erasure.erase(table, requests(spark, ("holder_name", "holder 2")), no_audit(spark), schemas.PROPOSAL, **options())
    file_erasure.publish(table, first, f"file://{tmp_path}/audit")
    with pytest.raises(file_table.ConcurrentChange):
        file_erasure.publish(table, second, f"file://{tmp_path}/audit")
    assert table.version() == 2


def test_sweep_of_a_derived_table(spark, people, table):
    gone = people.select("holder_name").where("holder_name in ('holder 5', 'holder 6')").distinct()
    before = table.paths()
    hit = file_erasure.sweep(table, gone, "holder_name", schemas.PROPOSAL)
    assert 0 < len(hit) < 10 and not set(hit) & set(table.paths()) and len(set(before) & set(table.paths())) == len(before) - len(hit)
    want = erasure.sweep(people, gone, ["holder_name"], schemas.PROPOSAL)
    assert rows(table.read()) == rows(want)
    assert file_erasure.sweep(table, gone, "holder_name", schemas.PROPOSAL) == []


def test_no_rows(spark, people, tmp_path):
    empty = file_table.create(people.limit(0), f"file://{tmp_path}/none", ["holder_name"])
    assert empty.read().count() == 0
    result = file_erasure.erase(empty, requests(spark, ("holder_name", "x")), no_audit(spark), schemas.PROPOSAL, **options())
    assert result.hit == [] and result.erasure.statuses.first()["status"] == "not_found"
