"""Table IO, contracts as schemas, data checks, analytics."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from adjudica import registry, schemas
from adjudica.operators import analytics, checks, regimes, views
from adjudica.operators.decisions import adm_joint
from adjudica.plans import consumer_views, outcomes
from adjudica.sources import bindings, scratch, tables


def test_contract_projections():
    assert schemas.domain_fields(schemas.PROPOSAL) == ["holder_kind", "holder_name", "premium", "zip_code", "age"]
    assert schemas.extraction_fields(schemas.PROPOSAL) == ["holder_name", "premium", "zip_code", "age"]
    assert list(schemas.sql_types(schemas.PROPOSAL).values()) == [
        "VARCHAR", "VARCHAR", "DOUBLE", "VARCHAR", "INTEGER", "INTEGER", "DATE", "BOOLEAN",
    ]
    assert schemas.udf_argument_types(schemas.PROPOSAL)["age"].simpleString() == "bigint"
    with pytest.raises(ValueError):
        schemas.field("x", schemas.StringType(), pii="secret")


def test_holder_union(spark):
    df = spark.createDataFrame([("individual", "A"), ("entity", "B"), ("trust", "C"), (None, "D")], "holder_kind string, holder_name string")
    kinds = {r["holder"]["name"]: r["holder"]["kind"] for r in schemas.with_holder(df).collect()}
    assert kinds == {"A": "individual", "B": "entity", "C": "entity", "D": "entity"}
    back = schemas.flatten_holder(schemas.with_holder(df).select("holder"))
    assert back.columns == ["holder_kind", "holder_name"]


def test_append_goes_by_name(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_table(spark.sql("select 1 as a, 'x' as b"), path)
    tables.write_table(spark.sql("select 'y' as b, 2 as a"), path, "append")
    assert sorted(tuple(r) for r in tables.read_table(spark, path).collect()) == [(1, "x"), (2, "y")]
    for wrong in ("select 1 as a", "select 1 as a, 'x' as b, 2 as c", "select 'q' as a, 'x' as b"):
        with pytest.raises(ValueError):
            tables.write_table(spark.sql(wrong), path, "append")
    with pytest.raises(ValueError):
        tables.write_table(spark.range(1), path, "upsert")


def test_overwrite_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_table(spark.range(5), path)
    tables.write_table(spark.range(2), path)
    assert tables.read_table(spark, path).count() == 2


@pytest.mark.parametrize("name", sorted(schemas.SYSTEM_TABLES))
def test_system_tables_are_created_once(spark, tmp_path, name):
    path = str(tmp_path / name)
    assert tables.ensure_table(spark, path, schemas.SYSTEM_TABLES[name])
    assert not tables.ensure_table(spark, path, schemas.SYSTEM_TABLES[name])
    df = tables.read_table(spark, path)
    assert df.count() == 0 and df.columns == schemas.SYSTEM_TABLES[name].names


def test_no_contracts_write_nothing(spark, tmp_path):
    path = str(tmp_path / "contracts")
    df = spark.sql("select 1 as premium, array(struct('r' as rule_name)) as payload")
    assert not tables.write_contracts(df.where("false"), path)
    assert not tables.table_exists(spark, path)
    assert tables.write_contracts(df, path)
    assert tables.read_table(spark, path).columns == ["premium", "payload"]


def test_scratch_follows_the_session_folder(spark):
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    path = scratch.new_path(spark, "probe")
    assert path.startswith(folder or scratch.shared_folder(spark))
    frame = scratch.materialise(spark.range(3), "probe")
    assert frame.count() == 3
    assert scratch.release(spark) >= 1


def proposals(spark):
    df = spark.sql("select 'individual' as holder_kind, 'A' as holder_name, 1.5D as premium, '10001' as zip_code, 30 as age")
    return df.withColumns({"schema_version": F.lit(1), "schema_effective_date": F.to_date(F.lit("2026-04-30")), "erased": F.lit(False)})


def test_drift(spark):
    df = proposals(spark)
    assert checks.schema_drift(df).count() == 0
    # Widths are folded and timestamps count as dates, unless types are compared exactly.
    wide = df.withColumns({"age": F.col("age").cast("bigint"), "schema_effective_date": F.current_timestamp()})
    assert checks.schema_drift(wide).count() == 0
    assert checks.schema_drift(wide, fold_widths=False).count() == 2
    drifted = df.drop("zip_code").withColumn("extra", F.array(F.lit(1))).withColumn("premium", F.lit("x"))
    got = {(r["column"], r["problem"]): (r["expected"], r["actual"]) for r in checks.schema_drift(drifted).collect()}
    assert got == {
        ("zip_code", "missing"): ("VARCHAR", None),
        ("extra", "extra"): (None, "VARIANT"),
        ("premium", "type"): ("DOUBLE", "VARCHAR"),
    }


def test_contract_drift(spark):
    d = spark.createDataFrame([("a", "INTEGER"), ("b", "DATE")], "column string, type string")
    a = spark.createDataFrame([("a", "BIGINT"), ("c", "DATE")], "column string, type string")
    assert sorted((r["column"], r["problem"]) for r in checks.contract_drift(d, a).collect()) == [
        ("a", "type"), ("b", "missing"), ("c", "extra"),
    ]


@pytest.mark.parametrize("scores, passed", [([0.5, 0.6], True), ([0.6, 0.6], False), ([0.6], False), ([], True)])
def test_stability_cap_is_strict(spark, scores, passed):
    df = spark.createDataFrame([(s,) for s in scores], "s double")
    assert checks.guardrail_stability(df, F.col("s")).first()["passed"] is passed


@pytest.mark.parametrize("tokens, cap, passed", [(89, 100, True), (90, 100, False), (500, 0, True), (0, 100, True)])
def test_budget_check(spark, tokens, cap, passed):
    df = spark.createDataFrame([(tokens,)], "t int")
    assert checks.budget(df, F.col("t"), cap).first()["passed"] is passed


def test_freshness_edges(spark):
    rows = [(i, dt.datetime(2026, 1, 2) - dt.timedelta(hours=h)) for i, h in enumerate([12, 13, 24, 25])]
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz")
    out = checks.freshness(df, "ts", F.lit("2026-01-02").cast("timestamp_ntz"), ["k"])
    assert {r["k"]: r["status"] for r in out.collect()} == {0: "pass", 1: "warn", 2: "warn", 3: "fail"}


def test_exposed_rows(spark):
    df = proposals(spark).withColumn("erased", F.lit(True))
    out = {r["view_name"]: r["passed"] for r in checks.views_hide_erased({"good": views.v_proposals(df), "bad": df}).collect()}
    assert out == {"good": True, "bad": False}


def test_nulls_and_duplicates(spark):
    df = spark.createDataFrame([(1, None), (1, "x"), (None, "y"), (None, "z")], "k int, v string")
    assert {r["column"]: r["n_null"] for r in checks.not_null(df, ["k", "v"]).collect()} == {"k": 2, "v": 1}
    assert [tuple(r) for r in checks.unique(df, ["k"]).collect()] == [(1, 2)]


def test_quarantine_latest(spark):
    landed = spark.createDataFrame([("2026-01-01",), ("2026-01-02",)], "day string")
    bad = spark.createDataFrame([("2026-01-01",)], "day string")
    assert checks.quarantine_latest(bad, landed).first()["passed"]
    assert not checks.quarantine_latest(landed, landed).first()["passed"]


def test_median_from_counts(spark):
    df = spark.createDataFrame([("a", s) for s in (0.0, 0.0, 0.0, 0.5, 1.0)] + [("b", 0.2), ("b", 0.4)], "g string, s double")
    got = {r["g"]: r for r in analytics.score_statistics(df, ["g"], F.col("s")).collect()}
    assert got["a"]["median_score"] == 0.0 and got["a"]["n_outliers"] == 1
    assert got["b"]["median_score"] == pytest.approx(0.3)


def test_labels_take_the_strictest(spark):
    rows = [("x", "quasi", ["GLBA"]), ("x", "direct", ["HIPAA", "GLBA"]), ("y", None, []), ("z", "sensitive", ["B", "A"])]
    df = spark.createDataFrame(rows, "field string, category string, regimes array<string>")
    got = {r["field"]: (r["category"], r["regimes"]) for r in analytics.merge_labels(df).collect()}
    assert got == {"x": ("direct", ["GLBA", "HIPAA"]), "y": (None, []), "z": ("sensitive", ["A", "B"])}


def test_scans_read_only_what_they_need(spark, sf_dir):
    registry.load()
    plan = registry.QUERIES["rejection_counts"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in plan
    assert "ReadSchema: struct<c_custkey:bigint>" in plan


def test_views_for_sql_readers(spark, sf_dir):
    df = bindings.proposals(spark, sf_dir)
    judged = outcomes.judged(df, regimes.proposal_joint().decisions, adm_joint(1.0))
    made = consumer_views.expose(
        proposals=df,
        outcomes=outcomes.split_outcomes(judged),
        quarantine=spark.createDataFrame([], schemas.QUARANTINE),
        audit=spark.createDataFrame([], schemas.ERASURE_AUDIT),
        observations=bindings.observations(spark, sf_dir),
    )
    assert made == [
        "contracts", "current_state", "rejection_summary", "rejections", "stg_proposals",
        "stg_quarantine", "v_audit_erasures", "v_contracts", "v_proposals",
    ]
    n = spark.sql(
        "select (select count(*) from contracts) + (select count(*) from rejections) as judged, "
        "(select count(*) from v_proposals) as visible"
    ).first()
    assert n["judged"] == n["visible"] > 0
    assert spark.sql("select count(*) from current_state where n > 0").first()[0] > 0
