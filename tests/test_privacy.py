"""Tokens, masks, visibility and erasure."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from adjudica import schemas
from adjudica.functions import permutation
from adjudica.functions.masks import feature_set, mask
from adjudica.functions.tokens import token
from adjudica.operators import erasure, privacy, views, visibility
from adjudica.operators.decisions import evaluate
from adjudica.sources import tables

WORDS = ["Alice123-Bob", "", "x" * 70 + "Z9", "Ünïcode Straße", "é²٣😀 Ωmega", "ǅ ª ⓐ Ⓐ", "Bob", "0"]


def python_token(text, namespace):
    """The token by its definition, one character at a time."""
    digest = hashlib.sha256(f"{namespace}::{text}".encode()).digest()
    return "".join(_swap(c, digest[i % 32]) for i, c in enumerate(text))


def _swap(c, b):
    for test, first, size in ((str.isupper, "A", 26), (str.islower, "a", 26), (str.isdigit, "0", 10)):
        if test(c):
            return chr(ord(first) + b % size)
    return c


def test_tokens_follow_the_definition(spark):
    df = spark.createDataFrame([(w,) for w in WORDS], "w string")
    rows = df.select("w", token(F.col("w")).alias("d"), token(F.col("w"), "names").alias("n")).collect()
    for r in rows:
        assert r["d"] == python_token(r["w"], "default")
        assert r["n"] == python_token(r["w"], "names")
    assert spark.range(1).select(token(F.lit(None).cast("string"))).first()[0] is None


def holders(spark):
    rows = [("individual", "Alice", 1.0, "10001", 30), ("entity", "Acme Corp", 2.0, "94102", 40), ("individual", "Bob", 3.0, "10001", 50)]
    df = spark.createDataFrame(rows, "holder_kind string, holder_name string, premium double, zip_code string, age int")
    return df.withColumns({"schema_version": F.lit(1), "schema_effective_date": F.to_date(F.lit("2026-04-30")), "erased": F.lit(False)})


def test_only_direct_text_is_tokenised(spark):
    df = holders(spark)
    out = {r["age"]: r for r in privacy.tokenise(df, schemas.PROPOSAL).collect()}
    assert out[30]["holder_name"] == python_token("Alice", "holder_name")
    assert out[40]["holder_name"] == python_token("Acme Corp", "holder_name")
    assert out[30]["zip_code"] == "10001"
    by_branch = {r["age"]: r["holder_name"] for r in privacy.tokenise(df, schemas.PROPOSAL, by_branch=True).collect()}
    assert by_branch[40] == "Acme Corp" and by_branch[30] != "Alice"


def test_round_trip_and_unknown_tokens(spark):
    df = holders(spark)
    tokens = privacy.token_map(df.where("age < 50"), ["holder_name"])
    hidden = privacy.tokenise(df, schemas.PROPOSAL)
    shown = {r["age"]: r["holder_name"] for r in privacy.detokenise(hidden, tokens, "holder_name").collect()}
    assert shown == {30: "Alice", 40: "Acme Corp", 50: None}
    assert [r[0] for r in privacy.unknown_tokens(hidden, tokens, "holder_name").collect()] == [python_token("Bob", "holder_name")]
    assert privacy.detokenise(hidden, tokens, "holder_name", "ssns").where("holder_name is not null").count() == 0


def test_collisions_never_multiply_rows(spark):
    names = spark.createDataFrame([(f"{a}{b}",) for a in "abcdefghijklmnop" for b in "abcdefghijklmnopqrstuvwxyz"], "n string")
    tokens = privacy.token_map(names, ["n"])
    assert privacy.collisions(tokens).count() > 0
    hidden = names.select(token(F.col("n"), "n").alias("n"))
    assert privacy.detokenise(hidden, tokens, "n").count() == names.count()


def test_classification_report(spark):
    rows = privacy.classify(spark, schemas.TRACKED_MODELS).collect()
    report = {}
    for r in rows:
        report.setdefault(r["model"], []).append((r["field"], r["category"], r["regimes"]))
    assert report["CanonicalProposal"][:3] == [
        ("holder_name", "direct", ["GLBA"]),
        ("age", "quasi", ["GLBA"]),
        ("zip_code", "quasi", ["GLBA"]),
    ]
    assert [f for f, _, _ in report["CanonicalProposal"][3:]] == sorted(privacy.non_pii_fields(schemas.PROPOSAL))
    assert ("name", None, []) in report["EntityHolder"]
    assert ("name", "direct", ["GLBA"]) in report["IndividualHolder"]


@pytest.mark.parametrize(
    "roles, want",
    [(set(), ("***", None)), ({"ANALYST"}, ("***", "10001")), ({"PRIVACY_OFFICER"}, ("Alice", "10001"))],
)
def test_masks_by_role(spark, roles, want):
    row = privacy.mask_frame(holders(spark), schemas.PROPOSAL, roles).where("premium = 1").first()
    assert (row["holder_name"], row["zip_code"]) == want


def test_mask_tiers_and_policies():
    assert feature_set("enterprise")["masking"] == "policy"
    assert feature_set("anything else")["tier"] == "local"
    with pytest.raises(ValueError):
        mask("x", "top_secret", set())


def test_visibility_meets(spark):
    v = visibility
    lattice = v.Visibility()

    def roles(x):
        return spark.range(1).select(x.alias("v")).first()["v"]

    both = lattice.combine(v.restricted_to(["A", "B"]), v.restricted_to(["B", "C"]))
    assert roles(both)["roles"] == ["B"]
    assert roles(lattice.combine(v.everyone(), v.restricted_to(["A"])))["roles"] == ["A"]
    assert roles(lattice.combine(v.erased(), v.restricted_to(["A"])))["erased"]
    assert roles(evaluate([], lattice)) == (False, None)
    df = holders(spark).withColumn("erased", F.col("age") == 30)
    assert v.visible_to(df, [v.erasure_rule()], "CONSUMER").count() == 2
    assert v.visible_to(df, [v.erasure_rule()], v.AUDITOR).count() == 3


# Erasure ------------------------------------------------------------------------------------

ARGS = {"schema": schemas.PROPOSAL, "table_name": "proposals", "erased_by": "me", "reason": "asked"}


def empty_audit(spark):
    return spark.createDataFrame([], schemas.ERASURE_AUDIT)


def test_erase_one(spark):
    out = erasure.erase_one(holders(spark), "holder_name", "Alice", audit=empty_audit(spark), **ARGS)
    row = out.table.where("premium = 1").first()
    assert (row["holder_name"], row["zip_code"], row["age"], row["erased"]) == (None, None, None, True)
    assert row["holder_kind"] == "individual"
    assert out.table.where("erased").count() == 1
    audit = out.audit.first()
    assert json.loads(audit["pii_fields_nulled"]) == ["age", "holder_name", "zip_code"]
    assert json.loads(audit["pre_erasure_snapshot"])["holder_name"] == "Alice"


def test_erase_is_idempotent_even_when_the_subject_returns(spark):
    first = erasure.erase_one(holders(spark), "holder_name", "Alice", audit=empty_audit(spark), **ARGS)
    again = erasure.erase_one(holders(spark), "holder_name", "Alice", audit=first.audit, **ARGS)
    status = again.statuses.first()
    assert status["status"] == erasure.ALREADY
    assert status["erasure_id"] == first.audit.first()["erasure_id"]
    assert again.audit.count() == 0 and again.table.where("erased").count() == 0
    assert [r["holder_name"] for r in erasure.still_matching(again.table, first.audit, "proposals").collect()] == ["Alice"]


def test_all_matching_rows_are_erased_and_kept_in_snapshots(spark):
    out = erasure.erase_one(holders(spark), "zip_code", "10001", audit=empty_audit(spark), **ARGS)
    assert out.table.where("erased").count() == 2
    assert out.snapshots.count() == 2 and out.audit.count() == 1
    assert out.statuses.first()["n_rows"] == 2


def test_numbers_match_by_value(spark):
    out = erasure.erase_one(holders(spark), "age", "030", audit=empty_audit(spark), **ARGS)
    assert out.table.where("erased").count() == 1


def test_values_are_never_code(spark):
    with pytest.raises(LookupError):
        erasure.erase_one(holders(spark), "holder_name", "x' OR '1'='1", audit=empty_audit(spark), **ARGS)


@pytest.mark.parametrize("column", ["nope", "holder_name; drop table x", "1 = 1"])
def test_bad_columns_are_refused(spark, column):
    with pytest.raises(ValueError):
        erasure.erase_one(holders(spark), column, "Alice", audit=empty_audit(spark), **ARGS)


def test_publish(spark, tmp_path):
    table, audit = str(tmp_path / "proposals"), str(tmp_path / "audit")
    tables.write_table(holders(spark), table)
    tables.ensure_table(spark, audit, schemas.ERASURE_AUDIT)
    out = erasure.erase_one(
        tables.read_table(spark, table), "holder_name", "Bob", audit=tables.read_table(spark, audit), **ARGS
    )
    erasure.publish(out, table, audit)
    assert tables.read_table(spark, table).where("erased").count() == 1
    assert tables.read_table(spark, table).count() == 3
    assert tables.read_table(spark, audit).count() == 1
    assert views.v_proposals(tables.read_table(spark, table)).count() == 2


def test_null_marker_hides_a_row(spark):
    df = holders(spark).withColumn("erased", F.when(F.col("age") > 30, F.lit(False)))
    assert df.where(views.visible()).count() == 2


def test_permutation_of_all_short_names(spark):
    letters = [chr(ord("a") + i) for i in range(26)]
    names = spark.createDataFrame([(a,) for a in letters], "c string")
    every = names.crossJoin(names.toDF("d")).crossJoin(names.toDF("e")).select(F.concat("c", "d", "e").alias("name"))
    out = every.select("name", permutation.permute(F.col("name"), "k").alias("token"))
    assert out.select("token").distinct().count() == 26**3
    assert out.where(~F.col("token").rlike("^[a-z]{3}$")).count() == 0
    assert out.where(permutation.restore(F.col("token"), "k") != F.col("name")).count() == 0
    assert out.where("token = name").count() < 10


def test_permutation_keeps_shapes_and_takes_back(spark):
    texts = ["", "a", "Z", "7", "Ana-Maria O'Neill 42", "Zoë Ångström", "日本 x1", "-- !", None, "Ab1 " * 40]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(
        "t", permutation.permute(F.col("t"), "k").alias("token"), permutation.permute(F.col("t"), F.lit("other")).alias("other")
    ).select("*", permutation.restore(F.col("token"), "k").alias("back"))
    for t, token, other, back in rows.collect():
        assert back == t
        if t:
            assert [c.isalnum() and c.isascii() for c in t] == [c.isalnum() and c.isascii() for c in token]
            assert [(c.isupper(), c.isdigit()) for c in t] == [(c.isupper(), c.isdigit()) for c in token]
    long = [r for r in rows.collect() if r["t"] and len(r["t"]) > 15]
    assert all(r["token"] != r["t"] and r["other"] != r["token"] for r in long)


def test_permutation_turns_a_batch_of_names_together(spark):
    names = spark.range(20_000).select(F.concat(F.lit("Name#"), F.col("id").cast("string")).alias("n"), F.lit("k").alias("k"))
    both = names.withColumn("t", permutation.permute(F.col("n"), F.col("k"))).withColumn("b", permutation.restore(F.col("t"), "k"))
    # No expression that Spark interprets character by character.
    assert "lambda" not in both._jdf.queryExecution().executedPlan().toString()
    assert both.where("n <> b").count() == 0 and both.select("t").distinct().count() == 20_000


def test_permutation_slices_hold_every_text_once_and_bounded(monkeypatch):
    monkeypatch.setattr(permutation, "SLICE_CHARS", 10)
    texts = [None, "", "abcdef", "abcd", "x", "y" * 30, "", None, "zz"]
    parts = [texts[p] for p in permutation._slices(texts)]
    assert [t for part in parts for t in part] == texts
    assert all(sum(len(t or "") for t in part) <= 10 or [len(t) for t in part if t] == [30] for part in parts)
    assert [p.stop for p in permutation._slices([])] == [0]


def test_permutation_of_bytes_that_are_no_text(spark):
    df = spark.range(1).selectExpr("cast(X'61FF62C3' as string) as t")
    out = df.select("t", permutation.permute(F.col("t"), "k").alias("token"))
    assert out.where(permutation.restore(F.col("token"), "k") == F.col("t")).count() == 1


def test_permutation_of_rows_is_that_of_columns(spark):
    rows = [(i, None if i % 7 == 0 else f"Zoë {i}", f"key{i % 3}", [i], None) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, name string, k string, more array<long>, __secret string")
    for key in ("k", F.col("k")):
        out = permutation.permute_rows(df, {"token": "name", "name": "name"}, key)
        assert out.columns == [*df.columns, "token"]
        expected = df.withColumn("token", permutation.permute(F.col("name"), key)).withColumn("name", F.col("token"))
        assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, expected.collect()), key=repr)
        assert "ArrowEvalPython" not in out._jdf.queryExecution().executedPlan().toString()
    back = permutation.restore_rows(permutation.permute_rows(df, {"name": "name"}, "k"), {"name": "name"}, "k")
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
