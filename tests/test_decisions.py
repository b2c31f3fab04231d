"""Monoids, rules, regimes, admission, and the two surfaces rules can be written in."""

import json

import pytest
from pyspark.sql import functions as F

from adjudica import schemas
from adjudica.operators import analytics, decisions, monoids, regimes, rules
from adjudica.operators.decisions import adm_below, adm_joint, adm_no_violation
from adjudica.plans import outcomes, underwriting as gate
from adjudica.registry.decisions import CALLABLES

GOLDEN = [
    ("Mira", 120.0, "20002", 41),
    ("Jonas", -75.0, "95110", 33),
    ("Petra", 310.0, "96001", 19),
    ("Olu", 90.0, "30301", 52),
]


@pytest.fixture(scope="module")
def golden(spark):
    df = spark.createDataFrame(GOLDEN, "holder_name string, premium double, zip_code string, age int")
    return df.select(
        F.lit("individual").alias("holder_kind"),
        "*",
        F.lit(1).alias("schema_version"),
        F.to_date(F.lit("2026-04-30")).alias("schema_effective_date"),
        F.lit(False).alias("erased"),
    )


BASE = {
    "premium": 2145.0,
    "coverage": 18200.0,
    "expected_claim": 1300.0,
    "jurisdiction": "CA",
    "product_line": "Auto",
    "rating_factors": ["driving_record", "miles_driven"],
    "consent": True,
    "prior_premium": 2015.0,
    "explainability_score": 0.75,
    "cession": 0.0,
}

# One change to a clean proposal, the state whose regime judges it, and the rules that must fire.
DEMO = [
    ({}, "CA", []),
    ({"rating_factors": ["driving_record", "race"]}, "CA", ["federal/protected_class", "ca/prop_103"]),
    ({"rating_factors": ["driving_record", "credit_score"]}, "CA", ["ca/prop_103"]),
    ({"coverage": 10000.0}, "CA", ["ca/min_auto_liability"]),
    ({"jurisdiction": "NY", "coverage": 20000.0}, "NY", ["ny/min_auto_liability"]),
    ({"consent": False}, "CA", ["guardrail/consent"]),
    ({"premium": 2860.0}, "CA", ["guardrail/rate_stability"]),
    ({"explainability_score": 0.4}, "CA", ["guardrail/explainability"]),
    (
        {"coverage": 150000.0, "premium": 39000.0, "prior_premium": None},
        "CA",
        ["guardrail/reinsurance_cession"],
    ),
    ({"premium": 1365.0, "prior_premium": None}, "CA", ["max_loss_ratio", "coverage_cap"]),
    ({"coverage": 32500.0}, "CA", ["coverage_cap"]),
]


def underwriting(spark, changes):
    rows = [tuple({**BASE, **c}[n] for n in schemas.UNDERWRITING.names) for c in changes]
    return spark.createDataFrame(rows, schemas.UNDERWRITING)


def fired(df, system):
    value = decisions.evaluate(system, monoids.VIOLATIONS)
    return [r[0] for r in df.select(value["rule_name"]).collect()]


def test_demo_proposals_fire_exactly_their_rules(spark):
    for state, regime in (("CA", regimes.california_regime()), ("NY", regimes.new_york_regime())):
        cases = [(c, want) for c, s, want in DEMO if s == state]
        df = underwriting(spark, [c for c, _ in cases])
        assert fired(df, regime.decisions) == [want for _, want in cases]


def test_missing_values_are_not_good(spark):
    nothing = spark.createDataFrame([(None,) * 10], schemas.UNDERWRITING)
    names = fired(nothing, regimes.california_regime().decisions)[0]
    assert {"guardrail/consent", "guardrail/explainability", "positive_premium"} <= set(names)
    judged = decisions.validate(nothing, [rules.low_explainability_risk()], monoids.SCORE, lambda score: score <= 1.0)
    assert judged.first()["admitted"] is False


@pytest.mark.parametrize(
    "change, rule",
    [
        ({"rating_factors": None}, "ca/prop_103"),
        ({"rating_factors": ["driving_record", None]}, "federal/protected_class"),
        ({"jurisdiction": None, "rating_factors": ["credit_score"]}, "ca/prop_103"),
        ({"jurisdiction": None}, "guardrail/unknown_jurisdiction"),
        ({"product_line": None}, "guardrail/unknown_product_line"),
        ({"expected_claim": None}, "max_loss_ratio"),
        ({"expected_claim": float("nan"), "product_line": "Health"}, "federal/aca_min_loss_ratio"),
        ({"coverage": None}, "ca/min_auto_liability"),
        ({"coverage": float("nan")}, "ca/min_auto_liability"),
        ({"premium": None, "prior_premium": 1000.0}, "guardrail/rate_stability"),
    ],
)
def test_no_rule_fails_open(spark, change, rule):
    assert rule in fired(underwriting(spark, [change]), regimes.california_regime().decisions)[0]


def test_gate_keeps_every_row_on_one_side(spark):
    changes = [{}, {"rating_factors": [None]}, {"product_line": "Boat"}, {"consent": False}, {"prior_premium": None}]
    rows = underwriting(spark, changes).select(F.monotonically_increasing_id().alias("row"), "*")
    gated = gate.gate(rows, regimes.california_regime().decisions, keep=["row"])
    got = [(r["side"], r["why"]) for r in gate.outcomes(gated, ["row"]).orderBy("row").collect()]
    assert got == [
        ("admitted", ""), ("refused", "rating_factors: holds a missing value"), ("refused", "product_line: not allowed"),
        ("rejected", "guardrail/consent"), ("admitted", ""),
    ]


def test_premium_of_zero_is_no_division(spark):
    df = underwriting(spark, [{"premium": 0.0, "prior_premium": 0.0, "product_line": "Health"}])
    assert fired(df, regimes.california_regime().decisions) == [["positive_premium", "coverage_cap"]]


def test_protected_factors_keep_order_and_duplicates(spark):
    df = underwriting(spark, [{"rating_factors": ["sex", "age", "race", "sex"]}])
    violation = df.select(rules.federal_protected_class().violation().alias("v")).first()["v"]
    assert violation["context"] == {"factors": "sex, race, sex"}
    assert violation["message"].endswith('["sex","race","sex"]')


def test_demo_regime(spark):
    df = spark.createDataFrame(
        [("a", 10.0, ["race", "age", "origin", "race"]), ("b", 0.0, ["age"])],
        "holder string, premium_observed double, risk_factors array<string>",
    )
    value = decisions.evaluate(regimes.demo().decisions, monoids.VIOLATIONS)
    got = [[(v["rule_name"], v["message"]) for v in r[0]] for r in df.select(value).collect()]
    assert got == [
        [("federal/protected_class", "barred factors: ['origin', 'race']")],
        [("ca/prop_103", "an observed premium of zero or less")],
    ]


def test_lift_fills_the_other_slot(spark, golden):
    rule, score = rules.premium(), rules.risk_score_zip()
    one = decisions.lift(rule, "violations").value()
    two = decisions.lift(score, "score").value()
    jonas = golden.where("holder_name = 'Jonas'").select(one.alias("one"), two.alias("two")).first()
    assert jonas["one"]["score"] == 0.0 and len(jonas["one"]["violations"]) == 1
    assert jonas["two"]["violations"] == [] and jonas["two"]["score"] == 0.5


def test_joint_golden_rows(golden):
    judged = outcomes.judged(golden, regimes.proposal_joint(0.5, 0.6).decisions, adm_joint(1.0))
    got = {
        r["holder_name"]: (r["admitted"], [v["rule_name"] for v in r["payload"]["violations"]], r["payload"]["score"])
        for r in judged.collect()
    }
    assert got["Mira"] == (True, [], 0.0)
    assert got["Olu"] == (True, [], 0.0)
    assert got["Jonas"] == (False, ["premium"], 0.5)
    assert got["Petra"] == (False, [], pytest.approx(1.1))
    sides = outcomes.split_outcomes(judged)
    summary = analytics.rejection_summary(sides.rejections).collect()
    assert [(r["rule_name"], r["n"]) for r in summary] == [("premium", 1)]


def test_lighter_age_weight_admits_petra(golden):
    judged = outcomes.judged(golden, regimes.proposal_joint().decisions, adm_joint(1.0))
    petra = judged.where("holder_name = 'Petra'").first()
    assert petra["admitted"] and petra["payload"]["score"] == pytest.approx(0.8)


def test_tombstones_are_not_judged(golden):
    marked = golden.withColumn("erased", F.col("holder_name") == "Jonas")
    judged = outcomes.judged(marked, regimes.proposal_joint().decisions, adm_joint(1.0))
    assert judged.count() == 3


def test_contracts_pass_their_regime_again(golden, tmp_path):
    system = regimes.proposal_joint(0.5, 0.6).decisions
    done = outcomes.write_outcomes(
        outcomes.judged(golden, system, adm_joint(1.0)), str(tmp_path / "outcomes")
    )
    again = outcomes.judged(done.contracts.drop("payload", "payload_json"), system, adm_joint(1.0))
    assert again.count() == 2 and again.where(~F.col("admitted")).count() == 0
    plan = done.contracts._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(admitted" in plan


def test_fold_equals_left_fold(spark):
    """Flat folds are an optimisation: they equal combining step by step from the identity."""
    df = underwriting(spark, [c for c, _, _ in DEMO])
    for system, monoid in (
        (regimes.california_regime().decisions, monoids.VIOLATIONS),
        (regimes.risk_budget().decisions, monoids.SCORE),
        (regimes.joint().decisions, monoids.JOINT),
    ):
        slow = monoids.Monoid.fold(monoid, [d.value() for d in system])
        fast = decisions.evaluate(system, monoid)
        rows = df.select(F.to_json(F.struct(slow.alias("v"))), F.to_json(F.struct(fast.alias("v")))).collect()
        assert all(a == b for a, b in rows)


def test_empty_system_is_the_identity(spark):
    row = spark.range(1).select(decisions.evaluate([], monoids.JOINT).alias("m")).first()["m"]
    assert row["violations"] == [] and row["score"] == 0.0


def test_monoid_laws(spark):
    df = spark.createDataFrame(
        [(0.5, 1, ["a"], 2.0, 3, [], 0.0, 2, ["b", "c"])],
        "s1 double, r1 int, a1 array<string>, s2 double, r2 int, a2 array<string>, s3 double, r3 int, a3 array<string>",
    )
    profile, advised = monoids.RISK_PROFILE, monoids.ADVISED_SCORE
    for m, items in (
        (profile, [profile.of(score=F.col(f"s{i}"), severity=F.col(f"r{i}")) for i in (1, 2, 3)]),
        (advised, [advised.of(score=F.col(f"s{i}"), advisories=F.col(f"a{i}")) for i in (1, 2, 3)]),
    ):
        x, y, z = items
        got = df.select(
            m.combine(m.combine(x, y), z).alias("left"),
            m.combine(x, m.combine(y, z)).alias("right"),
            m.combine(m.empty(), x).alias("from_left"),
            m.combine(x, m.empty()).alias("from_right"),
            x.alias("x"),
        ).first()
        assert got["left"] == got["right"]
        assert got["from_left"] == got["x"] == got["from_right"]


def test_cheap_admission_equals_payload_admission(spark):
    df = underwriting(spark, [c for c, _, _ in DEMO])
    for system, monoid, adm in (
        (regimes.california_regime().decisions, monoids.VIOLATIONS, adm_no_violation),
        (regimes.joint().decisions, monoids.JOINT, adm_joint(0.5)),
        (regimes.risk_budget().decisions, monoids.SCORE, adm_below(0.5)),
    ):
        value = decisions.evaluate(system, monoid)
        rows = df.select(adm(value), decisions.admitted(adm, system, value)).collect()
        assert all(a == b for a, b in rows)


def test_custom_decision_disables_the_shortcut():
    custom = decisions.Decision("any", lambda: monoids.VIOLATIONS.empty())
    assert decisions.plain_rules([custom]) is None
    assert decisions.plain_rules(regimes.joint().decisions) is not None


def test_score_cap_is_strict(spark):
    df = spark.createDataFrame([(0.5,), (0.49,)], "s double")
    assert [r[0] for r in df.select(adm_below(0.5)(F.col("s"))).collect()] == [False, True]


def test_unknown_component():
    with pytest.raises(ValueError):
        monoids.JOINT.of(weight=None)


def test_add_rule_appends():
    regime = regimes.federal().add_rule(rules.consent())
    assert [r.name for r in regime.rules] == [
        "federal/aca_min_loss_ratio",
        "federal/protected_class",
        "guardrail/consent",
    ]
    tagged = regimes.Regime((), (("a", "1"),)) + regimes.Regime((), (("b", "2"),))
    assert tagged.tags == (("a", "1"), ("b", "2"))


def test_bundle_order():
    names = [d.name for d in regimes.california_regime().decisions]
    assert names == [
        "federal/aca_min_loss_ratio",
        "federal/protected_class",
        "ca/min_auto_liability",
        "ca/prop_103",
        "guardrail/reinsurance_cession",
        "guardrail/explainability",
        "guardrail/rate_stability",
        "guardrail/consent",
        "positive_premium",
        "max_loss_ratio",
        "coverage_cap",
        "guardrail/unknown_jurisdiction",
        "guardrail/unknown_product_line",
    ]


def test_callables_agree_with_columns(golden):
    run = decisions.validator_udf(schemas.PROPOSAL, **CALLABLES)
    args = [F.col(c) for c in schemas.domain_fields(schemas.PROPOSAL)]
    by_row = golden.select("holder_name", run(*args).alias("r"))
    judged = outcomes.judged(golden, regimes.proposal_joint(0.5, 0.6).decisions, adm_joint(1.0))
    native = {r["holder_name"]: r for r in judged.collect()}
    for r in by_row.collect():
        payload = json.loads(r["r"]["payload_json"])
        other = json.loads(native[r["holder_name"]]["payload_json"])
        assert r["r"]["admitted"] == native[r["holder_name"]]["admitted"]
        assert [v["rule_name"] for v in payload[0]] == [v["rule_name"] for v in other[0]]
        assert payload[1] == pytest.approx(other[1])


def test_udf_runs_once_per_row(golden):
    run = decisions.validator_udf(schemas.PROPOSAL, **CALLABLES)
    args = [F.col(c) for c in schemas.domain_fields(schemas.PROPOSAL)]
    plan = (
        golden.select(run(*args).alias("r"))
        .select("r.admitted", "r.payload_json")
        ._jdf.queryExecution()
        .executedPlan()
        .toString()
    )
    assert plan.count("ArrowEvalPython") == 1 and plan.count("run(") <= 2


def test_udf_refuses_structured_arguments():
    with pytest.raises(TypeError):
        decisions.validator_udf(schemas.UNDERWRITING, [], bool)
