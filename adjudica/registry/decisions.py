"""Monoids, evaluation, admission, composition, the callable surface and run reports."""

from pyspark.sql import functions as F

from adjudica import schemas
from adjudica.operators import analytics, decisions, monoids, regimes, rules
from adjudica.operators.decisions import adm_below, adm_joint, adm_no_violation
from adjudica.plans import outcomes
from adjudica.registry import names, query, r6
from adjudica.registry.rules import UNDERWRITING_FIRES, UNDERWRITING_SCORES
from adjudica.registry.tables import _JOINT_P, joint_proposals
from adjudica.sources import bindings, scratch

_U = f"with u as ({bindings.UNDERWRITING})"


def _fired(*keys: str) -> str:
    """Names of the fired rules, in rule order, as DuckDB text."""
    cases = []
    for key in keys:
        predicate = UNDERWRITING_FIRES[key][1]
        cases.append(f"case when {predicate} then '{_RULE_NAMES[key]}' end")
    return f"concat_ws(',', {', '.join(cases)})"


_RULE_NAMES = {
    "federal_protected_class": "federal/protected_class",
    "federal_aca_min_loss_ratio": "federal/aca_min_loss_ratio",
    "ca_prop_103": "ca/prop_103",
    "ca_min_auto_liability": "ca/min_auto_liability",
    "ny_min_auto_liability": "ny/min_auto_liability",
    "guardrail_consent": "guardrail/consent",
    "guardrail_rate_stability": "guardrail/rate_stability",
    "guardrail_explainability": "guardrail/explainability",
    "guardrail_reinsurance_cession": "guardrail/reinsurance_cession",
    "positive_premium": "positive_premium",
    "max_loss_ratio": "max_loss_ratio",
    "coverage_cap": "coverage_cap",
}

_FEDERAL = ["federal_aca_min_loss_ratio", "federal_protected_class"]
_CALIFORNIA = ["ca_min_auto_liability", "ca_prop_103"]
_NEW_YORK = ["ny_min_auto_liability"]
_INTERNAL = [
    "guardrail_reinsurance_cession",
    "guardrail_explainability",
    "guardrail_rate_stability",
    "guardrail_consent",
]
_BASIC = ["positive_premium", "max_loss_ratio", "coverage_cap"]
_RISK = " + ".join(f"({sql})" for _, sql in UNDERWRITING_SCORES.values())


def _rule_query(name, regime, keys):
    @query(f"{_U} select proposal_id, {_fired(*keys)} as rules from u", name=name)
    def run(spark, sf_dir):
        df = bindings.underwriting(spark, sf_dir)
        value = decisions.evaluate(regime().decisions, monoids.VIOLATIONS)
        return df.select("proposal_id", value.alias("v")).select("proposal_id", names("v").alias("rules"))


_rule_query("regime_federal", regimes.federal, _FEDERAL)
_rule_query("regime_california", regimes.california, _CALIFORNIA)
_rule_query("regime_new_york", regimes.new_york, _NEW_YORK)
_rule_query("regime_internal_underwriting", regimes.internal_underwriting, _INTERNAL)
_rule_query("regime_basic_governance", regimes.basic_governance, _BASIC)
_rule_query("compose_california", regimes.california_regime, _FEDERAL + _CALIFORNIA + _INTERNAL + _BASIC)
_rule_query("compose_new_york", regimes.new_york_regime, _FEDERAL + _NEW_YORK + _INTERNAL + _BASIC)
_rule_query(
    "compose_add_rule",
    lambda: regimes.new_york().add_rule(rules.consent()),
    [*_NEW_YORK, "guardrail_consent"],
)


@query(f"{_U} select proposal_id, {_fired('guardrail_consent', 'coverage_cap')} as rules from u")
def monoid_list(spark, sf_dir):
    m = monoids.VIOLATIONS
    value = m.combine(
        m.combine(m.empty(), rules.consent().value()), rules.coverage_cap(10.0).value()
    )
    df = bindings.underwriting(spark, sf_dir).select("proposal_id", value.alias("v"))
    return df.select("proposal_id", names("v").alias("rules"))


@query(f"{_U} select proposal_id, round({_RISK}, 6) as score from u")
def monoid_score(spark, sf_dir):
    value = decisions.evaluate(regimes.risk_budget().decisions, monoids.SCORE)
    return bindings.underwriting(spark, sf_dir).select("proposal_id", r6(value).alias("score"))


@query(
    f"{_U} select jurisdiction, round(sum({_RISK}), 4) as total_score, count(*) as n from u group by jurisdiction"
)
def monoid_score_over_rows(spark, sf_dir):
    value = decisions.evaluate(regimes.risk_budget().decisions, monoids.SCORE)
    df = bindings.underwriting(spark, sf_dir).groupBy("jurisdiction")
    return df.agg(F.round(F.sum(value), 4).alias("total_score"), F.count(F.lit(1)).alias("n"))


@query(f"{_U} select proposal_id, {_fired(*_BASIC)} as rules, round({_RISK}, 6) as score from u")
def monoid_product(spark, sf_dir):
    value = decisions.evaluate(regimes.joint().decisions, monoids.JOINT)
    df = bindings.underwriting(spark, sf_dir).select("proposal_id", value.alias("payload"))
    return df.select("proposal_id", names().alias("rules"), r6("payload.score").alias("score"))


@query(
    f"{_U} select proposal_id, {_fired(*_BASIC)} as rules, round({_RISK}, 6) as score, "
    f"{_fired(*_BASIC)} = '' and {_RISK} < 9e-1 as admitted from u"
)
def validate_joint(spark, sf_dir):
    df = decisions.validate(
        bindings.underwriting(spark, sf_dir), regimes.joint().decisions, monoids.JOINT, adm_joint(0.9)
    )
    return df.select("proposal_id", names().alias("rules"), r6("payload.score").alias("score"), "admitted")


@query(
    f"{_U} select proposal_id, {_fired(*_BASIC)} = '' as no_violation, {_RISK} < 5e-1 as below_cap, "
    f"{_fired(*_BASIC)} = '' and {_RISK} < 5e-1 as both, true as labelled from u"
)
def admission_predicates(spark, sf_dir):
    value = decisions.evaluate(regimes.joint().decisions, monoids.JOINT)
    df = bindings.underwriting(spark, sf_dir).select("proposal_id", value.alias("m"))
    m = F.col("m")
    return df.select(
        "proposal_id",
        adm_no_violation(m["violations"]).alias("no_violation"),
        adm_below(0.5)(m["score"]).alias("below_cap"),
        adm_joint(0.5)(m).alias("both"),
        decisions.adm_always(m).alias("labelled"),
    )


@query(
    f"{_U} select proposal_id, jurisdiction = 'TX' and product_line = 'Life' and coverage > 10e0 * premium as fired from u"
)
def guarded_rule(spark, sf_dir):
    rule = decisions.for_jurisdiction("TX", decisions.for_product_line("Life", rules.coverage_cap(10.0)))
    return bindings.underwriting(spark, sf_dir).select("proposal_id", rule.fired().alias("fired"))


@query(
    f"""{_U}, e as (select proposal_id, {_fired(*_FEDERAL)} = '' as a, {_fired(*_BASIC)} = '' as b,
  {_fired(*_FEDERAL, *_BASIC)} = '' as c from u)
select c as composed, a and b as separately, count(*) as n from e group by all"""
)
def conjunction_law(spark, sf_dir):
    """A composed regime admits a row exactly when each of its parts does."""

    def admits(regime):
        return adm_no_violation(decisions.evaluate(regime.decisions, monoids.VIOLATIONS))

    first, second = regimes.federal(), regimes.basic_governance()
    df = bindings.underwriting(spark, sf_dir).select(
        admits(regimes.compose(first, second)).alias("composed"),
        (admits(first) & admits(second)).alias("separately"),
    )
    return df.groupBy("composed", "separately").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"with p as ({bindings.PROPOSALS}), {_JOINT_P} select proposal_id, concat('[', case when rules = '' then '[]' else "
    """'[{"rule_name":"premium","message":"premium is not above zero","context":{}}]' end, ',', cast(score as varchar), ']') as payload_json from violations"""
)
def payload_json(spark, sf_dir):
    return joint_proposals(spark, sf_dir).select("proposal_id", "payload_json")


# Row callables, for the surface that takes any Python function of a row.


def _premium(row):
    bad = row["premium"] <= 0
    return ([{"rule_name": "premium", "message": "premium is not above zero"}] if bad else [], 0.0)


def _zip(row):
    return ([], 0.5 if row["zip_code"].startswith("9") else 0.0)


def _age(row):
    return ([], 0.6 if row["age"] < 25 else 0.0)


def _pair(x, y):
    return (x[0] + y[0], x[1] + y[1])


def _nothing():
    return ([], 0.0)


def _ok(m):
    return not m[0] and m[1] < 1.0


CALLABLES = {"decisions": [_premium, _zip, _age], "adm": _ok, "empty": _nothing, "combine": _pair}

_UDF_CHECK = (
    f"with p as ({bindings.PROPOSALS}), {_JOINT_P} select proposal_id, rules = '' and score < 1e0 as admitted, "
    "round(score, 6) as score, nullif(rules, '') as first_rule from violations"
)


def _read_payload(df):
    return df.select(
        "proposal_id",
        "result.admitted",
        r6(F.get_json_object("result.payload_json", "$[1]").cast("double")).alias("score"),
        F.get_json_object("result.payload_json", "$[0][0].rule_name").alias("first_rule"),
    )


@query(_UDF_CHECK)
def validator_udf(spark, sf_dir):
    run = decisions.validator_udf(schemas.PROPOSAL, **CALLABLES)
    df = bindings.proposals(spark, sf_dir).where("erased = false")
    args = [F.col(c) for c in schemas.domain_fields(schemas.PROPOSAL)]
    return _read_payload(df.select("proposal_id", run(*args).alias("result")))


@query(_UDF_CHECK)
def validator_in_sql(spark, sf_dir):
    call = decisions.register(spark, "validate_proposal", schemas.PROPOSAL, **CALLABLES)
    df = bindings.proposals(spark, sf_dir).where("erased = false")
    return _read_payload(df.selectExpr("proposal_id", f"{call} as result"))


_SIDES = f"with p as ({bindings.PROPOSALS}), {_JOINT_P} "


@query(
    _SIDES + "select case when rules = '' and score < 1e0 then 'contract' else 'rejection' end as side, "
    "proposal_id, rules, round(score, 6) as score from violations"
)
def split_outcomes(spark, sf_dir):
    judged = joint_proposals(spark, sf_dir)
    done = outcomes.write_outcomes(judged, scratch.new_path(spark, "outcomes"))
    columns = ["proposal_id", names().alias("rules"), r6("payload.score").alias("score")]
    return done.contracts.select(F.lit("contract").alias("side"), *columns).unionByName(
        done.rejections.select(F.lit("rejection").alias("side"), *columns)
    )


_SUMMARY = f"""{_U}, r as (select unnest(string_split({_fired(*_BASIC)}, ',')) as rule_name from u
  where not ({_fired(*_BASIC)} = '' and {_RISK} < 9e-1))
select rule_name, count(*) as n from r where rule_name <> '' group by rule_name"""


@query(_SUMMARY)
def rejection_counts(spark, sf_dir):
    return analytics.rejection_counts(
        bindings.underwriting(spark, sf_dir), regimes.joint().decisions, adm_joint(0.9), monoids.JOINT
    )


@query(_SUMMARY)
def rejection_summary(spark, sf_dir):
    judged = outcomes.judged(
        bindings.underwriting(spark, sf_dir), regimes.joint().decisions, adm_joint(0.9)
    )
    return analytics.rejection_summary(outcomes.split_outcomes(judged).rejections)


@query(
    _SIDES + "select count(*) filter (rules = '' and score < 1e0) as contracts, "
    "count(*) filter (not (rules = '' and score < 1e0)) as rejections from violations"
)
def run_summary(spark, sf_dir):
    return outcomes.run_summary(joint_proposals(spark, sf_dir))
