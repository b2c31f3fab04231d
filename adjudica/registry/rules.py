"""One query per catalogue entry: which proposals a rule fires on, or the risk it adds."""

from pyspark.sql import functions as F

from adjudica.operators import analytics, decisions, monoids, regimes, rules
from adjudica.plans import underwriting
from adjudica.registry import names, query, r6
from adjudica.sources import bindings

UNDERWRITING_FIRES = {
    "federal_protected_class": (
        rules.federal_protected_class,
        "list_has_any(rating_factors, ['race', 'color', 'religion', 'national_origin', 'sex', 'disability', 'genetic_information'])",
    ),
    "federal_aca_min_loss_ratio": (
        rules.federal_aca_min_loss_ratio,
        "product_line = 'Health' and premium > 0 and expected_claim / premium < 8e-1",
    ),
    "ca_prop_103": (
        rules.ca_prop_103,
        "jurisdiction = 'CA' and product_line = 'Auto' and len(list_filter(rating_factors, lambda f: f not in ('driving_record', 'miles_driven', 'years_driving_experience'))) > 0",
    ),
    "ca_min_auto_liability": (
        rules.ca_min_auto_liability,
        "jurisdiction = 'CA' and product_line = 'Auto' and coverage < 15000e0",
    ),
    "ny_min_auto_liability": (
        rules.ny_min_auto_liability,
        "jurisdiction = 'NY' and product_line = 'Auto' and coverage < 25000e0",
    ),
    "guardrail_consent": (rules.consent, "not consent"),
    "guardrail_rate_stability": (
        lambda: rules.rate_stability(0.25),
        "prior_premium is not null and prior_premium > 0 and abs(premium - prior_premium) / prior_premium > 25e-2",
    ),
    "guardrail_explainability": (lambda: rules.explainability(0.6), "explainability_score < 6e-1"),
    "guardrail_reinsurance_cession": (
        lambda: rules.reinsurance_cession(100000.0, 0.5),
        "coverage > 100000e0 and cession < 5e-1",
    ),
    "positive_premium": (rules.positive_premium, "premium <= 0"),
    "max_loss_ratio": (
        lambda: rules.max_loss_ratio(0.85),
        "premium > 0 and expected_claim / premium > 85e-2",
    ),
    "coverage_cap": (lambda: rules.coverage_cap(10.0), "coverage > 10e0 * premium"),
}

UNDERWRITING_SCORES = {
    "high_coverage_risk": (
        rules.high_coverage_risk,
        "case when coverage > 30000e0 then 3e-1 when coverage > 20000e0 then 15e-2 else 0e0 end",
    ),
    "low_explainability_risk": (
        rules.low_explainability_risk,
        "greatest(0e0, 8e-1 - explainability_score)",
    ),
    "high_loss_ratio_risk": (
        rules.high_loss_ratio_risk,
        "case when premium <= 0 then 0e0 else greatest(0e0, expected_claim / premium - 5e-1) end",
    ),
}

PROPOSAL_SCORES = {
    "risk_score_zip": (rules.risk_score_zip, "case when zip_code like '9%' then 5e-1 else 0e0 end"),
    "risk_score_age": (rules.risk_score_age, "case when age < 25 then 3e-1 else 0e0 end"),
}


def _fires(name, build, predicate, source, binding):
    @query(
        f"with s as ({source}) select proposal_id, coalesce({predicate}, false) as fired from s",
        name=f"rule_{name}",
    )
    def run(spark, sf_dir):
        return binding(spark, sf_dir).select("proposal_id", build().fired().alias("fired"))


def _scores(name, build, amount, source, binding):
    @query(
        f"with s as ({source}) select proposal_id, round({amount}, 6) as amount from s",
        name=f"rule_{name}",
    )
    def run(spark, sf_dir):
        return binding(spark, sf_dir).select("proposal_id", r6(build().value()).alias("amount"))


for _name, (_build, _sql) in UNDERWRITING_FIRES.items():
    _fires(_name, _build, _sql, bindings.UNDERWRITING, bindings.underwriting)
for _name, (_build, _sql) in UNDERWRITING_SCORES.items():
    _scores(_name, _build, _sql, bindings.UNDERWRITING, bindings.underwriting)
for _name, (_build, _sql) in PROPOSAL_SCORES.items():
    _scores(_name, _build, _sql, bindings.PROPOSALS, bindings.proposals)
_fires("premium", rules.premium, "premium <= 0", bindings.PROPOSALS, bindings.proposals)
_fires(
    "demo_protected_class",
    rules.demo_protected_class,
    "list_has_any(risk_factors, ['race', 'religion', 'origin'])",
    bindings.DEMO_PROPOSALS,
    bindings.demo_proposals,
)
_fires("demo_prop_103", rules.demo_prop_103, "premium_observed <= 0", bindings.DEMO_PROPOSALS, bindings.demo_proposals)


@query(
    f"""with s as ({bindings.UNDERWRITING}) select proposal_id,
  array_to_string(list_filter(rating_factors, lambda f: f in ('race', 'color', 'religion', 'national_origin', 'sex', 'disability', 'genetic_information')), ', ') as factors,
  case when premium > 0 and expected_claim / premium > 85e-2 then round(expected_claim / premium, 6) end as loss_ratio
from s"""
)
def rule_contexts(spark, sf_dir):
    """Context values that violations carry, read back from the map."""
    bad, ratio = rules.federal_protected_class(), rules.max_loss_ratio(0.85)
    context = F.when(ratio.fired(), ratio.violation()["context"]["loss_ratio"].cast("double"))
    factors = F.when(bad.fired(), bad.violation()["context"]["factors"]).otherwise("")
    return bindings.underwriting(spark, sf_dir).select(
        "proposal_id", factors.alias("factors"), r6(context).alias("loss_ratio")
    )


# Every seventh value of each column is missing, every eleventh number is NaN.
WITH_GAPS = f"""
select proposal_id,
  case when proposal_id % 7 = 1 then null when proposal_id % 11 = 1 then cast('NaN' as double) else premium end as premium,
  case when proposal_id % 7 = 2 then null when proposal_id % 11 = 2 then cast('NaN' as double) else coverage end as coverage,
  case when proposal_id % 7 = 3 then null else consent end as consent,
  case when proposal_id % 7 = 4 then null when proposal_id % 11 = 4 then cast('NaN' as double) else explainability_score end as explainability_score,
  case when proposal_id % 7 = 5 then null when proposal_id % 11 = 5 then cast('NaN' as double) else cession end as cession,
  expected_claim
from ({bindings.UNDERWRITING}) u
"""


@query(
    f"""with s as ({WITH_GAPS})
select proposal_id,
  not coalesce(consent, false) as consent,
  not coalesce(explainability_score >= 6e-1 and not isnan(explainability_score), false) as explainability,
  not coalesce(coverage <= 100000e0 and not isnan(coverage), false)
    and not coalesce(cession >= 5e-1 and not isnan(cession), false) as cession,
  not coalesce(premium > 0 and not isnan(premium), false) as premium,
  not coalesce(coverage <= 10e0 * premium and not isnan(coverage) and not isnan(premium), false) as coverage_cap,
  case when coverage is null or isnan(coverage) or explainability_score is null or isnan(explainability_score)
         or premium is null or isnan(premium) then 1e9
       else round((case when coverage > 30000e0 then 3e-1 when coverage > 20000e0 then 15e-2 else 0e0 end)
            + greatest(0e0, 8e-1 - explainability_score)
            + (case when premium <= 0 then 0e0 else greatest(0e0, expected_claim / premium - 5e-1) end), 6) end as risk
from s"""
)
def rules_on_missing_values(spark, sf_dir):
    """What is missing or no number is never good: rules fire on it, and its risk is unbounded."""
    bindings.tables(spark, sf_dir, "orders", "customer")
    fired = {
        "consent": rules.consent(),
        "explainability": rules.explainability(0.6),
        "cession": rules.reinsurance_cession(100000.0, 0.5),
        "premium": rules.positive_premium(),
        "coverage_cap": rules.coverage_cap(10.0),
    }
    risk = rules.high_coverage_risk().value() + rules.low_explainability_risk().value() + rules.high_loss_ratio_risk().value()
    return spark.sql(WITH_GAPS).select(
        "proposal_id", *[r.fired().alias(n) for n, r in fired.items()], r6(F.least(risk, F.lit(1e9))).alias("risk")
    )


# What each rule says and carries. In the text, "#" stands for the number in the context.
_PROTECTED = "list_filter(rating_factors, lambda f: f in ('race', 'color', 'religion', 'national_origin', 'sex', 'disability', 'genetic_information'))"
_UNAPPROVED = "list_filter(rating_factors, lambda f: f not in ('driving_record', 'miles_driven', 'years_driving_experience'))"
_SAYS = {
    "federal_protected_class": (
        "federal/protected_class", f"concat('factors that federal law bars from rating: ', to_json({_PROTECTED}))", f"array_to_string({_PROTECTED}, ', ')", "0e0"),
    "federal_aca_min_loss_ratio": (
        "federal/aca_min_loss_ratio", "'health claims are too small a part of the premium, ratio # , floor 0.80'", "''", "expected_claim / premium"),
    "ca_prop_103": (
        "ca/prop_103", f"concat('factors California does not approve for auto rating: ', to_json({_UNAPPROVED}))", f"array_to_string({_UNAPPROVED}, ', ')", "0e0"),
    "ca_min_auto_liability": (
        "ca/min_auto_liability", "'auto cover in California starts at 15,000'", "''", "coverage"),
    "ny_min_auto_liability": (
        "ny/min_auto_liability", "'auto cover in New York starts at 25,000'", "''", "coverage"),
    "guardrail_consent": ("guardrail/consent", "'the insured has not agreed to the use of data'", "''", "0e0"),
    "guardrail_rate_stability": (
        "guardrail/rate_stability", "'premium moved against last year by # , cap 0.25'", "''", "abs(premium - prior_premium) / prior_premium"),
    "guardrail_explainability": (
        "guardrail/explainability", "'the model explains itself only to # , floor 0.6'", "''", "explainability_score"),
    "guardrail_reinsurance_cession": (
        "guardrail/reinsurance_cession", "'coverage # above 100000.0 asks for cession of 0.5, there is #'", "''", "coverage + cession"),
    "positive_premium": ("positive_premium", "'no premium above zero'", "''", "premium"),
    "max_loss_ratio": ("max_loss_ratio", "'claims take # of the premium, cap 0.85'", "''", "expected_claim / premium"),
    "coverage_cap": ("coverage_cap", "'coverage is more than 10.0 premiums'", "''", "coverage + premium"),
}
_SAID = " union all ".join(
    f"select proposal_id, '{name}' as rule_name, {text} as message, {factors} as factors, round({numbers}, 4) as numbers "
    f"from s where coalesce({UNDERWRITING_FIRES[key][1]}, false)"
    for key, (name, text, factors, numbers) in _SAYS.items()
)


@query(f"with s as ({bindings.UNDERWRITING}) {_SAID}")
def rule_messages(spark, sf_dir):
    """Message and context of every violation of all underwriting rules."""
    system = [build() for build, _ in UNDERWRITING_FIRES.values()]
    df = bindings.underwriting(spark, sf_dir)
    payload = decisions.evaluate(system, monoids.VIOLATIONS)
    facts = analytics.violation_facts(df.withColumn("payload", payload), "proposal_id", "payload")
    values = F.map_values("context")
    spaced = F.aggregate(
        values,
        F.concat(F.lit(" "), F.col("message"), F.lit(" ")),
        lambda text, v: F.replace(text, F.concat(F.lit(" "), v, F.lit(" ")), F.lit(" # ")),
    )
    numbers = F.aggregate(values, F.lit(0.0), lambda total, v: total + F.coalesce(v.try_cast("double"), F.lit(0.0)))
    return facts.select(
        "proposal_id",
        "rule_name",
        F.trim(spaced).alias("message"),
        F.coalesce(F.try_element_at("context", F.lit("factors")), F.lit("")).alias("factors"),
        F.round(numbers, 4).alias("numbers"),
    )


# Of thirteen rows one each has: no factors, a factor missing among others, no place, no line, no
# claim, no coverage, no premium, and a claim, coverage or premium that is no number.
UNCLEAR = f"""
select proposal_id,
  case proposal_id % 13 when 6 then null when 9 then cast('NaN' as double) else premium end as premium,
  case proposal_id % 13 when 5 then null when 8 then cast('NaN' as double) else coverage end as coverage,
  case proposal_id % 13 when 4 then null when 7 then cast('NaN' as double) else expected_claim end as expected_claim,
  case when proposal_id % 13 = 2 then null else jurisdiction end as jurisdiction,
  case when proposal_id % 13 = 3 then null else product_line end as product_line,
  case proposal_id % 13 when 0 then null when 1 then array('driving_record', cast(null as string)) else rating_factors end as rating_factors,
  consent, prior_premium, explainability_score, cession
from ({bindings.UNDERWRITING}) u
"""
_UNCLEAR_SQL = UNCLEAR.replace("array('driving_record', cast(null as string))", "['driving_record', null]")

# A condition that is good, for each rule of the Californian regime in its order; the rule fires unless it is true.
_GOOD = {
    "federal/aca_min_loss_ratio": "coalesce(product_line <> 'Health', false) or premium <= 0 or (not isnan(premium) and not isnan(expected_claim) and expected_claim / premium >= 8e-1)",
    "federal/protected_class": "len(rating_factors) = len(list_filter(rating_factors, lambda f: f not in ('race', 'color', 'religion', 'national_origin', 'sex', 'disability', 'genetic_information')))",
    "ca/min_auto_liability": "coalesce(jurisdiction <> 'CA', false) or coalesce(product_line <> 'Auto', false) or (coverage >= 15000e0 and not isnan(coverage))",
    "ca/prop_103": "coalesce(jurisdiction <> 'CA', false) or coalesce(product_line <> 'Auto', false) or len(rating_factors) = len(list_filter(rating_factors, lambda f: f in ('driving_record', 'miles_driven', 'years_driving_experience')))",
    "guardrail/reinsurance_cession": "(coverage <= 100000e0 and not isnan(coverage)) or cession >= 5e-1",
    "guardrail/explainability": "explainability_score >= 6e-1",
    "guardrail/rate_stability": "prior_premium is null or prior_premium <= 0 or (not isnan(premium) and abs(premium - prior_premium) / prior_premium <= 25e-2)",
    "guardrail/consent": "consent",
    "positive_premium": "premium > 0 and not isnan(premium)",
    "max_loss_ratio": "premium <= 0 or (not isnan(premium) and not isnan(expected_claim) and expected_claim / premium <= 85e-2)",
    "coverage_cap": "coverage <= 10e0 * premium and not isnan(coverage) and not isnan(premium)",
    "guardrail/unknown_jurisdiction": "jurisdiction <> ''",
    "guardrail/unknown_product_line": "product_line <> ''",
}
_WHY = "concat_ws(',', " + ", ".join(f"case when not coalesce({good}, false) then '{name}' end" for name, good in _GOOD.items()) + ")"


@query(f"with s as ({_UNCLEAR_SQL}) select proposal_id, {_WHY} as fired, {_WHY} = '' as admitted from s")
def rules_on_unclear_rows(spark, sf_dir):
    """The Californian regime on rows that lack something, without a contract before it."""
    bindings.tables(spark, sf_dir, "orders", "customer")
    system = regimes.california_regime().decisions
    judged = decisions.validate(spark.sql(UNCLEAR), system, monoids.VIOLATIONS, decisions.adm_no_violation)
    return judged.select("proposal_id", names("payload").alias("fired"), "admitted")


_ABSENT = "concat_ws('; ', " + ", ".join(
    f"case when {c} is null then '{c}: missing' end" if c != "rating_factors"
    else "case when rating_factors is null then 'rating_factors: missing' when len(list_filter(rating_factors, lambda f: f is null)) > 0 then 'rating_factors: holds a missing value' end"
    for c in ("premium", "coverage", "expected_claim", "jurisdiction", "product_line", "rating_factors", "consent", "explainability_score", "cession")
) + ")"


@query(
    f"""with s as ({_UNCLEAR_SQL}), w as (select proposal_id, {_ABSENT} as absent, {_WHY} as fired from s)
select proposal_id, case when absent <> '' then 'refused' when fired = '' then 'admitted' else 'rejected' end as side,
  case when absent <> '' then absent else fired end as why from w"""
)
def underwriting_gate(spark, sf_dir):
    """Rows by contract first, then by the Californian regime: refused, rejected or admitted, and why."""
    bindings.tables(spark, sf_dir, "orders", "customer")
    rows = spark.sql(UNCLEAR)
    gated = underwriting.gate(rows, regimes.california_regime().decisions, keep=["proposal_id"])
    return underwriting.outcomes(gated, ["proposal_id"])
