"""Second-tier reports: profiles, visibility, labels, facts, releases, spend."""

from pyspark.sql import functions as F

from adjudica.functions import costs, masks
from adjudica.operators import analytics, decisions, lineage, monoids, regimes, rules, score_sketches, visibility
from adjudica.operators.decisions import Decision, adm_joint, lift_all
from adjudica.plans import outcomes, replay
from adjudica.registry import query, r6
from adjudica.registry.decisions import _BASIC, _RISK, _U, _fired
from adjudica.registry.rules import UNDERWRITING_FIRES, UNDERWRITING_SCORES
from adjudica.sources import bindings, scratch

_SEVERE = f"""greatest(case when {UNDERWRITING_FIRES['guardrail_consent'][1]} then 4 else 0 end,
  case when {UNDERWRITING_FIRES['max_loss_ratio'][1]} then 2 else 0 end)"""


def _graded(rule, severity):
    profile = monoids.RISK_PROFILE
    rank = monoids.SEVERITIES.index(severity)
    return Decision(
        rule.name, lambda: profile.of(severity=F.when(rule.fired(), rank).otherwise(0))
    )


@query(
    f"{_U} select proposal_id, round({_RISK}, 6) as score, cast({_SEVERE} as int) as severity, "
    f"{_RISK} < 7e-1 and {_SEVERE} < 4 as admitted from u"
)
def score_and_severity(spark, sf_dir):
    profile = monoids.RISK_PROFILE
    system = [
        _graded(rules.consent(), "CRITICAL"),
        _graded(rules.max_loss_ratio(0.85), "MEDIUM"),
        *lift_all(regimes.risk_budget().decisions, profile),
    ]
    adm = decisions.adm_risk_profile(0.7, monoids.SEVERITIES.index("CRITICAL"))
    df = decisions.validate(bindings.underwriting(spark, sf_dir), system, profile, adm)
    return df.select("proposal_id", r6("payload.score").alias("score"), "payload.severity", "admitted")


@query(
    f"{_U} select proposal_id, round({_RISK}, 6) as score, "
    "concat_ws(';', case when cession < 3e-1 then 'raise cession' end, "
    "case when explainability_score < 5e-1 then 'review model' end) as advisories, "
    f"{_RISK} < 7e-1 as admitted from u"
)
def score_and_advisories(spark, sf_dir):
    advised = monoids.ADVISED_SCORE

    def advise(name, text, when):
        none = F.array().cast("array<string>")
        return Decision(
            name,
            lambda: advised.of(advisories=F.when(when(), F.array(F.lit(text))).otherwise(none)),
        )

    system = [
        advise("cession", "raise cession", lambda: F.col("cession") < 0.3),
        advise("model", "review model", lambda: F.col("explainability_score") < 0.5),
        *lift_all(regimes.risk_budget().decisions, advised),
    ]
    df = decisions.validate(
        bindings.underwriting(spark, sf_dir), system, advised, lambda m: m["score"] < 0.7
    )
    return df.select(
        "proposal_id",
        r6("payload.score").alias("score"),
        F.array_join("payload.advisories", ";").alias("advisories"),
        "admitted",
    )


_VISIBLE = f"""with p as ({bindings.PROPOSALS}),
h as (select proposal_id, erased, holder_kind = 'entity' and age > 60 as litigation, premium < 0 as claims from p),
v as (select proposal_id, unnest(['CONSUMER', 'LITIGATION', 'CLAIMS', 'PRIVACY_OFFICER']) as role, erased, litigation, claims from h)
select proposal_id, role from v where (role = 'PRIVACY_OFFICER' or not erased)
  and (not litigation or role in ('LITIGATION', 'PRIVACY_OFFICER'))
  and (not claims or role in ('CLAIMS', 'LITIGATION', 'PRIVACY_OFFICER'))"""


@query(_VISIBLE)
def visibility_by_role(spark, sf_dir):
    held = [
        visibility.erasure_rule(),
        visibility.hold_rule(
            "litigation",
            lambda: (F.col("holder_kind") == "entity") & (F.col("age") > 60),
            visibility.LITIGATION_ROLES,
        ),
        visibility.hold_rule(
            "claims", lambda: F.col("premium") < 0, ["CLAIMS", *visibility.LITIGATION_ROLES]
        ),
    ]
    value = decisions.evaluate(held, visibility.Visibility())
    df = bindings.proposals(spark, sf_dir).select("proposal_id", value.alias("v"))
    # One pass for all roles: each row lists the roles that may see it.
    roles = ["CONSUMER", "LITIGATION", "CLAIMS", "PRIVACY_OFFICER"]
    seen = F.array_compact(
        F.array(*[F.when(visibility.admits(r)(F.col("v")), F.lit(r)) for r in roles])
    )
    return df.select("proposal_id", F.explode(seen).alias("role"))


_LABELS = """with l as (
  select p_type as field, case when p_size > 48 then 'direct' when p_size > 30 then 'quasi' when p_size > 20 then 'sensitive' end as category,
    case when p_size % 3 = 0 then ['GLBA'] when p_size % 3 = 1 then ['HIPAA', 'GLBA'] else ['CCPA'] end as regimes from part
  union all
  select n_name as field, case when c_acctbal > 9e3 then 'quasi' when c_acctbal > 5e3 then 'sensitive' end, ['GLBA']
  from customer join nation on c_nationkey = n_nationkey)"""


@query(
    _LABELS + """, r as (select field, min(case category when 'direct' then 1 when 'quasi' then 2 when 'sensitive' then 3 end) as rank from l group by field),
t as (select field, string_agg(distinct regime, ',' order by regime) as regimes from (select field, unnest(regimes) as regime from l) group by field)
select field, case rank when 1 then 'direct' when 2 then 'quasi' when 3 then 'sensitive' end as category, regimes from r join t using (field)"""
)
def label_merge(spark, sf_dir):
    bindings.tables(spark, sf_dir, "part", "customer", "nation")
    parts = spark.sql(
        """select p_type as field, case when p_size > 48 then 'direct' when p_size > 30 then 'quasi'
  when p_size > 20 then 'sensitive' end as category, case when p_size % 3 = 0 then array('GLBA')
  when p_size % 3 = 1 then array('HIPAA', 'GLBA') else array('CCPA') end as regimes from part"""
    )
    customers = spark.sql(
        """select n_name as field, case when c_acctbal > 9e3 then 'quasi' when c_acctbal > 5e3 then 'sensitive' end
  as category, array('GLBA') as regimes from customer join nation on c_nationkey = n_nationkey"""
    )
    merged = analytics.merge_labels(parts.unionByName(customers))
    return merged.withColumn("regimes", F.array_join("regimes", ","))


_ALL = ["federal_aca_min_loss_ratio", "federal_protected_class", *_BASIC]


@query(
    f"""{_U}, r as (select proposal_id, string_split({_fired(*_ALL)}, ',') as rules from u where {_fired(*_ALL)} <> '')
select proposal_id, cast(i - 1 as int) as position, rules[i] as rule_name from (select proposal_id, rules, unnest(range(1, len(rules) + 1)) as i from r)"""
)
def violation_facts(spark, sf_dir):
    system = regimes.compose(regimes.federal(), regimes.basic_governance()).decisions
    df = decisions.validate(
        bindings.underwriting(spark, sf_dir), system, monoids.VIOLATIONS, adm_no_violation
    )
    facts = analytics.violation_facts(df, "proposal_id", "payload")
    return facts.select("proposal_id", "position", "rule_name")


adm_no_violation = decisions.adm_no_violation


@query(
    f"""with p as ({bindings.PROPOSALS}), s as (select substr(zip_code, 1, 2) as zip_area,
  (case when zip_code like '9%' then 5e-1 else 0e0 end) + (case when age < 25 then 6e-1 else 0e0 end) as score from p)
select zip_area, count(*) as n, round(avg(score), 6) as mean_score, round(median(score), 6) as median_score,
  round(max(score), 6) as max_score, count(*) filter (score > 9e-1) as n_outliers from s group by zip_area"""
)
def score_by_zip(spark, sf_dir):
    value = decisions.evaluate(regimes.proposal_joint(0.5, 0.6).decisions, monoids.JOINT)
    df = bindings.proposals(spark, sf_dir).withColumn("payload", value)
    stats = analytics.score_statistics(
        df.withColumn("zip_area", F.substring("zip_code", 1, 2)), ["zip_area"], F.col("payload.score")
    )
    return stats.select(
        "zip_area", "n", *[r6(c).alias(c) for c in ("mean_score", "median_score", "max_score")], "n_outliers"
    )


@query(
    f"""with u as ({bindings.UNDERWRITING}), s as (select jurisdiction, product_line, premium * (coverage / 1e6) + coverage / 1e6 as score from u)
select jurisdiction, product_line, count(*) as n, round(avg(score), 4) as mean_score, round(median(score), 4) as median_score,
  round(max(score), 4) as max_score, count(*) filter (score > 9e-1) as n_outliers from s group by jurisdiction, product_line"""
)
def exposure_by_line(spark, sf_dir):
    """The same statistics of a continuous score, of which nearly every value occurs once."""
    exposure = F.col("premium") * (F.col("coverage") / 1e6) + F.col("coverage") / 1e6
    stats = analytics.score_statistics(
        bindings.underwriting(spark, sf_dir), ["jurisdiction", "product_line"], exposure
    )
    rounded = [F.round(c, 4).alias(c) for c in ("mean_score", "median_score", "max_score")]
    return stats.select("jurisdiction", "product_line", "n", *rounded, "n_outliers")


def _releases():
    adm = adm_joint(0.9)
    return {
        "2026.1": replay.Release("2026.1", "2026-04-30", regimes.joint().decisions, adm),
        "2026.2": replay.Release(
            "2026.2",
            "2026-07-01",
            (regimes.joint() + regimes.Regime(tuple(lift_all([rules.consent()])))).decisions,
            adm_joint(0.8),
        ),
    }


_NEW = f"({_fired(*_BASIC, 'guardrail_consent')} = '' and {_RISK} < 8e-1)"
_OLD = f"({_fired(*_BASIC)} = '' and {_RISK} < 9e-1)"


@query(
    f"""{_U}, v as (select jurisdiction, case when product_line in ('Auto', 'Life') then '2026.1' else '2026.2' end as decision_version,
  case when product_line in ('Auto', 'Life') then {_OLD} else {_NEW} end as admitted from u)
select decision_version, jurisdiction, count(*) filter (admitted) as contracts, count(*) filter (not admitted) as rejections,
  case decision_version when '2026.1' then '2026-04-30' else '2026-07-01' end as released_on,
  case decision_version when '2026.1' then 6 else 7 end as n_decisions from v group by decision_version, jurisdiction"""
)
def decision_releases(spark, sf_dir):
    releases = _releases()
    in_force = F.when(F.col("product_line").isin("Auto", "Life"), "2026.1").otherwise("2026.2")
    judged = replay.apply_release(bindings.underwriting(spark, sf_dir), releases, in_force)
    table = replay.releases_table(spark, list(releases.values()))
    dated = table.groupBy("decision_version").agg(
        F.max("released_on").cast("string").alias("released_on"),
        F.count(F.lit(1)).cast("int").alias("n_decisions"),
    )
    counted = judged.groupBy("decision_version", "jurisdiction").agg(
        F.count_if("admitted").alias("contracts"), F.count_if(~F.col("admitted")).alias("rejections")
    )
    return counted.join(dated, "decision_version")


@query(
    f"{_U} select jurisdiction, count(*) as n, count(*) filter ({_OLD} and not {_NEW}) as approved_to_rejected, "
    f"count(*) filter (not {_OLD} and {_NEW}) as rejected_to_approved, 0e0 as mean_score_shift from u group by jurisdiction"
)
def replay_release(spark, sf_dir):
    releases = _releases()
    df = bindings.underwriting(spark, sf_dir)
    summary = replay.replay_summary(
        replay.replay(df, releases["2026.1"], releases["2026.2"]), ["jurisdiction"]
    )
    return summary.withColumn("mean_score_shift", r6("mean_score_shift"))


_STEPPED = UNDERWRITING_SCORES["high_coverage_risk"][1]


@query(
    f"{_U} select proposal_id, {_RISK} < 6e-1 as admitted_before, ({_STEPPED}) < 6e-1 as admitted_after, "
    f"round({_RISK}, 6) as score_before, round({_STEPPED}, 6) as score_after from u"
)
def replay_scores(spark, sf_dir):
    adm = adm_joint(0.6)
    old = replay.Release("a", "2026-01-01", lift_all(regimes.risk_budget().decisions), adm)
    new = replay.Release("b", "2026-02-01", lift_all([rules.high_coverage_risk()]), adm)
    df = replay.replay(bindings.underwriting(spark, sf_dir), old, new)
    return df.select(
        "proposal_id",
        "admitted_before",
        "admitted_after",
        r6("score_before").alias("score_before"),
        r6("score_after").alias("score_after"),
    )


@query(
    """with r as (select role, conv_id, cast(sum(greatest(1, length(text) // 4 + 20)) as bigint) as tokens, count(*) as calls
  from conversations group by role, conv_id),
l as (select *, lag(tokens) over (partition by role order by conv_id) as prior_tokens from r)
select role, conv_id, tokens, calls, prior_tokens, tokens - prior_tokens as change from l"""
)
def token_run_log(spark, sf_dir):
    calls = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return analytics.run_log(calls, "role", "conv_id", costs.extract_tokens(F.col("text"), 4))


@query(
    f"with p as ({bindings.PROPOSALS}) select proposal_id, concat(substr(zip_code, 1, 3), '**') as zip_code, "
    "cast(year(schema_effective_date) as int) as effective_year from p"
)
def partial_reveal(spark, sf_dir):
    return bindings.proposals(spark, sf_dir).select(
        "proposal_id",
        masks.zip_prefix(F.col("zip_code")).alias("zip_code"),
        masks.year_only(F.col("schema_effective_date")).alias("effective_year"),
    )


_BY_LINE = f"""{_U}, s as (select u.product_line, {_RISK} as score from u join orders on o_orderkey = proposal_id
  where o_orderdate::date >= date '1993-01-01' and o_orderdate::date < date '1997-01-01')"""


@query(
    _BY_LINE + " select product_line, count(*) as n, round(avg(score), 6) as mean_score, round(max(score), 6) as max_score, "
    "count(*) filter (score > 9e-1) as n_outliers, true as quantiles_within_bound from s group by product_line"
)
def score_sketches_over_months(spark, sf_dir):
    """Scores sketched and stored by month, one month written twice; a question over four years."""
    score = decisions.evaluate(regimes.risk_budget().decisions, monoids.SCORE)
    dates = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("proposal_id"), F.trunc("o_orderdate", "MM").alias("month")
    )
    scored = bindings.underwriting(spark, sf_dir).withColumn("score", score).join(dates, "proposal_id")
    by, path = ["product_line"], scratch.new_path(spark, "sketches")
    months = score_sketches.daily(scored, by, F.col("month"), F.col("score"))
    score_sketches.store(months, path)
    score_sketches.store(months.where("day = '1994-01-01'"), path)
    span = "{0} >= '1993-01-01' and {0} < '1997-01-01'"
    merged = score_sketches.merge(spark.read.parquet(path).where(span.format("day")), by)
    found = score_sketches.statistics(merged, by, {"lower": 0.25, "upper": 0.9})
    # Ranks of the quantiles found, counted over all scores of the span.
    asked = {"median_score": 0.5, "lower": 0.25, "upper": 0.9}
    pairs = scored.where(span.format("month")).select(*by, "score").join(found.select(*by, *asked), by)
    ranks = pairs.groupBy(*by).agg(
        *[F.avg((F.col("score") < F.col(q)).cast("double")).alias(f"{q}_low") for q in asked],
        *[F.avg((F.col("score") <= F.col(q)).cast("double")).alias(f"{q}_high") for q in asked],
    )
    bound, within = score_sketches.rank_error(), F.lit(True)
    for q, place in asked.items():
        within = within & (F.col(f"{q}_low") <= place + bound) & (F.col(f"{q}_high") >= place - bound)
    return found.join(ranks, by).select(
        *by, "n", r6("mean_score").alias("mean_score"), r6("max_score").alias("max_score"), "n_outliers",
        within.alias("quantiles_within_bound"),
    )


# Columns are parts; each is the source of two others, so ways branch, meet again and close to cycles.
_LINEAGE = """select p_partkey as source, p_partkey * 2 % (select max(p_partkey) from part) as target from part
union all select p_partkey, (p_partkey * 3 + 1) % (select max(p_partkey) from part) from part where p_size % 2 = 0"""
_OWN = """select p_partkey as field, case when p_size > 48 then 'direct' when p_size > 47 then 'quasi' when p_size > 45 then 'sensitive' end as category,
  case when p_size % 3 = 0 then 'GLBA' when p_size % 3 = 1 then 'HIPAA' else 'CCPA' end as regime from part where p_size > 44"""


@query(
    f"""with recursive e as ({_LINEAGE}), l as ({_OWN}),
t(field, tag) as (select field, category from l where category is not null union select field, regime from l
  union select e.target, t.tag from t join e on e.source = t.field)
select field, case min(case tag when 'direct' then 1 when 'quasi' then 2 when 'sensitive' then 3 end)
    when 1 then 'direct' when 2 then 'quasi' when 3 then 'sensitive' end as category,
  coalesce(string_agg(tag, ',' order by tag) filter (tag in ('GLBA', 'HIPAA', 'CCPA')), '') as regimes
from t group by field"""
)
def inherited_labels(spark, sf_dir):
    bindings.tables(spark, sf_dir, "part")
    own = spark.sql(_OWN).withColumn("regimes", F.array("regime")).drop("regime")
    labels = lineage.inherited_labels(own, spark.sql(_LINEAGE))
    return labels.withColumn("regimes", F.array_join("regimes", ","))
