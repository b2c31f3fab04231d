"""Data checks."""

from pyspark.sql import functions as F

from adjudica.functions import costs
from adjudica.operators import checks, decisions, monoids, regimes, views
from adjudica.registry import query, r6
from adjudica.registry.texts import _TEXTS
from adjudica.sources import bindings

_P = f"with p as ({bindings.PROPOSALS})"
_SCORE = "(case when zip_code like '9%' then 5e-1 else 0e0 end) + (case when age < 25 then 3e-1 else 0e0 end)"


@query(
    f"{_P} select round(avg({_SCORE}), 6) as mean_score, count(*) as n_rows, avg({_SCORE}) < 6e-1 as passed from p"
)
def guardrail_stability(spark, sf_dir):
    value = decisions.evaluate(regimes.proposal_joint().decisions, monoids.JOINT)
    df = bindings.proposals(spark, sf_dir).select(value.alias("payload"))
    out = checks.guardrail_stability(df, F.col("payload.score"))
    return out.withColumn("mean_score", r6("mean_score"))


@query(
    _TEXTS + " select cast(sum(greatest(1, length(text) // 4 + 20)) as bigint) as total_tokens, cast(500000 as bigint) as cap, "
    "round(sum(greatest(1, length(text) // 4 + 20)) / 5e5, 6) as utilisation, sum(greatest(1, length(text) // 4 + 20)) / 5e5 < 9e-1 as passed from t"
)
def budget_utilisation(spark, sf_dir):
    texts = bindings.raw_texts(spark, sf_dir)
    out = checks.budget(texts, costs.extract_tokens(F.col("text"), 4), 500_000)
    return out.withColumn("utilisation", r6("utilisation"))


@query(
    f"{_P} select 'v_proposals' as view_name, cast(0 as bigint) as n_exposed, true as passed union all "
    "select 'stg_proposals', count(*) filter (erased), count(*) filter (erased) = 0 from p"
)
def views_hide_erased(spark, sf_dir):
    staged = views.stg_proposals(bindings.proposals(spark, sf_dir))
    return checks.views_hide_erased(
        {"v_proposals": views.v_proposals(staged), "stg_proposals": staged}
    )


@query(
    f"{_P} select 'holder_name' as \"column\", count(*) filter (holder_name is null) as n_null, count(*) filter (holder_name is null) = 0 as passed from p "
    "union all select 'schema_version', count(*) filter (schema_version is null), count(*) filter (schema_version is null) = 0 from p "
    "union all select 'premium', count(*) filter (premium is null), count(*) filter (premium is null) = 0 from p"
)
def not_null(spark, sf_dir):
    df = bindings.proposals(spark, sf_dir)
    return checks.not_null(df, ["holder_name", "schema_version", "premium"])


@query("select l_orderkey, l_partkey, count(*) as n from lineitem group by all having count(*) > 1")
def unique(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return checks.unique(df, ["l_orderkey", "l_partkey"])


@query(
    """with l as (select user_id, max(ts) as last_ts, (select max(ts) from events) as as_of from events group by user_id)
select user_id, round(date_diff('microsecond', last_ts, timestamp '2024-01-31 00:00:00') / 36e8, 6) as age_hours,
  case when date_diff('microsecond', last_ts, timestamp '2024-01-31 00:00:00') / 36e8 > 24 then 'fail'
    when date_diff('microsecond', last_ts, timestamp '2024-01-31 00:00:00') / 36e8 > 12 then 'warn' else 'pass' end as status from l"""
)
def freshness(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    out = checks.freshness(events, "ts", as_of, ["user_id"])
    return out.select("user_id", r6("age_hours").alias("age_hours"), "status")


# Column lists read off the parts table: brands as tables, part types as columns.
_DECLARED = "select p_brand as table_name, p_type as column, case when avg(p_size) > 2.4e1 then 'DOUBLE' else 'INTEGER' end as type from part where p_size <= 45 and p_brand <> 'Brand#11' group by p_brand, p_type"
_ACTUAL = "select p_brand as table_name, p_type as column, case when avg(p_size) > 2.6e1 then 'DOUBLE' else 'INTEGER' end as type from part where p_size > 5 and p_brand <> 'Brand#22' group by p_brand, p_type"


@query(
    f"""with d as ({_DECLARED.replace('as column', 'as "column"')}), a as ({_ACTUAL.replace('as column', 'as "column"')}),
j as (select table_name, "column", d.type as expected, a.type as actual from d full join a using (table_name, "column"))
select *, case when actual is null then 'missing' when expected is null then 'extra' else 'type' end as problem from j
where actual is null or expected is null or expected <> actual"""
)
def contract_drift(spark, sf_dir):
    bindings.tables(spark, sf_dir, "part")
    return checks.contract_drift(
        spark.sql(_DECLARED), spark.sql(_ACTUAL), on=("table_name", "column")
    )


@query(
    """with e as (select *, cast(ts as date) as day from events), m as (select max(day) as latest_day from e)
select cast(latest_day as varchar) as latest_day, (select count(*) from e where event_type = 'error' and day = latest_day) as n_quarantined,
  (select count(*) from e where event_type = 'error' and day = latest_day) = 0 as passed from m"""
)
def quarantine_latest(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("day", F.col("ts").cast("date"))
    out = checks.quarantine_latest(events.where("event_type = 'error'"), events)
    return out.withColumn("latest_day", F.col("latest_day").cast("string"))


@query(
    """with a as (select l_orderkey, min(l_shipdate) as erased_at from lineitem where l_linestatus = 'F' group by l_orderkey),
d as (select o_orderkey, date_diff('day', o_orderdate::date, coalesce(erased_at::date, date '1998-12-31')) as days from orders left join a on o_orderkey = l_orderkey)
select cast(o_orderkey as varchar) as where_value, cast(days as int) as days, days <= 45 as within_window from d"""
)
def erasure_latency(spark, sf_dir):
    same = [F.lit("orders").alias("table_name"), F.lit("o_orderkey").alias("where_column")]
    requests = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        *same,
        F.col("o_orderkey").cast("string").alias("where_value"),
        F.col("o_orderdate").alias("requested_at"),
    )
    audit = (
        spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        .where("l_linestatus = 'F'")
        .select(
            *same,
            F.col("l_orderkey").cast("string").alias("where_value"),
            F.col("l_shipdate").alias("erased_at"),
        )
    )
    out = checks.erasure_latency(requests, audit, F.lit("1998-12-31"))
    return out.select("where_value", "days", "within_window")
