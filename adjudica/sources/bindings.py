"""Business tables derived from the test tables (customer, orders, events, documents).

Each binding is a list of SQL expressions that Spark and DuckDB read alike, so the same text
builds the input of a query and of its check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PROPOSALS = """
select c_custkey as proposal_id,
       case when c_mktsegment in ('BUILDING', 'MACHINERY') then 'entity' else 'individual' end as holder_kind,
       c_name as holder_name,
       c_acctbal as premium,
       lpad(cast((c_custkey * 7919) % 100000 as string), 5, '0') as zip_code,
       cast(16 + c_custkey % 70 as int) as age,
       cast(case when c_custkey % 97 = 0 then null when c_custkey % 89 = 0 then 99 else 1 end as int) as schema_version,
       date '2026-04-30' as schema_effective_date,
       c_custkey % 53 = 0 as erased
from customer
"""

UNDERWRITING = """
select o_orderkey as proposal_id,
       o_totalprice / 1e1 as premium,
       cast(5000 * (1 + o_orderkey % 40) as double) as coverage,
       o_totalprice / 1e1 * cast(3 + o_orderkey % 8 as double) / 1e1 as expected_claim,
       case c_nationkey % 3 when 0 then 'CA' when 1 then 'NY' else 'TX' end as jurisdiction,
       case o_orderkey % 4 when 0 then 'Auto' when 1 then 'Health' when 2 then 'Life' else 'PropertyCasualty' end as product_line,
       split(case o_orderkey % 6 when 0 then 'driving_record,race' when 1 then 'driving_record,credit_score'
             when 2 then 'miles_driven,sex,race' else 'driving_record,miles_driven' end, ',') as rating_factors,
       o_orderkey % 11 <> 0 as consent,
       case when o_orderkey % 5 = 0 then cast(null as double) else o_totalprice / 1e1 * cast(6 + o_orderkey % 9 as double) / 1e1 end as prior_premium,
       cast(35 + o_orderkey % 60 as double) / 1e2 as explainability_score,
       cast(o_orderkey % 10 as double) / 1e1 as cession
from orders join customer on o_custkey = c_custkey
"""

DEMO_PROPOSALS = """
select c_custkey as proposal_id, c_name as holder, c_acctbal as premium_observed,
       split(case c_custkey % 5 when 0 then 'race,age' when 1 then 'religion,origin,race'
             when 2 then 'origin' else 'age,zip' end, ',') as risk_factors
from customer
"""

# Sentences rendered from proposals, and the documents as they are.
RAW_TEXTS = """
select concat('p', cast(c_custkey as string)) as text_id, c_custkey * 2 as seq,
       concat('Holder: ', translate(c_name, '#0123456789', ' abcdefghij'), '. Premium: $',
              cast(cast(floor(c_acctbal) as bigint) as string), '. ZIP ',
              lpad(cast((c_custkey * 7919) % 100000 as string), 5, '0'), '. Age: ',
              cast(16 + c_custkey % 70 as string), '.') as text
from customer
union all
select concat('d', cast(doc_id as string)) as text_id, doc_id * 2 + 1 as seq, text from documents
"""

OBSERVATIONS = """
select concat('u', cast(user_id as string)) as learner_id, ts, event_id, value as observation,
       25e0 as sigma2, 50e0 as mu0, 5e-1 as kappa0
from events
"""

POINTS = """
select concat('u', cast(user_id as string)) as learner_id, ts, event_id,
       value / 1e2 as x0, 1e0 as x1, 3e0 * value / 1e2 + 2e0 as y
from events
"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Expose test tables as temporary views."""
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "customer")
    return spark.sql(PROPOSALS)


def underwriting(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "orders", "customer")
    return spark.sql(UNDERWRITING)


def demo_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "customer")
    return spark.sql(DEMO_PROPOSALS)


def raw_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "customer", "documents")
    return spark.sql(RAW_TEXTS)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "events")
    return spark.sql(OBSERVATIONS)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "events")
    return spark.sql(POINTS)
