"""Tables, projections, holder shapes and views."""

from pyspark.sql import functions as F

from adjudica import schemas
from adjudica.operators import learners, regimes, views
from adjudica.operators.decisions import adm_joint
from adjudica.plans import outcomes
from adjudica.registry import names, query, r6
from adjudica.sources import bindings, scratch, tables

_P = f"with p as ({bindings.PROPOSALS}) "
_PLAIN = """proposal_id, holder_kind, holder_name, round(premium, 6) as premium, zip_code, age,
  schema_version, cast(schema_effective_date as varchar) as schema_effective_date, erased"""


def plain(df, *extra):
    """Proposal columns in a form both engines print alike."""
    return df.select(
        *extra,
        "holder_kind",
        "holder_name",
        r6("premium").alias("premium"),
        "zip_code",
        "age",
        "schema_version",
        F.col("schema_effective_date").cast("string").alias("schema_effective_date"),
        "erased",
    )


@query("select c_custkey, c_name, c_nationkey, round(c_acctbal, 6) as c_acctbal, c_mktsegment from customer")
def table_read(spark, sf_dir):
    df = tables.read_table(spark, f"{sf_dir}/customer.parquet")
    return df.withColumn("c_acctbal", r6("c_acctbal"))


@query(_P + f"select {_PLAIN} from p union all select {_PLAIN} from p where erased = false")
def table_append_by_name(spark, sf_dir):
    df = bindings.proposals(spark, sf_dir)
    path = scratch.new_path(spark, "append")
    tables.write_table(df, path)
    # Columns arrive in another order and still land in the right place.
    tables.write_table(df.where(views.visible()).select(*reversed(df.columns)), path, "append")
    return plain(tables.read_table(spark, path), "proposal_id")


_JOINT_P = """violations as (
  select p.*, case when premium <= 0 then 'premium' else '' end as rules,
    (case when zip_code like '9%' then 5e-1 else 0e0 end) + (case when age < 25 then 6e-1 else 0e0 end) as score
  from p where erased = false)"""


def joint_proposals(spark, sf_dir):
    df = bindings.proposals(spark, sf_dir)
    return outcomes.judged(df, regimes.proposal_joint(0.5, 0.6).decisions, adm_joint(1.0))


@query(
    f"with p as ({bindings.PROPOSALS}), {_JOINT_P} select proposal_id, holder_name, "
    "round(premium, 6) as premium, rules, round(score, 6) as score from violations where rules = '' and score < 1e0"
)
def contracts_parquet_sink(spark, sf_dir):
    contracts = outcomes.split_outcomes(joint_proposals(spark, sf_dir)).contracts
    path = scratch.new_path(spark, "contracts")
    tables.write_contracts(contracts, path)
    return tables.read_table(spark, path).select(
        "proposal_id", "holder_name", r6("premium").alias("premium"),
        names().alias("rules"), r6("payload.score").alias("score"),
    )


@query(_P + f"select {_PLAIN.replace('proposal_id, ', '')} from p")
def stg_proposals(spark, sf_dir):
    return plain(views.stg_proposals(bindings.proposals(spark, sf_dir)))


_Q = f"""with p as ({bindings.PROPOSALS})
select concat('q', cast(proposal_id as varchar)) as quarantine_id,
  '2026-05-01 00:00:00' as quarantined_at, schema_version as schema_version_seen,
  case when schema_version is null then 'missing schema_version' else 'unknown schema version' end as reason,
  case when schema_version is null then '' else 'known versions: [1]' end as detail
from p where schema_version is null or schema_version <> 1"""


@query(_Q)
def stg_quarantine(spark, sf_dir):
    from adjudica.operators import versions

    df = bindings.proposals(spark, sf_dir)
    parted = versions.dispatch(df, keep=["proposal_id"])
    raw = versions.to_quarantine(
        parted.quarantined,
        at=F.lit("2026-05-01 00:00:00").cast("timestamp_ntz"),
        row_id=F.concat(F.lit("q"), F.col("proposal_id")),
    )
    return views.stg_quarantine(raw).select(
        "quarantine_id", F.col("quarantined_at").cast("string").alias("quarantined_at"),
        "schema_version_seen", "reason", "detail",
    )


@query(
    f"""with o as ({bindings.OBSERVATIONS}),
log as (select learner_id, ts from o union all select learner_id, ts from o where observation > 5e1)
select learner_id, count(*) as n, count(distinct ts) as n_distinct from log group by learner_id"""
)
def observations_append(spark, sf_dir):
    rows = bindings.observations(spark, sf_dir).select(*schemas.OBSERVATIONS.names)
    again = rows.where("observation > 5e1").select(*reversed(rows.columns))
    log = learners.append_observations(again, rows)
    distinct = learners.append_observations(again, rows, dedup=True)
    n = log.groupBy("learner_id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(distinct.groupBy("learner_id").agg(F.count(F.lit(1)).alias("n_distinct")), "learner_id")


@query(_P + "select holder_kind, holder_name, round(premium, 6) as premium, zip_code, age from p")
def domain_fields(spark, sf_dir):
    df = bindings.proposals(spark, sf_dir).select(*schemas.domain_fields(schemas.PROPOSAL))
    return df.withColumn("premium", r6("premium"))


@query(_P + "select holder_name, round(premium, 6) as premium, zip_code, age from p")
def extraction_fields(spark, sf_dir):
    df = bindings.proposals(spark, sf_dir).select(*schemas.extraction_fields(schemas.PROPOSAL))
    return df.withColumn("premium", r6("premium"))


@query(
    "select case when c_mktsegment = 'BUILDING' then 'individual' else 'entity' end as kind, c_name as name, "
    "c_mktsegment as holder_kind, c_custkey from customer"
)
def holder_typed(spark, sf_dir):
    df = tables.read_table(spark, f"{sf_dir}/customer.parquet").select(
        "c_custkey", "c_mktsegment", F.col("c_name").alias("holder_name")
    )
    tagged = df.withColumn(
        "holder_kind", F.when(F.col("c_mktsegment") == "BUILDING", "individual").otherwise(F.col("c_mktsegment"))
    )
    return schemas.with_holder(tagged).select(
        "holder.kind", "holder.name", F.col("c_mktsegment").alias("holder_kind"), "c_custkey"
    )


@query(_P + "select proposal_id, holder_kind, holder_name from p")
def holder_flat(spark, sf_dir):
    df = schemas.with_holder(bindings.proposals(spark, sf_dir)).select("proposal_id", "holder")
    return schemas.flatten_holder(df)


@query(
    _P + "select proposal_id, erased from (select proposal_id, case when schema_version is null then null "
    "else erased end as erased from p) where erased = false"
)
def visible_rows(spark, sf_dir):
    df = bindings.proposals(spark, sf_dir)
    marked = df.withColumn("erased", F.when(F.col("schema_version").isNotNull(), F.col("erased")))
    return marked.where(views.visible()).select("proposal_id", "erased")


@query(_P + f"select {_PLAIN.replace('proposal_id, ', '')} from p where erased = false")
def v_proposals(spark, sf_dir):
    return plain(views.v_proposals(views.stg_proposals(bindings.proposals(spark, sf_dir))))


@query(
    f"""with p as ({bindings.PROPOSALS}), {_JOINT_P}
select {_PLAIN.replace('proposal_id, ', '')}, concat('[[],', cast(score as varchar), ']') as payload_json
from violations where rules = '' and score < 1e0"""
)
def v_contracts(spark, sf_dir):
    contracts = outcomes.split_outcomes(joint_proposals(spark, sf_dir)).contracts
    return plain(views.v_contracts(contracts), "payload_json")
