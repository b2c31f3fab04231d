"""Dispatch by schema version, quarantine, cross-version rows, compatibility."""

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from adjudica import schemas
from adjudica.operators import versions
from adjudica.registry import query, r6
from adjudica.registry.tables import plain
from adjudica.sources import bindings

# Rows as they arrive from a loose feed: numbers as text, some of them malformed.
_FEED = f"""select proposal_id, holder_kind, holder_name,
  case when age = 20 then 'n/a' else cast(cast(floor(premium) as bigint) as string) end as premium,
  zip_code, case when age = 30 then '30.5' when age = 31 then null else cast(age as string) end as age,
  schema_version, schema_effective_date, erased
from ({bindings.PROPOSALS}) q"""

_CHECKED = f"""with f as ({_FEED}), c as (select *,
  try_cast(premium as double) as premium_value,
  case when regexp_matches(age, '^[0-9]+$') then try_cast(age as int) end as age_value from f),
d as (select *, case when schema_version is null then 'missing schema_version'
  when schema_version <> 1 then 'unknown schema version'
  when premium_value is null or age_value is null then 'validation failed' end as reason,
  case when schema_version is null then '' when schema_version <> 1 then 'known versions: [1]'
  else concat_ws('; ', case when premium_value is null then 'premium: not a double' end,
    case when age is null then 'age: missing' when age_value is null then 'age: not a int' end) end as detail from c)
"""


def feed(spark, sf_dir):
    bindings.tables(spark, sf_dir, "customer")
    return spark.sql(_FEED)


def dispatched(spark, sf_dir):
    return versions.dispatch(feed(spark, sf_dir), keep=["proposal_id"])


@query(
    _CHECKED + "select proposal_id, holder_kind, holder_name, round(premium_value, 6) as premium, zip_code, "
    "age_value as age, schema_version, cast(schema_effective_date as varchar) as schema_effective_date, erased "
    "from d where reason is null"
)
def dispatch_valid(spark, sf_dir):
    return plain(dispatched(spark, sf_dir).valid[1], "proposal_id")


@query(
    _CHECKED + "select proposal_id, schema_version as schema_version_seen, reason, detail from d where reason is not null"
)
def dispatch_quarantined(spark, sf_dir):
    return dispatched(spark, sf_dir).quarantined.drop("raw_row")


@query(_CHECKED + "select proposal_id, detail from d where reason = 'validation failed'")
def validate_columns(spark, sf_dir):
    df = feed(spark, sf_dir).where("schema_version = 1")
    _, errors = versions.validate_columns(df, schemas.PROPOSAL)
    return df.select("proposal_id", errors.alias("detail")).where("detail <> ''")


@query(
    "select c_custkey as proposal_id, 1 as schema_version, 'individual' as holder_kind, "
    "'2026-04-30' as schema_effective_date, false as erased from customer"
)
def stamp_default(spark, sf_dir):
    df = bindings.proposals(spark, sf_dir).drop(
        "holder_kind", "schema_version", "schema_effective_date", "erased"
    )
    parted = versions.dispatch(
        versions.stamp_default(df), keep=["proposal_id"]
    )
    return parted.valid[1].select(
        "proposal_id",
        "schema_version",
        "holder_kind",
        F.col("schema_effective_date").cast("string").alias("schema_effective_date"),
        "erased",
    )


@query(
    _CHECKED + """select concat('q', cast(proposal_id as varchar)) as quarantine_id, '2026-05-01 06:00:00' as quarantined_at,
  schema_version as schema_version_seen, reason, zip_code as payload_zip, premium as payload_premium from d where reason is not null"""
)
def quarantine_rows(spark, sf_dir):
    rows = versions.to_quarantine(
        dispatched(spark, sf_dir).quarantined,
        at=F.lit("2026-05-01 06:00:00").cast("timestamp_ntz"),
        row_id=F.concat(F.lit("q"), F.col("proposal_id")),
    )
    return rows.select(
        "quarantine_id",
        F.col("quarantined_at").cast("string").alias("quarantined_at"),
        "schema_version_seen",
        "reason",
        F.get_json_object("raw_payload", "$.zip_code").alias("payload_zip"),
        F.get_json_object("raw_payload", "$.premium").alias("payload_premium"),
    )


@query(
    _CHECKED + """select count(*) as n_input, count(*) filter (reason is null) as n_valid,
  count(*) filter (reason is not null) as n_quarantined,
  count(*) filter (reason = 'missing schema_version') as n_missing,
  count(*) filter (reason = 'unknown schema version') as n_unknown,
  count(*) filter (reason = 'validation failed') as n_invalid from d"""
)
def dispatch_counts(spark, sf_dir):
    return versions.dispatch_counts(dispatched(spark, sf_dir))


PROPOSAL_V2 = StructType(
    [*schemas.PROPOSAL.fields, schemas.field("policy_term_months", IntegerType(), default=None)]
)


@query(
    f"""with p as ({bindings.PROPOSALS}), v as (select *, case when age < 40 then 1 else 2 end as v from p)
select proposal_id, round(premium, 6) as premium, v as schema_version, erased,
  case when v = 2 then 12 + age % 3 end as policy_term_months from v"""
)
def across_versions(spark, sf_dir):
    df = bindings.proposals(spark, sf_dir).withColumns(
        {
            "schema_version": F.when(F.col("age") < 40, 1).otherwise(2),
            "policy_term_months": (12 + F.col("age") % 3).cast("int"),
        }
    )
    registry = versions.known_versions(versions.FIRST, versions.Version(2, "2027-01-01", PROPOSAL_V2))
    parted = versions.dispatch(df, registry, keep=["proposal_id"])
    return parted.merged.select(
        "proposal_id", r6("premium").alias("premium"), "schema_version", "erased", "policy_term_months"
    )


# Two schema snapshots read off the parts table: brands as models, part types as fields.
_SNAPSHOTS = {
    "old": "select p_brand as model, p_type as field, case when count(*) % 3 = 0 then 'int' else 'string' end as type, "
    "count(*) % 2 = 0 as required from part where p_size <= 40 and p_brand <> 'Brand#11' and p_type <> 'PROMO' group by p_brand, p_type",
    "new": "select p_brand as model, p_type as field, case when count(*) % 3 = 0 then 'int' else 'string' end as type, "
    "count(*) % 2 = 0 as required from part where p_size >= 10 and p_brand <> 'Brand#22' and p_type <> 'SMALL' group by p_brand, p_type",
}

_DIFF = f"""with o as ({_SNAPSHOTS['old']}), n as ({_SNAPSHOTS['new']}),
om as (select distinct model from o), nm as (select distinct model from n),
f as (select coalesce(o.model, n.model) as model, coalesce(o.field, n.field) as field, o.type as ot, n.type as nt,
  o.required as oreq, n.required as nreq from o full join n on o.model = n.model and o.field = n.field
  where coalesce(o.model, n.model) in (select model from om) and coalesce(o.model, n.model) in (select model from nm)),
d as (select model, cast(null as varchar) as field, 'additive' as kind, 'model added' as change from nm where model not in (select model from om)
 union all select model, null, 'breaking', 'model removed' from om where model not in (select model from nm)
 union all select model, field, 'breaking', 'required field added' from f where oreq is null and nreq
 union all select model, field, 'additive', 'optional field added' from f where oreq is null and not nreq
 union all select model, field, 'breaking', 'field removed' from f where nreq is null
 union all select model, field, 'breaking', concat('type changed from ', ot, ' to ', nt) from f where ot <> nt
 union all select model, field, 'additive', 'required to optional' from f where oreq and not nreq
 union all select model, field, 'breaking', 'optional to required' from f where not oreq and nreq)
"""


def snapshot_diff(spark, sf_dir):
    bindings.tables(spark, sf_dir, "part")
    return versions.diff(spark.sql(_SNAPSHOTS["old"]), spark.sql(_SNAPSHOTS["new"]))


@query(_DIFF + "select * from d")
def schema_diff(spark, sf_dir):
    return snapshot_diff(spark, sf_dir)


@query(
    _DIFF + """select count(*) as n_changes, count(*) filter (kind = 'breaking') as n_breaking,
  count(*) filter (kind = 'breaking') = 0 as passed,
  case when count(*) = 0 then 'OK: no schema changes' when count(*) filter (kind = 'breaking') = 0 then 'OK: additive'
    else 'BREAKING: not acknowledged' end as summary from d"""
)
def schema_verdict(spark, sf_dir):
    return versions.verdict(snapshot_diff(spark, sf_dir))
