"""Tokens, masks and erasure."""

from pyspark.sql import functions as F

from adjudica import schemas
from adjudica.functions import permutation
from adjudica.functions.tokens import token
from adjudica.operators import erasure, file_erasure, privacy, sealed, views
from adjudica.registry import query, r6
from adjudica.registry.tables import plain
from adjudica.sources import bindings, file_table, scratch


def _token_sql(column: str, transformation: str) -> str:
    h = f"sha256(concat('{transformation}::', {column}))"
    hexes = "'0123456789abcdef'"
    byte = (
        f"(16 * (instr({hexes}, substr({h}, 2 * (i % 32) + 1, 1)) - 1) + instr({hexes}, substr({h}, 2 * (i % 32) + 2, 1)) - 1)"
    )
    ch = f"substr({column}, cast(i + 1 as int), 1)"
    return (
        f"array_to_string(list_transform(range(0, length({column})), lambda i: "
        f"case when regexp_matches({ch}, '[A-Z]') then chr(cast(65 + {byte} % 26 as int)) "
        f"when regexp_matches({ch}, '[a-z]') then chr(cast(97 + {byte} % 26 as int)) "
        f"when regexp_matches({ch}, '[0-9]') then cast({byte} % 10 as varchar) else {ch} end), '')"
    )


@query(
    f"select c_custkey, {_token_sql('c_name', 'default')} as by_default, {_token_sql('c_mktsegment', 'segments')} as segment from customer"
)
def format_preserving_token(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        "c_custkey",
        token(F.col("c_name")).alias("by_default"),
        token(F.col("c_mktsegment"), "segments").alias("segment"),
    )


_P = f"with p as ({bindings.PROPOSALS})"


@query(
    f"{_P} select proposal_id, holder_kind, {_token_sql('holder_name', 'holder_name')} as holder_name, zip_code, age from p"
)
def tokenise(spark, sf_dir):
    df = privacy.tokenise(bindings.proposals(spark, sf_dir), schemas.PROPOSAL)
    return df.select("proposal_id", "holder_kind", "holder_name", "zip_code", "age")


@query(
    f"{_P} select proposal_id, holder_kind, case when holder_kind = 'individual' then {_token_sql('holder_name', 'holder_name')} else holder_name end as holder_name from p"
)
def tokenise_by_branch(spark, sf_dir):
    df = privacy.tokenise(bindings.proposals(spark, sf_dir), schemas.PROPOSAL, by_branch=True)
    return df.select("proposal_id", "holder_kind", "holder_name")


_MAP = f"""select 'c_name' as transformation, {_token_sql('c_name', 'c_name')} as token, c_name as plaintext from customer
union select 'c_mktsegment', {_token_sql('c_mktsegment', 'c_mktsegment')}, c_mktsegment from customer"""


@query(_MAP)
def token_map(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return privacy.token_map(df, ["c_name", "c_mktsegment"])


def _reversal(spark, sf_dir):
    """Every proposal tokenised, and a map that knows the holders with a positive premium."""
    df = bindings.proposals(spark, sf_dir)
    return (
        privacy.tokenise(df, schemas.PROPOSAL),
        privacy.token_map(df.where("premium > 0"), ["holder_name"]),
    )


@query(f"{_P} select proposal_id, case when premium > 0 then holder_name end as holder_name from p")
def detokenise(spark, sf_dir):
    out = privacy.detokenise(*_reversal(spark, sf_dir), "holder_name")
    return out.select("proposal_id", "holder_name")


@query(f"{_P} select distinct {_token_sql('holder_name', 'holder_name')} as holder_name from p where premium <= 0")
def unknown_tokens(spark, sf_dir):
    return privacy.unknown_tokens(*_reversal(spark, sf_dir), "holder_name")


@query(
    f"""with m as (select distinct {_token_sql('area', 'area')} as token, area as plaintext from
  (select lpad(cast((c_custkey * 7919) % 1000 as varchar), 3, '0') as area from customer))
select 'area' as transformation, token, count(*) as n_plaintexts from m group by token having count(*) > 1"""
)
def token_collisions(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    areas = df.selectExpr("lpad(cast((c_custkey * 7919) % 1000 as string), 3, '0') as area")
    return privacy.collisions(privacy.token_map(areas, ["area"]))


@query(
    f"""{_P}, r as (select p.*, unnest(['CONSUMER', 'ANALYST', 'PRIVACY_OFFICER']) as reader from p)
select proposal_id, reader, case when reader = 'PRIVACY_OFFICER' then holder_name else '***' end as holder_name,
  case when reader in ('ANALYST', 'PRIVACY_OFFICER') then zip_code end as zip_code,
  case when reader in ('ANALYST', 'PRIVACY_OFFICER') then age end as age, round(premium, 6) as premium from r"""
)
def mask_by_role(spark, sf_dir):
    df = bindings.proposals(spark, sf_dir)
    readers = F.array(*[F.lit(r) for r in ("CONSUMER", "ANALYST", "PRIVACY_OFFICER")])
    each = df.select("*", F.explode(readers).alias("reader"))
    masked = privacy.mask_frame(each, schemas.PROPOSAL, F.array("reader"))
    return masked.select(
        "proposal_id", "reader", "holder_name", "zip_code", "age", r6("premium").alias("premium")
    )


@query(
    f"{_P} select proposal_id, '***' as holder_name, zip_code, age from p union all "
    "select proposal_id, holder_name, zip_code, age from p"
)
def mask_by_tier(spark, sf_dir):
    df = bindings.proposals(spark, sf_dir)
    shown = ["proposal_id", "holder_name", "zip_code", "age"]
    analyst = privacy.mask_frame(df, schemas.PROPOSAL, {"ANALYST"}, "standard").select(shown)
    local = privacy.mask_frame(df, schemas.PROPOSAL, {"ANALYST"}, "enterprise").select(shown)
    return analyst.unionByName(local)


_KEY = "registry-key"


def _round_sql() -> str:
    """One round of the permutation over column s, whose hash is h: the same steps as on the other side."""
    ch = "substr(s, cast(i + 1 as int), 1)"
    drawn = " + ".join(
        f"{16 ** (3 - k)} * (instr('0123456789abcdef', substr(h, cast(4 * (i % 16) + {k + 1} as int), 1)) - 1)" for k in range(4)
    )
    cases = " ".join(
        f"when {ch} between '{first}' and '{chr(ord(first) + count - 1)}' then chr(cast({ord(first)} + (unicode({ch}) - {ord(first)} + {drawn}) % {count} as int))"
        for first, count in permutation.CLASSES
    )
    return f"array_to_string(list_transform(range(0, length(s)), lambda i: case when (i + r) % 2 <> 0 then {ch} {cases} else {ch} end), '')"


_MASKED_CASES = " ".join(
    f"when substr(s, cast(i + 1 as int), 1) between '{first}' and '{chr(ord(first) + count - 1)}' then '{first}'"
    for first, count in permutation.CLASSES
)
_MASKED = f"array_to_string(list_transform(range(0, length(s)), lambda i: case when (i + r) % 2 <> 0 then substr(s, cast(i + 1 as int), 1) {_MASKED_CASES} else substr(s, cast(i + 1 as int), 1) end), '')"
_PERMUTED = f"""{_P.replace("with p as", "with recursive p as", 1)}, f as (
  select proposal_id, holder_name as s, 0 as r from p
  union all
  select proposal_id, {_round_sql()} as s, r + 1
  from (select *, sha256(concat('{_KEY}|', cast(r as varchar), '|', {_MASKED})) as h from f where r < {permutation.ROUNDS}) x)"""


@query(_PERMUTED + f" select proposal_id, s as holder_name from f where r = {permutation.ROUNDS}")
def permute_names(spark, sf_dir):
    """Names as tokens of a keyed permutation."""
    names = bindings.proposals(spark, sf_dir).select("proposal_id", "holder_name")
    return privacy.permute(names, schemas.PROPOSAL, _KEY)


@query(_P + " select proposal_id, holder_name from p")
def restore_names(spark, sf_dir):
    """Tokens taken back by the key, without a map."""
    names = bindings.proposals(spark, sf_dir).select("proposal_id", "holder_name")
    tokens = privacy.permute(names, schemas.PROPOSAL, _KEY)
    return privacy.restore(tokens, schemas.PROPOSAL, _KEY)


@query(_P + " select count(distinct holder_name) as names, count(distinct holder_name) as tokens from p")
def permuted_collisions(spark, sf_dir):
    """As many different tokens as names."""
    names = bindings.proposals(spark, sf_dir).select("holder_name")
    both = permutation.permute_rows(names, {"token": "holder_name"}, _KEY)
    return both.agg(F.count_distinct("holder_name").alias("names"), F.count_distinct("token").alias("tokens"))


# Requests: holders deep in debt by name, suppliers' areas by ZIP code, suppliers' names (unknown
# as holders), and one whole age. Some of the names were erased before.
_REQUESTS = """select 'holder_name' as where_column, c_name as where_value from customer where c_acctbal < -5e2
union all select 'zip_code', lpad(cast((s_suppkey * 7919) % 100000 as string), 5, '0') from supplier where s_acctbal > 5e3
union all select 'holder_name', s_name from supplier where s_acctbal > 0
union all select 'age', cast(16 + s_nationkey as string) from supplier where s_acctbal < -8e2"""
_AUDIT = """select concat('old-', c_name) as erasure_id, timestamp '2026-01-01 00:00:00' as erased_at, 'ops' as erased_by,
  'proposals' as table_name, 'holder_name' as where_column, c_name as where_value, 'request' as reason,
  '[]' as pii_fields_nulled, '{}' as pre_erasure_snapshot from customer where c_acctbal between -6e2 and -5e2"""

_ERASURE = f"""{_P}, q as (select distinct * from ({_REQUESTS})), a as ({_AUDIT}),
fresh as (select * from q where not exists (select 1 from a where a.where_column = q.where_column and a.where_value = q.where_value)),
hit as (select p.proposal_id, p.holder_name, f.where_column, f.where_value from p join fresh f on
  (f.where_column = 'holder_name' and p.holder_name = f.where_value) or (f.where_column = 'zip_code' and p.zip_code = f.where_value)
  or (f.where_column = 'age' and cast(p.age as varchar) = f.where_value)),
gone as (select distinct proposal_id from hit)
"""


def _batch(spark, sf_dir):
    df = bindings.proposals(spark, sf_dir)
    bindings.tables(spark, sf_dir, "supplier")
    audit = spark.sql(_AUDIT).withColumn("erased_at", F.col("erased_at").cast("timestamp_ntz"))
    return erasure.erase(
        df,
        spark.sql(_REQUESTS),
        audit,
        schemas.PROPOSAL,
        table_name="proposals",
        erased_by="privacy-desk",
        reason="subject request",
        at=F.lit("2026-06-01 00:00:00").cast("timestamp_ntz"),
        erasure_id=F.concat_ws("-", F.lit("e"), "where_column", "where_value"),
    ), audit


@query(
    _ERASURE + """select proposal_id, holder_kind, case when g then null else holder_name end as holder_name, round(premium, 6) as premium,
  case when g then null else zip_code end as zip_code, case when g then null else age end as age, schema_version,
  cast(schema_effective_date as varchar) as schema_effective_date, erased or g as erased
from (select p.*, proposal_id in (select proposal_id from gone) as g from p)"""
)
def erase(spark, sf_dir):
    return plain(_batch(spark, sf_dir)[0].table, "proposal_id")


def _by_files(spark, sf_dir):
    """The same batch over a table of 64 files with an index of names and ZIP codes; ages have none."""
    df = bindings.proposals(spark, sf_dir).withColumn("shelf", F.col("proposal_id") % 64)
    table = file_table.create(df, scratch.new_path(spark, "file-table"), ["holder_name", "zip_code"], partition_by=["shelf"])
    bindings.tables(spark, sf_dir, "supplier")
    audit = spark.sql(_AUDIT).withColumn("erased_at", F.col("erased_at").cast("timestamp_ntz"))
    # Without the requests by age, which no index covers.
    requests = spark.sql(_REQUESTS).where("where_column <> 'age'")
    before = table.files()
    result = file_erasure.erase(
        table, requests, audit, schemas.PROPOSAL, "proposals", erased_by="privacy-desk", reason="subject request",
        at=F.lit("2026-06-01 00:00:00").cast("timestamp_ntz"),
        erasure_id=F.concat_ws("-", F.lit("e"), "where_column", "where_value"),
    )
    file_erasure.publish(table, result, scratch.new_path(spark, "file-audit"))
    return table, result, before


_BY_FILES = _ERASURE.replace(f"({_REQUESTS})", f"(select * from ({_REQUESTS}) r where where_column <> 'age')")


@query(
    _BY_FILES + """select proposal_id, holder_kind, case when g then null else holder_name end as holder_name, round(premium, 6) as premium,
  case when g then null else zip_code end as zip_code, case when g then null else age end as age, schema_version,
  cast(schema_effective_date as varchar) as schema_effective_date, erased or g as erased
from (select p.*, proposal_id in (select proposal_id from gone) as g from p)"""
)
def erase_by_files(spark, sf_dir):
    """The table after an erasure that wrote only the files with a subject anew."""
    return plain(_by_files(spark, sf_dir)[0].read(), "proposal_id")


@query(
    _BY_FILES + """select p.proposal_id % 64 as shelf, count(*) as n_rows, bool_or(p.proposal_id in (select proposal_id from gone)) as rewritten
from p group by all"""
)
def erasure_files_rewritten(spark, sf_dir):
    """Which of the table's files the erasure replaced: those with a subject, and no others."""
    table, _, before = _by_files(spark, sf_dir)
    kept = table.files().select("path", F.lit(True).alias("kept"))
    return before.join(kept, "path", "left").select(
        F.regexp_extract("path", "shelf=([0-9]+)", 1).cast("bigint").alias("shelf"), "n_rows", F.col("kept").isNull().alias("rewritten")
    )


@query(
    _ERASURE + """select q.where_column, q.where_value,
  case when a.erasure_id is not null then 'already_erased' when h.n > 0 then 'erased' else 'not_found' end as status,
  case when a.erasure_id is not null then a.erasure_id when h.n > 0 then concat('e-', q.where_column, '-', q.where_value) end as erasure_id,
  coalesce(h.n, 0) as n_rows
from q left join a using (where_column, where_value) left join (select where_column, where_value, count(*) as n from hit group by all) h using (where_column, where_value)"""
)
def erasure_statuses(spark, sf_dir):
    return _batch(spark, sf_dir)[0].statuses


@query(
    _ERASURE + """select concat('e-', where_column, '-', where_value) as erasure_id, '2026-06-01 00:00:00' as erased_at, 'privacy-desk' as erased_by,
  'proposals' as table_name, where_column, where_value, 'subject request' as reason,
  '["age", "holder_name", "zip_code"]' as pii_fields_nulled from hit group by where_column, where_value"""
)
def erasure_audit(spark, sf_dir):
    rows = views.v_audit_erasures(_batch(spark, sf_dir)[0].audit)
    return rows.withColumn("erased_at", F.col("erased_at").cast("string")).drop("pre_erasure_snapshot")


@query(
    _ERASURE + "select concat('e-', where_column, '-', where_value) as erasure_id, holder_name, proposal_id from hit"
)
def erasure_snapshots(spark, sf_dir):
    rows = _batch(spark, sf_dir)[0].snapshots
    return rows.select(
        "erasure_id",
        F.get_json_object("pre_erasure_snapshot", "$.holder_name").alias("holder_name"),
        F.get_json_object("pre_erasure_snapshot", "$.proposal_id").cast("bigint").alias("proposal_id"),
    )


@query(
    _ERASURE + "select proposal_id, p.holder_name from p join a on p.holder_name = a.where_value where not erased"
)
def erasure_still_matching(spark, sf_dir):
    """Subjects in the table although an audited request covers them."""
    audit = _batch(spark, sf_dir)[1]
    left = erasure.still_matching(bindings.proposals(spark, sf_dir), audit, "proposals")
    return left.select("proposal_id", "holder_name")


@query(
    f"""with audit as (select o_orderkey, o_orderdate, o_orderpriority from orders)
select concat('a', cast(o_orderkey as varchar)) as erasure_id, strftime(o_orderdate, '%Y-%m-%d') as day,
  o_orderpriority as reason from audit"""
)
def v_audit_erasures(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    audit = orders.select(
        F.concat(F.lit("a"), F.col("o_orderkey")).alias("erasure_id"),
        F.col("o_orderdate").alias("erased_at"),
        F.lit("ops").alias("erased_by"),
        F.lit("proposals").alias("table_name"),
        F.lit("holder_name").alias("where_column"),
        F.col("o_custkey").alias("where_value"),
        F.col("o_orderpriority").alias("reason"),
        F.lit("[]").alias("pii_fields_nulled"),
        F.lit("{}").alias("pre_erasure_snapshot"),
    )
    rows = views.v_audit_erasures(audit)
    return rows.select(
        "erasure_id", F.date_format("erased_at", "yyyy-MM-dd").alias("day"), "reason"
    )


@query(
    """select o_orderkey, case when c_acctbal < 0 then null else c_name end as holder_name, c_acctbal < 0 as erased
from orders join customer on o_custkey = c_custkey"""
)
def erasure_sweep(spark, sf_dir):
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    derived = orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        "o_orderkey", "c_custkey", F.col("c_name").alias("holder_name"), F.lit(False).alias("erased")
    )
    swept = erasure.sweep(derived, customers.where("c_acctbal < 0"), ["c_custkey"], schemas.PROPOSAL)
    return swept.select("o_orderkey", "holder_name", "erased")


@query(
    """select o_orderkey, case when o_orderdate::date + interval 7 year >= date '2001-06-01' then o_orderpriority end as pre_erasure_snapshot from orders"""
)
def snapshot_retention(spark, sf_dir):
    audit = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey",
        F.col("o_orderdate").alias("erased_at"),
        F.col("o_orderpriority").alias("pre_erasure_snapshot"),
    )
    kept = erasure.retain_snapshots(audit, F.lit("2001-06-01"))
    return kept.select("o_orderkey", "pre_erasure_snapshot")


@query(
    """select o_orderkey, o_custkey, case when o_orderdate::date + interval 7 year >= date '2001-06-15' and o_custkey <> (select min(o_custkey) from orders)
  then o_orderpriority end as pre_erasure_snapshot from orders"""
)
def sealed_retention(spark, sf_dir):
    """Snapshots under data keys of their subjects: some keys expire, one subject is forgotten."""
    audit = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").alias("erased_at"), F.col("o_orderpriority").alias("pre_erasure_snapshot")
    )
    keys = sealed.KeyStore(spark, scratch.new_path(spark, "keys"), F.lit(b"0123456789abcdef"), ["o_custkey"])
    keys.add(audit, as_of=F.lit("2000-01-01"))
    stored = scratch.materialise(keys.seal(audit), "sealed-audit")
    keys.expire(F.lit("2001-06-15"))
    keys.forget(audit.select(F.min("o_custkey").alias("o_custkey")).first().asDict())
    return keys.open(stored).select("o_orderkey", "o_custkey", "pre_erasure_snapshot")
