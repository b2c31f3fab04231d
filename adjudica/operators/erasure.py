"""Right to erasure as a batch over a requests frame.

A request is ``(where_column, where_value)``. Applying a batch gives a new copy of the table with
the PII of matching rows nulled and the rows marked, one audit row per request carried out, and a
status per request. Values are data and never become part of a statement.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from adjudica.operators.privacy import pii_fields
from adjudica.sources.scratch import materialise, new_path
from adjudica.sources.tables import replace_folder, write_table

ERASED = "erased"
ALREADY = "already_erased"
NOT_FOUND = "not_found"

KEY = ["where_column", "where_value"]


class Erasure(NamedTuple):
    """Outcome of a batch.

    ``table``      the whole table after erasure
    ``audit``      audit rows for the requests carried out in this batch
    ``snapshots``  one row per erased row: its request and its content before the change
    ``statuses``   one row per request: erased, already_erased or not_found
    ``matched``    the rows that requests hit, as they were
    """

    table: DataFrame
    audit: DataFrame
    snapshots: DataFrame
    statuses: DataFrame
    matched: DataFrame


def check_columns(requests: DataFrame, schema: StructType) -> list[str]:
    """Columns the batch refers to. ``ValueError`` names one that the table does not have."""
    names = requests.select("where_column").distinct()
    bad = names.where(F.col("where_column").isNull() | ~F.col("where_column").isin(*schema.names))
    first_bad = bad.first()
    if first_bad is not None:
        raise ValueError(f"erasure by {first_bad[0]!r}: the table has no such column")
    # At most one value per column of the table.
    return sorted(r[0] for r in names.collect())


def prior_erasures(audit: DataFrame, table_name: str) -> DataFrame:
    """First audit entry of every request already carried out on a table."""
    return (
        audit.where(F.col("table_name") == table_name)
        .groupBy(*KEY)
        .agg(F.min_by("erasure_id", F.struct("erased_at", "erasure_id")).alias("prior_id"))
    )


def _matches(
    table: DataFrame, requests: DataFrame, columns: Sequence[str], flag: str, carry: Sequence[str] = ()
) -> DataFrame:
    """Table with an array of the requests hitting each row: at most one per column.

    One equi-join per column. The request side holds each value once, so rows never multiply;
    small request batches are broadcast at run time, and hot values are split by the skew join.
    """
    types = {f.name: f.dataType for f in table.schema.fields}
    joined = table
    hits: list[Column] = []
    for i, name in enumerate(columns):
        value = F.col("where_value").try_cast(types[name])
        wanted = (
            requests.where(F.col("where_column") == name)
            .groupBy(value.alias(f"__value_{i}"))
            .agg(F.collect_set(F.struct("where_column", "where_value", *carry)).alias(f"__hit_{i}"))
            .where(F.col(f"__value_{i}").isNotNull())
        )
        joined = joined.join(wanted, F.col(name) == F.col(f"__value_{i}"), "left")
        hits.append(F.col(f"__hit_{i}"))
    none = F.array().cast(
        requests.select(F.array(F.struct("where_column", "where_value", *carry))).schema[0].dataType
    )
    hit = F.concat(*[F.coalesce(h, none) for h in hits]) if hits else none
    return joined.select(*table.columns, hit.alias(flag))


def erase(
    table: DataFrame,
    requests: DataFrame,
    audit: DataFrame,
    schema: StructType,
    table_name: str,
    erased_by: str,
    reason: str,
    at: Column | None = None,
    erasure_id: Column | None = None,
) -> Erasure:
    """Carry out a batch of requests.

    A request found in the audit is left alone, even if its subject has come back since
    (:func:`still_matching` lists such rows). Pass ``at`` and ``erasure_id`` to reproduce a run.
    """
    if "erased" not in table.columns:
        raise ValueError("the table has no 'erased' marker")
    columns = check_columns(requests, table.schema)
    batch = requests.select(*KEY).distinct()
    prior = prior_erasures(audit, table_name)
    # Ids and instants are fixed here once; the rest of the batch reads them back.
    stamped = materialise(
        batch.join(prior, KEY, "left").select(
            *KEY,
            "prior_id",
            (erasure_id if erasure_id is not None else F.uuid()).cast("string").alias("erasure_id"),
            (at if at is not None else F.current_timestamp()).cast("timestamp_ntz").alias("erased_at"),
        ),
        "requests",
    )
    fresh = stamped.where(F.col("prior_id").isNull())
    marked = _matches(table, fresh, columns, "__hits", carry=["erasure_id"])
    hit = F.size("__hits") > 0
    nulled = sorted(c for c in pii_fields(schema) if c in table.columns)
    out = marked.select(
        *[
            F.when(hit, F.lit(None)).otherwise(F.col(c)).alias(c)
            if c in nulled
            else F.when(hit, F.lit(True)).otherwise(F.col(c)).alias(c)
            if c == "erased"
            else F.col(c)
            for c in table.columns
        ]
    )
    body = F.to_json(F.struct(*[c for c in table.columns if not c.startswith("__")]), {"ignoreNullFields": "false"})
    # Matched rows are few; audit, snapshots and statuses all come from them, not from the table again.
    matched = materialise(marked.where(hit), "matched-rows")
    snapshots = matched.select(
        F.explode(F.col("__hits.erasure_id")).alias("erasure_id"), body.alias("pre_erasure_snapshot")
    )
    found = snapshots.groupBy("erasure_id").agg(
        F.min("pre_erasure_snapshot").alias("pre_erasure_snapshot"), F.count(F.lit(1)).alias("n_rows")
    )
    statuses = materialise(
        stamped.join(found, "erasure_id", "left").select(
            *KEY,
            F.when(F.col("prior_id").isNotNull(), ALREADY)
            .when(F.col("n_rows").isNotNull(), ERASED)
            .otherwise(NOT_FOUND)
            .alias("status"),
            F.when(F.col("prior_id").isNotNull(), F.col("prior_id"))
            .when(F.col("n_rows").isNotNull(), F.col("erasure_id"))
            .alias("erasure_id"),
            "erased_at",
            F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
            "pre_erasure_snapshot",
        ),
        "statuses",
    )
    audit_rows = statuses.where(F.col("status") == ERASED).select(
        "erasure_id",
        "erased_at",
        F.lit(erased_by).alias("erased_by"),
        F.lit(table_name).alias("table_name"),
        *KEY,
        F.lit(reason).alias("reason"),
        F.lit(json.dumps(nulled)).alias("pii_fields_nulled"),
        "pre_erasure_snapshot",
    )
    return Erasure(
        out,
        audit_rows,
        snapshots,
        statuses.select(*KEY, "status", "erasure_id", "n_rows"),
        matched.select(*table.columns),
    )


def erase_one(table: DataFrame, where_column: str, where_value: str, **kwargs) -> Erasure:
    """Single request; ``LookupError`` when no row matches and no audit entry exists."""
    spark = table.sparkSession
    request = spark.createDataFrame(
        [(where_column, where_value)], "where_column string, where_value string"
    )
    result = erase(table, request, **kwargs)
    if result.statuses.first()["status"] == NOT_FOUND:
        raise LookupError(f"{kwargs['table_name']} has nothing to erase where {where_column} is {where_value!r}")
    return result


def still_matching(table: DataFrame, audit: DataFrame, table_name: str) -> DataFrame:
    """Rows that match a request already carried out: returned subjects, or a publication that
    stopped between its two steps."""
    done = audit.where(F.col("table_name") == table_name).select(*KEY).distinct()
    columns = check_columns(done, table.schema)
    marked = _matches(table, done, columns, "__hits")
    visible = F.coalesce(F.col("erased"), F.lit(False)) == F.lit(False)
    return marked.where((F.size("__hits") > 0) & visible).drop("__hits")


def publish(result: Erasure, table_path: str, audit_path: str) -> None:
    """Make a batch visible. Both sides are staged first; the audit is appended before the new
    table copy is moved in place, so no row is ever erased without a record. Rows left over by a
    crash in between are listed by :func:`still_matching`."""
    spark = result.table.sparkSession
    staged = new_path(spark, "erased-table")
    result.table.write.parquet(staged)
    write_table(materialise(result.audit, "erasure-audit"), audit_path, mode="append")
    replace_folder(spark, staged, table_path)


def sweep(derived: DataFrame, tombstones: DataFrame, keys: Sequence[str], schema: StructType) -> DataFrame:
    """Derived copies with the PII of tombstoned keys nulled and the rows marked."""
    gone = tombstones.select(*keys).distinct().withColumn("__gone", F.lit(True))
    joined = derived.join(gone, list(keys), "left")
    hit = F.coalesce("__gone", F.lit(False))
    marked = [c for c in pii_fields(schema) if c in derived.columns]
    return joined.select(
        *[
            F.when(hit, F.lit(None)).otherwise(F.col(c)).alias(c)
            if c in marked
            else (F.when(hit, F.lit(True)).otherwise(F.col(c)).alias(c) if c == "erased" else F.col(c))
            for c in derived.columns
        ]
    )


def retain_snapshots(audit: DataFrame, as_of: Column, years: int = 7) -> DataFrame:
    """Audit with snapshots past the retention horizon nulled; the rows themselves stay."""
    expired = F.add_months(F.col("erased_at").cast("date"), 12 * years) < as_of.cast("date")
    return audit.withColumn(
        "pre_erasure_snapshot", F.when(~expired, F.col("pre_erasure_snapshot"))
    )
