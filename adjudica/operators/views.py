"""Staging projections and consumer views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from adjudica import schemas


def stg_proposals(raw: DataFrame) -> DataFrame:
    return schemas.project(raw, schemas.PROPOSAL)


def stg_quarantine(raw: DataFrame) -> DataFrame:
    return schemas.project(raw, schemas.QUARANTINE)


def visible() -> Column:
    """Rows a consumer may see. A NULL marker hides the row as well."""
    return F.expr("erased = false")


def v_proposals(staged: DataFrame) -> DataFrame:
    return staged.where(visible()).select(*schemas.PROPOSAL.names)


def v_contracts(contracts: DataFrame) -> DataFrame:
    shape = StructType([*schemas.PROPOSAL.fields, StructField("payload_json", StringType())])
    return contracts.where(visible()).select(*shape.names)


def v_audit_erasures(audit: DataFrame) -> DataFrame:
    """Every erasure, newest first; an audit hides nothing."""
    return schemas.project(audit, schemas.ERASURE_AUDIT).orderBy(F.desc("erased_at"))
