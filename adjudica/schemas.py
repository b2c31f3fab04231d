"""Table contracts, declared once as ``StructType``.

A field's metadata carries everything the engine needs to know about it:

* ``kind``      ``domain`` (part of the business object) or ``metadata`` (bookkeeping)
* ``required``  a value must arrive; there is no default
* ``default``   what an absent column is filled with (dates as ISO text)
* ``allowed``   closed list of values
* ``pii``       ``{"category": direct|quasi|sensitive, "regimes": [..]}``

Projections, dispatch, tokenisation, erasure and drift checks all read these contracts, so a
change of shape is made here and nowhere else.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    ByteType,
    DataType,
    DateType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    MapType,
    ShortType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

_NO_DEFAULT = object()


def field(
    name: str,
    dtype: DataType,
    *,
    kind: str = "domain",
    default: Any = _NO_DEFAULT,
    allowed: list[Any] | None = None,
    pii: str | None = None,
    regimes: tuple[str, ...] = (),
) -> StructField:
    meta: dict[str, Any] = {"kind": kind, "required": default is _NO_DEFAULT}
    if default is not _NO_DEFAULT:
        meta["default"] = default
    if allowed:
        meta["allowed"] = allowed
    if pii:
        if pii not in PII_CATEGORIES:
            raise ValueError(f"unknown PII category {pii!r}")
        meta["pii"] = {"category": pii, "regimes": sorted(regimes)}
    return StructField(name, dtype, True, meta)


# PII categories, most protected first.
PII_CATEGORIES = ["direct", "quasi", "sensitive"]

# Fixed value: the day version 1 of the proposal shape took effect.
V1_EFFECTIVE_DATE = "2026-04-30"

_METADATA = [
    field("schema_version", IntegerType(), kind="metadata", default=1),
    field("schema_effective_date", DateType(), kind="metadata", default=V1_EFFECTIVE_DATE),
    field("erased", BooleanType(), kind="metadata", default=False),
]

PROPOSAL_BASE = StructType(_METADATA)

PROPOSAL = StructType(
    [
        field("holder_kind", StringType(), default="individual", allowed=["individual", "entity"]),
        field("holder_name", StringType(), pii="direct", regimes=("GLBA",)),
        field("premium", DoubleType()),
        field("zip_code", StringType(), pii="quasi", regimes=("GLBA",)),
        field("age", IntegerType(), pii="quasi", regimes=("GLBA",)),
        *_METADATA,
    ]
)

INDIVIDUAL_HOLDER = StructType(
    [
        field("kind", StringType(), default="individual", allowed=["individual"]),
        field("name", StringType(), pii="direct", regimes=("GLBA",)),
    ]
)

ENTITY_HOLDER = StructType(
    [
        field("kind", StringType(), default="entity", allowed=["entity"]),
        field("name", StringType()),
    ]
)

UNDERWRITING = StructType(
    [
        field("premium", DoubleType()),
        field("coverage", DoubleType()),
        field("expected_claim", DoubleType()),
        field("jurisdiction", StringType()),
        field(
            "product_line",
            StringType(),
            allowed=["Auto", "Health", "Life", "PropertyCasualty"],
        ),
        field("rating_factors", ArrayType(StringType())),
        field("consent", BooleanType()),
        field("prior_premium", DoubleType(), default=None),
        field("explainability_score", DoubleType()),
        field("cession", DoubleType()),
    ]
)

VIOLATION = StructType(
    [
        StructField("rule_name", StringType()),
        StructField("message", StringType()),
        StructField("context", MapType(StringType(), StringType())),
    ]
)

OBSERVATIONS = StructType(
    [
        StructField("learner_id", StringType()),
        StructField("ts", TimestampNTZType()),
        StructField("observation", DoubleType()),
        StructField("sigma2", DoubleType()),
        StructField("mu0", DoubleType()),
        StructField("kappa0", DoubleType()),
    ]
)

LEARNER_STATE = StructType(
    [
        StructField("learner_id", StringType()),
        StructField("version", LongType()),
        StructField("ts", TimestampNTZType()),
        StructField("state_json", StringType()),
    ]
)

ERASURE_AUDIT = StructType(
    [
        StructField("erasure_id", StringType()),
        StructField("erased_at", TimestampNTZType()),
        StructField("erased_by", StringType()),
        StructField("table_name", StringType()),
        StructField("where_column", StringType()),
        StructField("where_value", StringType()),
        StructField("reason", StringType()),
        StructField("pii_fields_nulled", StringType()),
        StructField("pre_erasure_snapshot", StringType()),
    ]
)

QUARANTINE = StructType(
    [
        StructField("quarantine_id", StringType()),
        StructField("quarantined_at", TimestampNTZType()),
        StructField("schema_version_seen", IntegerType()),
        StructField("reason", StringType()),
        StructField("detail", StringType()),
        StructField("raw_payload", StringType()),
    ]
)

SYSTEM_TABLES = {
    "state_observations": OBSERVATIONS,
    "learner_state": LEARNER_STATE,
    "_audit_erasures": ERASURE_AUDIT,
    "raw_quarantine": QUARANTINE,
}

TRACKED_MODELS = {
    "Proposal": PROPOSAL_BASE,
    "CanonicalProposal": PROPOSAL,
    "IndividualHolder": INDIVIDUAL_HOLDER,
    "EntityHolder": ENTITY_HOLDER,
}


def domain_fields(schema: StructType) -> list[str]:
    """Names of the business columns, bookkeeping columns left out."""
    return [f.name for f in schema.fields if f.metadata.get("kind", "domain") == "domain"]


def is_required(f: StructField) -> bool:
    return f.metadata.get("required", not f.nullable)


def extraction_fields(schema: StructType) -> list[str]:
    """Business columns an extractor must fill: those without a default."""
    names = set(domain_fields(schema))
    return [f.name for f in schema.fields if f.name in names and is_required(f)]


def project(df: DataFrame, schema: StructType) -> DataFrame:
    """Select the contract's columns, by name and cast to the contract's types."""
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def flatten_holder(df: DataFrame, holder: str = "holder") -> DataFrame:
    """Replace a ``holder`` struct by flat ``holder_kind`` and ``holder_name`` columns."""
    rest = [c for c in df.columns if c != holder]
    return df.select(
        F.col(f"{holder}.kind").alias("holder_kind"),
        F.col(f"{holder}.name").alias("holder_name"),
        *rest,
    )


def holder_struct(kind: str = "holder_kind", name: str = "holder_name") -> Column:
    """Typed holder rebuilt from flat columns; any kind but ``individual`` is an entity."""
    tag = F.when(F.col(kind) == "individual", F.lit("individual")).otherwise(F.lit("entity"))
    return F.struct(tag.alias("kind"), F.col(name).alias("name"))


def with_holder(df: DataFrame) -> DataFrame:
    return df.withColumn("holder", holder_struct())


_SQL_NAMES = {
    StringType: "VARCHAR",
    DoubleType: "DOUBLE",
    IntegerType: "INTEGER",
    BooleanType: "BOOLEAN",
    DateType: "DATE",
}

_FOLDED_NAMES = {
    **_SQL_NAMES,
    ByteType: "INTEGER",
    ShortType: "INTEGER",
    LongType: "INTEGER",
    FloatType: "DOUBLE",
}


def sql_type(dtype: DataType, fold_widths: bool = False) -> str:
    """Contract type name. ``fold_widths`` ignores integer and float widths and reads
    timestamps as dates, which is what a shape check on live data wants."""
    if fold_widths and dtype.typeName().startswith("timestamp"):
        return "DATE"
    return (_FOLDED_NAMES if fold_widths else _SQL_NAMES).get(type(dtype), "VARIANT")


def sql_types(schema: StructType) -> dict[str, str]:
    return {f.name: sql_type(f.dataType) for f in schema.fields}


def udf_argument_types(schema: StructType) -> dict[str, DataType]:
    """Argument types of a row validator over the domain columns; scalars only."""
    out: dict[str, DataType] = {}
    for f in schema.fields:
        if f.name not in domain_fields(schema):
            continue
        if isinstance(f.dataType, IntegerType):
            out[f.name] = LongType()
        elif isinstance(f.dataType, (StringType, DoubleType, BooleanType)):
            out[f.name] = f.dataType
        else:
            raise TypeError(f"unsupported type for {f.name}: {f.dataType.simpleString()}")
    return out
