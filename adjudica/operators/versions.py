"""Schema versions: registry, row dispatch, quarantine, cross-version views, compatibility."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DateType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)

from adjudica import schemas

MISSING = "missing schema_version"
UNKNOWN = "unknown schema version"
INVALID = "validation failed"

# Texts read as booleans.
TRUE_TEXTS = ["true", "t", "yes", "y", "on", "1"]
FALSE_TEXTS = ["false", "f", "no", "n", "off", "0"]


class Version(NamedTuple):
    """A schema version: its number, the day it takes effect, and its contract."""

    number: int
    since: str
    contract: StructType


def known_versions(*versions: Version) -> tuple[Version, ...]:
    """Versions in order of their numbers, of which each may be given once."""
    numbers = [v.number for v in versions]
    if not numbers or len(set(numbers)) < len(numbers):
        raise ValueError(f"version numbers must be given, each once: {numbers}")
    return tuple(sorted(versions, key=lambda v: v.number))


FIRST = Version(1, schemas.V1_EFFECTIVE_DATE, schemas.PROPOSAL)


# Typed reading ------------------------------------------------------------------------------


def _coerce(value: Column, have: DataType, want: DataType) -> Column:
    """``value`` read as ``want``; NULL when it cannot be. Text never comes from numbers."""
    name = have.typeName()
    number = name in ("byte", "short", "integer", "long", "float", "double", "decimal")
    text = F.trim(value) if name == "string" else value
    if isinstance(want, StringType):
        return value if name == "string" else F.lit(None).cast("string")
    if isinstance(want, IntegerType):
        if name == "string":
            digits = F.regexp_extract(text, r"^([+-]?\d+)(?:\.0*)?$", 1)
            return digits.try_cast("int")
        if name in ("float", "double", "decimal"):
            return F.when(value == F.floor(value), value.try_cast("int"))
        return value.try_cast("int") if number or name == "boolean" else F.lit(None).cast("int")
    if isinstance(want, DoubleType):
        usable = number or name in ("string", "boolean")
        return text.try_cast("double") if usable else F.lit(None).cast("double")
    if isinstance(want, BooleanType):
        if name == "string":
            lowered = F.lower(text)
            return F.when(lowered.isin(*TRUE_TEXTS), F.lit(True)).when(
                lowered.isin(*FALSE_TEXTS), F.lit(False)
            )
        if number:
            return F.when(value == 1, F.lit(True)).when(value == 0, F.lit(False))
        return value if name == "boolean" else F.lit(None).cast("boolean")
    if isinstance(want, DateType):
        if name == "string":
            return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))
        if name.startswith("timestamp"):
            return F.when(value == F.date_trunc("day", value), value.cast("date"))
        return value if name == "date" else F.lit(None).cast("date")
    return value.try_cast(want)


def _default(f: StructField) -> Column:
    value = f.metadata.get("default")
    if isinstance(f.dataType, DateType) and isinstance(value, str):
        value = dt.date.fromisoformat(value)
    return F.lit(value).cast(f.dataType)


class Checked(NamedTuple):
    value: Column
    error: Column


def check_field(f: StructField, source: StructType) -> Checked:
    """Typed value of one contract field and an error text, NULL when the field is fine.

    An absent column takes its default. A NULL in a present column is a value given as nothing:
    it fails unless the default is NULL itself.
    """
    none = F.lit(None).cast("string")
    present = {s.name: s.dataType for s in source.fields}
    required = schemas.is_required(f)
    if f.name not in present:
        if required:
            return Checked(F.lit(None).cast(f.dataType), F.lit(f"{f.name}: missing"))
        return Checked(_default(f), none)
    raw = F.col(f.name)
    value = _coerce(raw, present[f.name], f.dataType)
    optional = not required and f.metadata.get("default") is None
    error = F.when(raw.isNull(), none if optional else F.lit(f"{f.name}: missing")).when(
        value.isNull(), F.lit(f"{f.name}: not a {f.dataType.simpleString()}")
    )
    if isinstance(f.dataType, ArrayType):
        error = error.when(F.exists(value, lambda x: x.isNull()), F.lit(f"{f.name}: holds a missing value"))
    allowed = f.metadata.get("allowed")
    if allowed:
        error = error.when(~value.isin(*allowed), F.lit(f"{f.name}: not allowed"))
    return Checked(value, error)


def validate_columns(df: DataFrame, schema: StructType) -> tuple[dict[str, Column], Column]:
    """Typed columns of a contract, and the errors of a row as one text ('' when valid)."""
    checked = {f.name: check_field(f, df.schema) for f in schema.fields}
    errors = F.concat_ws("; ", *[c.error for c in checked.values()])
    return {name: c.value for name, c in checked.items()}, errors


def stamp_default(df: DataFrame, version: int = 1) -> DataFrame:
    """Give unversioned frames a version. An existing column is left alone, NULLs included."""
    if "schema_version" in df.columns:
        return df
    return df.withColumn("schema_version", F.lit(version))


# Dispatch -----------------------------------------------------------------------------------


class Dispatched(NamedTuple):
    """``labelled`` holds every input row; the other frames are projections of it.

    ``merged`` has all valid rows in the newest shape, read once for any number of versions.
    """

    labelled: DataFrame
    valid: dict[int, DataFrame]
    merged: DataFrame
    quarantined: DataFrame


def dispatch(
    df: DataFrame, versions: Sequence[Version] = (FIRST,), keep: Sequence[str] = ()
) -> Dispatched:
    """Route each row to the contract of its version, or to quarantine with a reason.

    ``keep`` names columns outside the contracts (row ids) that valid rows carry along.
    """
    version = F.col("schema_version")
    seen = version.try_cast("int")
    known = [v.number for v in versions]
    invalid = F.lit("")
    typed: dict[int, dict[str, Column]] = {}
    for v in versions:
        typed[v.number], errors = validate_columns(df, v.contract)
        invalid = F.when(seen == v.number, errors).otherwise(invalid)
    reason = (
        F.when(version.isNull(), F.lit(MISSING))
        .when(seen.isNull() | ~seen.isin(*known), F.lit(UNKNOWN))
        .when(invalid != "", F.lit(INVALID))
    )
    detail = (
        F.when(version.isNull(), F.lit(""))
        .when(seen.isNull() | ~seen.isin(*known), F.lit(f"known versions: {known}"))
        .otherwise(invalid)
    )
    labelled = df.select("*", reason.alias("__reason"), detail.alias("__detail"))
    good = labelled.where(F.col("__reason").isNull())
    valid = {
        v: good.where(seen == v).select(*keep, *[c.alias(n) for n, c in typed[v].items()])
        for v in known
    }

    def newest(f: StructField) -> Column:
        """The value by the row's own version; NULL where that version lacks the column."""
        value = F.lit(None).cast(f.dataType)
        for number, columns in typed.items():
            if f.name in columns:
                value = F.when(seen == number, columns[f.name]).otherwise(value)
        return value.alias(f.name)

    merged = good.select(*keep, *[newest(f) for f in versions[-1].contract.fields])
    bad = labelled.where(F.col("__reason").isNotNull())
    quarantined = bad.select(
        *keep,
        seen.alias("schema_version_seen"),
        F.col("__reason").alias("reason"),
        F.col("__detail").alias("detail"),
        F.struct(*df.columns).alias("raw_row"),
    )
    return Dispatched(labelled, valid, merged, quarantined)


def to_quarantine(
    quarantined: DataFrame, at: Column | None = None, row_id: Column | None = None
) -> DataFrame:
    """Rows of the quarantine table. Pass ``at`` and ``row_id`` for reproducible output."""
    return quarantined.select(
        (row_id if row_id is not None else F.uuid()).cast("string").alias("quarantine_id"),
        (at if at is not None else F.current_timestamp()).cast("timestamp_ntz").alias("quarantined_at"),
        "schema_version_seen",
        "reason",
        "detail",
        F.to_json("raw_row", {"ignoreNullFields": "false"}).alias("raw_payload"),
    )


def dispatch_counts(dispatched: Dispatched) -> DataFrame:
    """Input, valid and quarantined counts in one pass; every row is on exactly one side."""
    bad = F.col("__reason").isNotNull()
    return dispatched.labelled.agg(
        F.count(F.lit(1)).alias("n_input"),
        F.count_if(~bad).alias("n_valid"),
        F.count_if(bad).alias("n_quarantined"),
        *[
            F.count_if(F.col("__reason") == r).alias(f"n_{name}")
            for name, r in (("missing", MISSING), ("unknown", UNKNOWN), ("invalid", INVALID))
        ],
    )


# Compatibility ------------------------------------------------------------------------------

SNAPSHOT = "model string, field string, type string, required boolean"


def type_text(f: StructField) -> str:
    allowed = f.metadata.get("allowed")
    if allowed:
        return f"one of {', '.join(map(str, allowed))}"
    return f.dataType.simpleString()


def snapshot(spark: SparkSession, models: dict[str, StructType]) -> DataFrame:
    """One row per field of each contract."""
    rows = [
        (model, f.name, type_text(f), schemas.is_required(f))
        for model, schema in models.items()
        for f in schema.fields
    ]
    return spark.createDataFrame(rows, SNAPSHOT)


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes between two snapshots: model, field (NULL for a whole model), kind, change.

    Fields of a model that was added or removed are not listed one by one. A field may change
    in two ways at once.
    """
    o, n = old.alias("o"), new.alias("n")
    old_models = old.select("model").distinct().withColumn("in_old", F.lit(True))
    new_models = new.select("model").distinct().withColumn("in_new", F.lit(True))
    models = old_models.join(new_models, "model", "full")
    whole = models.where(F.col("in_old").isNull() | F.col("in_new").isNull()).select(
        "model",
        F.lit(None).cast("string").alias("field"),
        F.when(F.col("in_old").isNull(), "additive").otherwise("breaking").alias("kind"),
        F.when(F.col("in_old").isNull(), "model added").otherwise("model removed").alias("change"),
    )
    shared = models.where(F.col("in_old").isNotNull() & F.col("in_new").isNotNull()).select("model")
    pairs = o.join(
        n, (F.col("o.model") == F.col("n.model")) & (F.col("o.field") == F.col("n.field")), "full"
    ).select(
        F.coalesce("o.model", "n.model").alias("model"),
        F.coalesce("o.field", "n.field").alias("field"),
        F.col("o.type").alias("old_type"),
        F.col("n.type").alias("new_type"),
        F.col("o.required").alias("was_required"),
        F.col("n.required").alias("is_required"),
    )
    had, has = F.col("was_required").isNotNull(), F.col("is_required").isNotNull()
    was, now = F.col("was_required"), F.col("is_required")

    def change(condition: Column, kind: str, text: str | Column) -> Column:
        shown = F.lit(text) if isinstance(text, str) else text
        return F.when(condition, F.struct(F.lit(kind).alias("kind"), shown.alias("change")))

    retyped = F.concat(F.lit("type changed from "), "old_type", F.lit(" to "), "new_type")

    found = F.array_compact(
        F.array(
            change(~had & now, "breaking", "required field added"),
            change(~had & ~now, "additive", "optional field added"),
            change(~has, "breaking", "field removed"),
            change(F.col("old_type") != F.col("new_type"), "breaking", retyped),
            change(was & ~now, "additive", "required to optional"),
            change(~was & now, "breaking", "optional to required"),
        )
    )
    fields = (
        pairs.join(shared, "model", "left_semi")
        .select("model", "field", F.explode(found).alias("found"))
        .select("model", "field", "found.kind", "found.change")
    )
    return whole.unionByName(fields)


def store_baseline(spark: SparkSession, path: str, models: dict[str, StructType]) -> None:
    """Keep the contracts' snapshot for later comparisons; a snapshot at ``path`` is replaced."""
    snapshot(spark, models).coalesce(1).write.mode("overwrite").parquet(path)


def changes_since(spark: SparkSession, path: str, models: dict[str, StructType]) -> DataFrame:
    """What has changed in the contracts since the baseline at ``path`` was stored."""
    return diff(spark.read.schema(SNAPSHOT).parquet(path), snapshot(spark, models))


def verdict(changes: DataFrame, acknowledged: bool = False) -> DataFrame:
    """One row: passed unless there is a breaking change nobody acknowledged."""
    counted = changes.agg(
        F.count(F.lit(1)).alias("n_changes"),
        F.count_if(F.col("kind") == "breaking").alias("n_breaking"),
    )
    return counted.select(
        "n_changes",
        "n_breaking",
        ((F.col("n_breaking") == 0) | F.lit(acknowledged)).alias("passed"),
        F.when(F.col("n_changes") == 0, "OK: no schema changes")
        .when(F.col("n_breaking") == 0, "OK: additive")
        .when(F.lit(acknowledged), "OK: breaking change acknowledged")
        .otherwise("BREAKING: not acknowledged")
        .alias("summary"),
    )
