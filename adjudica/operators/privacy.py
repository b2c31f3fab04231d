"""PII classification, tokenisation and masking, driven by field metadata."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from adjudica.functions.masks import mask
from adjudica.functions import permutation
from adjudica.functions.tokens import token
from adjudica.schemas import PII_CATEGORIES


def is_pii(f: StructField) -> bool:
    return "pii" in f.metadata


def pii_fields(schema: StructType) -> dict[str, dict]:
    return {f.name: f.metadata["pii"] for f in schema.fields if is_pii(f)}


def non_pii_fields(schema: StructType) -> list[str]:
    return [f.name for f in schema.fields if not is_pii(f)]


CLASSIFICATION = (
    "model string, position int, field string, pii boolean, category string, regimes array<string>"
)


def classify(spark: SparkSession, models: Mapping[str, StructType]) -> DataFrame:
    """One row per field of every contract; ``position`` is the report order within a model:
    PII by category then name, then the rest by name."""
    rows = []
    for model, schema in models.items():
        marked = pii_fields(schema)
        first = sorted(marked, key=lambda n: (PII_CATEGORIES.index(marked[n]["category"]), n))
        for position, name in enumerate([*first, *sorted(non_pii_fields(schema))]):
            info = marked.get(name)
            rows.append(
                (
                    model,
                    position,
                    name,
                    info is not None,
                    info["category"] if info else None,
                    sorted(info["regimes"]) if info else [],
                )
            )
    return spark.createDataFrame(rows, CLASSIFICATION).orderBy("model", "position")


# Tokens -------------------------------------------------------------------------------------


def token_columns(schema: StructType) -> list[str]:
    """Direct identifiers held as text."""
    return [
        f.name
        for f in schema.fields
        if is_pii(f)
        and f.metadata["pii"]["category"] == "direct"
        and isinstance(f.dataType, StringType)
    ]


def _same_name(name: str) -> str:
    return name


def tokenise(
    df: DataFrame,
    schema: StructType,
    transformation_for: Callable[[str], str] = _same_name,
    by_branch: bool = False,
) -> DataFrame:
    """Replace direct identifiers by tokens.

    The flat column is protected for every holder; ``by_branch`` leaves the names of entities
    alone, as the typed holder does.
    """
    present = [c for c in token_columns(schema) if c in df.columns]
    replaced = {}
    for name in present:
        value = token(F.col(name), transformation_for(name))
        if by_branch:
            value = F.when(F.col("holder_kind") == "individual", value).otherwise(F.col(name))
        replaced[name] = value
    return df.withColumns(replaced) if replaced else df


def permute(df: DataFrame, schema: StructType, key: str | Column) -> DataFrame:
    """Replace direct identifiers by tokens that never collide and that the key alone takes back.

    The key is part of the plan; give it as a column read from a table of keys to keep it out of logs.
    Whole rows go through Python, so select the columns that are needed before.
    """
    names = [c for c in token_columns(schema) if c in df.columns]
    return permutation.permute_rows(df, {c: c for c in names}, key) if names else df


def restore(df: DataFrame, schema: StructType, key: str | Column) -> DataFrame:
    """Undo :func:`permute`, without a map and without a join."""
    names = [c for c in token_columns(schema) if c in df.columns]
    return permutation.restore_rows(df, {c: c for c in names}, key) if names else df


def token_map(
    df: DataFrame, columns: Sequence[str], transformation_for: Callable[[str], str] = _same_name
) -> DataFrame:
    """Distinct (transformation, token, plaintext) of the given plaintext columns, in one pass."""
    pairs = F.array(
        *[
            F.struct(F.lit(transformation_for(c)).alias("transformation"), F.col(c).alias("plaintext"))
            for c in columns
        ]
    )
    plain = (
        df.select(F.explode(pairs).alias("pair"))
        .select("pair.transformation", "pair.plaintext")
        .where(F.col("plaintext").isNotNull())
        .distinct()
    )
    # The token depends on the plaintext alone, so it is computed once per distinct value.
    names = dict.fromkeys(transformation_for(c) for c in columns)
    value = F.lit(None).cast("string")
    for name in names:
        value = F.when(F.col("transformation") == name, token(F.col("plaintext"), name)).otherwise(value)
    return plain.select("transformation", value.alias("token"), "plaintext")


def detokenise(
    df: DataFrame, tokens: DataFrame, column: str, transformation: str | None = None
) -> DataFrame:
    """Replace tokens by plaintext; unknown tokens become NULL (see :func:`unknown_tokens`).

    A token with several plaintexts becomes NULL too (see :func:`collisions`): it must not name the
    wrong person, and rows never multiply.
    Plain equi-join: the runtime broadcasts the map if it proves small and splits hot tokens.
    """
    wanted = tokens.where(F.col("transformation") == (transformation or column))
    only = F.when(F.min("plaintext") == F.max("plaintext"), F.max("plaintext"))
    reverse = wanted.groupBy(F.col("token").alias(column)).agg(only.alias("__plain"))
    return df.join(reverse, column, "left").select(
        *[F.col("__plain").alias(c) if c == column else F.col(c) for c in df.columns]
    )


def unknown_tokens(
    df: DataFrame, tokens: DataFrame, column: str, transformation: str | None = None
) -> DataFrame:
    wanted = tokens.where(F.col("transformation") == (transformation or column))
    known = wanted.select(F.col("token").alias(column)).distinct()
    return df.where(F.col(column).isNotNull()).join(known, column, "left_anti").select(column).distinct()


def collisions(tokens: DataFrame) -> DataFrame:
    """Tokens that stand for more than one plaintext."""
    distinct = tokens.select("transformation", "token", "plaintext").distinct()
    return (
        distinct.groupBy("transformation", "token")
        .agg(F.count(F.lit(1)).alias("n_plaintexts"))
        .where(F.col("n_plaintexts") > 1)
    )


# Masking ------------------------------------------------------------------------------------

POLICIES = {"direct": "direct_pii", "quasi": "quasi_pii"}


def mask_frame(
    df: DataFrame,
    schema: StructType,
    roles: Collection[str] | Column,
    tier: str = "standard",
) -> DataFrame:
    """Frame as seen by a reader with the given roles; sensitive fields mask like direct ones."""
    marked = pii_fields(schema)
    return df.select(
        *[
            mask(c, POLICIES.get(marked[c]["category"], "direct_pii"), roles, tier)
            if c in marked
            else F.col(c)
            for c in df.columns
        ]
    )
