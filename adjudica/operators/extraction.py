"""Raw text to structured rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from adjudica import schemas
from adjudica.functions import costs
from adjudica.functions.text import extract_field


def extract_fields(
    df: DataFrame, fields: Sequence[str], text: str = "text", tokens: str = "tokens"
) -> DataFrame:
    """Add one column per field, and what the call cost; unknown fields are NULL."""
    body = F.col(text)
    added = {name: extract_field(body, name) for name in fields}
    return df.withColumns({**added, tokens: costs.extract_tokens(body, len(fields))})


def complete_only(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Drop rows with a missing field. They are not quarantined, but their tokens were spent."""
    return df.dropna(how="any", subset=list(fields))


def extract_proposals(
    df: DataFrame, schema: StructType, text: str = "text", tokens: str = "tokens"
) -> DataFrame:
    """Complete extractions of a contract's fields, each pattern run at most once per text.

    Filtering extracted columns would push the patterns into the filter and run them again for
    the rows that stay. A generator keeps them in one place, and texts without the first field
    are given up before the other patterns are tried.
    """
    fields = schemas.extraction_fields(schema)
    body = F.col(text)
    values = {name: extract_field(body, name) for name in fields}
    record = F.struct(*[v.alias(n) for n, v in values.items()])
    found = F.when(values[fields[0]].isNotNull(), F.array(record))
    cost = costs.extract_tokens(body, len(fields)).alias(tokens)
    return complete_only(df.select("*", F.inline(found), cost), fields)
