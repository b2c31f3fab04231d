"""Token accounting for extraction and completion calls."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# One token per four characters, five per requested field.
CHARS_PER_TOKEN = 4
TOKENS_PER_FIELD = 5
COMPLETION_TAG = "[mock-completion] "


def _quarter_length(text: Column) -> Column:
    return F.floor(F.length(text) / F.lit(CHARS_PER_TOKEN)).cast("bigint")


def extract_tokens(text: Column, n_fields: int) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), _quarter_length(text) + TOKENS_PER_FIELD * n_fields)


def complete_tokens(prompt: Column, max_tokens: int | None = None) -> Column:
    """Tokens of a completion; ``max_tokens`` bounds what one call may be charged."""
    used = F.greatest(F.lit(1).cast("bigint"), _quarter_length(prompt))
    return used if max_tokens is None else F.least(F.lit(max_tokens).cast("bigint"), used)


def complete_text(prompt: Column, echo: int | None = None) -> Column:
    """Stand-in completion: a tag and the prompt, or only its first ``echo`` characters."""
    return F.concat(F.lit(COMPLETION_TAG), prompt if echo is None else F.substring(prompt, 1, echo))
