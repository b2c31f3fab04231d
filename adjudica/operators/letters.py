"""Rejection letters from violations and the risk score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from adjudica.functions import costs

NOTHING_FOUND = "No violations found."


def number_text(value: Column) -> Column:
    return value.cast("string")


def prompt(violations: Column, risk: Column) -> Column:
    """Drafting prompt; ``risk`` is text, so the caller fixes the number format."""
    reasons = F.array_join(
        F.transform(violations, lambda v: F.concat(v["rule_name"], F.lit(": "), v["message"])),
        "; ",
    )
    return F.concat(
        F.lit("Draft a polite rejection letter. Reasons: "),
        reasons,
        F.lit(". Risk context: "),
        risk,
        F.lit("."),
    )


def explain(violations: Column, risk: Column, max_tokens: int | None = None) -> Column:
    """Struct of the letter's text and the tokens it cost; no violations cost nothing."""
    text = prompt(violations, risk)
    none = F.size(violations) == 0
    return F.struct(
        F.when(none, F.lit(NOTHING_FOUND)).otherwise(costs.complete_text(text)).alias("text"),
        F.when(none, F.lit(0).cast("bigint"))
        .otherwise(costs.complete_tokens(text, max_tokens))
        .alias("tokens"),
    )


def rejection_letters(
    rejections: DataFrame,
    violations: str = "payload.violations",
    score: str = "payload.score",
    max_tokens: int | None = None,
) -> DataFrame:
    """All columns kept; adds ``explanation`` and ``explanation_tokens``."""
    letter = explain(F.col(violations), number_text(F.col(score)), max_tokens)
    return rejections.withColumns(
        {"explanation": letter["text"], "explanation_tokens": letter["tokens"]}
    )
