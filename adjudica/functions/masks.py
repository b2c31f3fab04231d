"""Read-time masks."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, functions as F

# Roles that see through each masking policy.
UNMASKED_ROLES = {
    "direct_pii": {"PRIVACY_OFFICER"},
    "quasi_pii": {"ANALYST", "PRIVACY_OFFICER"},
}

# What each deployment tier can do.
TIERS = {
    "enterprise": {"masking": "policy", "row_access": "policy", "grants": True},
    "standard": {"masking": "case_expression", "row_access": "separate_view", "grants": True},
    "local": {"masking": "none", "row_access": "none", "grants": False},
}


def feature_set(tier: str) -> dict[str, object]:
    """Capabilities of a tier; unknown names fall back to the unprotected local tier."""
    known = tier if tier in TIERS else "local"
    return {"tier": known, **TIERS[known]}


def mask(
    column: str,
    policy: str,
    roles: Collection[str] | Column,
    tier: str = "standard",
) -> Column:
    """Column as seen by a reader.

    ``roles`` is the reader's role names, or an array column when each row has its own reader.
    Only the ``case_expression`` tier masks here; elsewhere the catalog does, or nobody.
    """
    value = F.col(column)
    if feature_set(tier)["masking"] != "case_expression":
        return value
    if policy not in UNMASKED_ROLES:
        raise ValueError(f"unknown masking policy {policy!r}")
    hidden = F.lit("***") if policy == "direct_pii" else F.lit(None)
    allowed = UNMASKED_ROLES[policy]
    if isinstance(roles, Column):
        may_see = F.arrays_overlap(roles, F.array(*[F.lit(r) for r in sorted(allowed)]))
        return F.when(may_see, value).otherwise(hidden).alias(column)
    return (value if allowed & set(roles) else hidden).alias(column)


def zip_prefix(column: Column, shown: int = 3) -> Column:
    """Leading ZIP digits, the others starred out."""
    hidden = F.greatest(F.length(column) - shown, F.lit(0))
    return F.concat(F.substring(column, 1, shown), F.repeat(F.lit("*"), hidden))


def year_only(column: Column) -> Column:
    return F.year(column)
