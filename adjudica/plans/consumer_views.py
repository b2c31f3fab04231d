"""The consumer-facing views as temporary views, for readers who write SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from adjudica.operators import analytics, learners, views
from adjudica.plans.outcomes import Outcomes


def expose(
    proposals: DataFrame | None = None,
    outcomes: Outcomes | None = None,
    quarantine: DataFrame | None = None,
    audit: DataFrame | None = None,
    observations: DataFrame | None = None,
) -> list[str]:
    """Create the views whose sources are given; returns their names."""
    frames: dict[str, DataFrame] = {}
    if proposals is not None:
        staged = views.stg_proposals(proposals)
        frames |= {"stg_proposals": staged, "v_proposals": views.v_proposals(staged)}
    if outcomes is not None:
        frames |= {
            "contracts": outcomes.contracts,
            "rejections": outcomes.rejections,
            "v_contracts": views.v_contracts(outcomes.contracts),
            "rejection_summary": analytics.rejection_summary(outcomes.rejections),
        }
    if quarantine is not None:
        frames["stg_quarantine"] = views.stg_quarantine(quarantine)
    if audit is not None:
        frames["v_audit_erasures"] = views.v_audit_erasures(audit)
    if observations is not None:
        frames["current_state"] = learners.credibility_state(observations)
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
    return sorted(frames)
