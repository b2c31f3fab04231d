"""The whole batch: texts to contracts, rejections and quarantine."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql.types import StructType

from adjudica import schemas
from adjudica.operators import budget as budgets
from adjudica.operators import extraction, privacy, versions
from adjudica.operators.analytics import rejection_summary
from adjudica.operators.decisions import AnyDecision
from adjudica.operators.monoids import JOINT, Monoid
from adjudica.functions import costs
from adjudica.plans import outcomes
from adjudica.sources import tables


class BudgetExceeded(RuntimeError):
    """The extraction of the batch costs more tokens than allowed."""


@dataclass
class RunResult:
    contracts: int
    rejections: int
    extracted: int
    quarantined: int
    tokens: int
    budget: int | None
    rule_breakdown: dict[str, int] = field(default_factory=dict)
    breached: bool = False


def run(
    texts: DataFrame,
    out: str,
    system: Sequence[AnyDecision],
    adm: Callable[[Column], Column],
    monoid: Monoid = JOINT,
    known: Sequence[versions.Version] = (versions.FIRST,),
    max_tokens: int | None = None,
    keep: Sequence[str] = ("text_id",),
    tokenise: bool = False,
    text: str = "text",
    stop_in_order: Sequence[str] | None = None,
) -> RunResult:
    """Extract, dispatch, tokenise, judge and write below the folder ``out``.

    A batch above ``max_tokens`` is refused; with ``stop_in_order`` its texts are taken in that order
    up to the first whose extraction would pass the cap, and the run goes on with those before it.

    The long texts are read once: their few extracted columns are written as a table, and
    quarantine and outcomes both start from it. Counts come from metrics observed while writing.
    """
    spark = texts.sparkSession
    schema = known[-1].contract
    fields = schemas.extraction_fields(schema)

    tokens = costs.extract_tokens(F.col(text), len(fields))
    breached = False
    if max_tokens is not None and stop_in_order is not None:
        paid_for = affordable(texts, stop_in_order, len(fields), max_tokens, text)
        texts, breached = paid_for.rows, paid_for.breached
    elif max_tokens is not None:
        # Costs come from lengths alone; a batch that is too dear is refused before it writes.
        wanted = int(texts.agg(F.coalesce(F.sum(tokens), F.lit(0))).first()[0])
        if wanted > max_tokens:
            raise BudgetExceeded(f"the texts cost {wanted} tokens, the cap is {max_tokens}")
    spent = Observation()
    paid = texts.observe(spent, F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"))
    found = extraction.extract_proposals(paid, schema, text).select(*keep, *fields)
    complete = versions.stamp_default(found)
    tables.write_table(complete, f"{out}/extracted")
    total = int(spent.get["tokens"])
    rows = tables.read_table(spark, f"{out}/extracted")

    parted = versions.dispatch(rows, known, keep=keep)
    counts = versions.dispatch_counts(parted).first()
    if counts["n_quarantined"]:
        tables.write_table(
            versions.to_quarantine(parted.quarantined), f"{out}/raw_quarantine", mode="append"
        )
    else:
        tables.ensure_table(spark, f"{out}/raw_quarantine", schemas.QUARANTINE)

    staged = privacy.tokenise(parted.merged, schema) if tokenise else parted.merged
    judged = outcomes.judged(staged, system, adm, monoid)
    done = outcomes.write_outcomes(judged, f"{out}/outcomes")
    both = spark.read.parquet(f"{out}/outcomes")
    sides = outcomes.run_summary(both).first()
    breakdown = {}
    if isinstance(monoid.dtype, StructType) and "violations" in monoid.dtype.names:
        breakdown = {r["rule_name"]: r["n"] for r in rejection_summary(done.rejections).collect()}
    return RunResult(
        contracts=sides["contracts"],
        rejections=sides["rejections"],
        extracted=counts["n_input"],
        quarantined=counts["n_quarantined"],
        tokens=total,
        budget=max_tokens,
        rule_breakdown=breakdown,
        breached=breached,
    )


def affordable(texts: DataFrame, order: Sequence[str], n_fields: int, cap: int, text: str = "text"):
    """Texts whose extraction is still within the cap, taken in order."""
    return budgets.within_budget(texts, order, costs.extract_tokens(F.col(text), n_fields), cap)
