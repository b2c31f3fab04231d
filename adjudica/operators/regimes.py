"""Named bundles of rules and their composition.

A bundle is a list of decisions plus tags; composing bundles concatenates both, and adding a rule
puts it at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

from adjudica.operators import rules
from adjudica.operators.decisions import AnyDecision, Rule, lift_all


@dataclass(frozen=True)
class Regime:
    decisions: tuple[AnyDecision, ...] = ()
    tags: tuple[tuple[str, str], ...] = ()

    def __add__(self, other: Regime) -> Regime:
        return Regime(self.decisions + other.decisions, self.tags + other.tags)

    def add_rule(self, rule: AnyDecision) -> Regime:
        return Regime((*self.decisions, rule), self.tags)

    @property
    def rules(self) -> list[Rule]:
        return [d for d in self.decisions if isinstance(d, Rule)]


def compose(*regimes: Regime) -> Regime:
    return sum(regimes, Regime())


def federal() -> Regime:
    return Regime((rules.federal_aca_min_loss_ratio(), rules.federal_protected_class()))


def california() -> Regime:
    return Regime((rules.ca_min_auto_liability(), rules.ca_prop_103()))


def new_york() -> Regime:
    return Regime((rules.ny_min_auto_liability(),))


def internal_underwriting() -> Regime:
    return Regime(
        (
            rules.reinsurance_cession(100000.0, 0.5),
            rules.explainability(0.6),
            rules.rate_stability(0.25),
            rules.consent(),
        )
    )


def basic_governance() -> Regime:
    return Regime((rules.positive_premium(), rules.max_loss_ratio(0.85), rules.coverage_cap(10.0)))


def stated_guards() -> Regime:
    """What rules by place and line are chosen by has to be there."""
    return Regime((rules.unknown_jurisdiction(), rules.unknown_product_line()))


def risk_budget() -> Regime:
    return Regime(
        (
            rules.high_coverage_risk(),
            rules.low_explainability_risk(),
            rules.high_loss_ratio_risk(),
        )
    )


def joint() -> Regime:
    """Underwriting hygiene and the risk budget, both lifted into (violations, score)."""
    return Regime(tuple(lift_all([*basic_governance().decisions, *risk_budget().decisions])))


def california_regime() -> Regime:
    return compose(federal(), california(), internal_underwriting(), basic_governance(), stated_guards())


def new_york_regime() -> Regime:
    return compose(federal(), new_york(), internal_underwriting(), basic_governance(), stated_guards())


def proposal_joint(zip_weight: float = 0.5, age_weight: float = 0.3) -> Regime:
    """Flat-proposal regime: the premium rule, and the ZIP and age scores."""
    return Regime(
        tuple(
            lift_all(
                [
                    rules.premium(),
                    rules.risk_score_zip(zip_weight),
                    rules.risk_score_age(age_weight),
                ]
            )
        )
    )


def demo() -> Regime:
    return Regime((rules.demo_protected_class(), rules.demo_prop_103()))
