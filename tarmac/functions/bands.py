"""Decision, risk and confidence bands over a delay probability."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarmac.schema import DELAYED, ON_TIME

# ---------------------------------------------------------------------------
# Band cuts and texts.
# ---------------------------------------------------------------------------

# Scheme A (service responses): upper cuts, exclusive.
RISK_SCHEME_A = [(0.3, "LOW"), (0.5, "MODERATE"), (0.7, "HIGH")]
RISK_SCHEME_A_TOP = "VERY HIGH"

# Scheme B (interactive form): upper cuts, exclusive, with advice text.
RISK_SCHEME_B = [(0.25, "LOW RISK"), (0.45, "MODERATE RISK"), (0.65, "HIGH RISK")]
RISK_SCHEME_B_TOP = "VERY HIGH RISK"
RISK_ADVICE_B = {
    "LOW RISK": "This flight has a low probability of delay.",
    "MODERATE RISK": "Some chance of delay. Monitor flight status.",
    "HIGH RISK": "Significant chance of delay. Allow buffer time.",
    "VERY HIGH RISK": "Very likely to be delayed. Plan accordingly.",
}

# Confidence by distance from 0.5, lower cuts exclusive.
CONFIDENCE_CUTS = [(0.35, "HIGH"), (0.2, "MEDIUM")]
CONFIDENCE_DEFAULT = "LOW"

DECISION_CUT = 0.5


def decision(p: Column, cut: float = DECISION_CUT) -> Column:
    """'Delayed' when p >= cut (inclusive), else 'On Time'."""
    return F.when(p >= F.lit(cut), F.lit(DELAYED)).when(p.isNotNull(), F.lit(ON_TIME))


def predicted_class(p: Column, cut: float = DECISION_CUT) -> Column:
    """Class 1 when p > cut (strict), as an argmax over two probabilities."""
    return (p > F.lit(cut)).cast("int")


def _bands(p: Column, cuts, top: str) -> Column:
    expr = None
    for cut, name in cuts:
        expr = F.when(p < F.lit(cut), F.lit(name)) if expr is None else expr.when(p < F.lit(cut), F.lit(name))
    return expr.when(p.isNotNull(), F.lit(top))


def risk_level(p: Column, scheme: str = "A") -> Column:
    if scheme == "A":
        return _bands(p, RISK_SCHEME_A, RISK_SCHEME_A_TOP)
    if scheme == "B":
        return _bands(p, RISK_SCHEME_B, RISK_SCHEME_B_TOP)
    if scheme == "two-way":
        return F.when(p >= F.lit(DECISION_CUT), F.lit("HIGH")).when(p.isNotNull(), F.lit("LOW"))
    raise ValueError(f"unknown risk scheme {scheme!r}")


def risk_advice(level_b: Column) -> Column:
    expr = None
    for name, text in RISK_ADVICE_B.items():
        expr = F.when(level_b == name, F.lit(text)) if expr is None else expr.when(level_b == name, F.lit(text))
    return expr


def confidence(p: Column) -> Column:
    margin = F.abs(p - F.lit(0.5))
    expr = None
    for cut, name in CONFIDENCE_CUTS:
        expr = F.when(margin > F.lit(cut), F.lit(name)) if expr is None else expr.when(margin > F.lit(cut), F.lit(name))
    return expr.when(p.isNotNull(), F.lit(CONFIDENCE_DEFAULT))
