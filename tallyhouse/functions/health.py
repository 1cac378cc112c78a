"""The account health score: points off for trouble, points on for growth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------
START = 100
PER_BREACH = 6
DEBT_DIVISOR, DEBT_CAP = 250, 20
OUTAGE_DIVISOR, OUTAGE_CAP = 20, 20
CSAT_TOP, PER_CSAT_POINT = 5, 6
GROWTH_DIVISOR, GROWTH_FLOOR, GROWTH_CAP = 3, -15, 10
AT_RISK_BELOW = 40
HEALTHY_FROM = 70
# ----------------------------------------------------------------------------


def _capped(points: Column, cap: float) -> Column:
    return F.least(F.lit(float(cap)), points)


def components(
    breaches: Column, overdue: Column, outage: Column, csat: Column, growth: Column
) -> dict[str, Column]:
    """Each part of the score under its own name; deductions are positive numbers."""
    return {
        "breach_points": (breaches * PER_BREACH).cast("double"),
        "debt_points": _capped(overdue / F.lit(float(DEBT_DIVISOR)), DEBT_CAP),
        "outage_points": _capped(outage / F.lit(float(OUTAGE_DIVISOR)), OUTAGE_CAP),
        "csat_points": F.coalesce((CSAT_TOP - csat) * PER_CSAT_POINT, F.lit(0.0)),
        "growth_points": _capped(
            F.greatest(F.lit(float(GROWTH_FLOOR)), growth / F.lit(float(GROWTH_DIVISOR))), GROWTH_CAP
        ),
    }


def health_score(
    breaches: Column, overdue: Column, outage: Column, csat: Column, growth: Column
) -> Column:
    """The score itself, between 0 and 100."""
    part = components(breaches, overdue, outage, csat, growth)
    total = (
        F.lit(float(START))
        - part["breach_points"]
        - part["debt_points"]
        - part["outage_points"]
        - part["csat_points"]
        + part["growth_points"]
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))
