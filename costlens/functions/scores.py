"""Score columns shared by detectors, rules and scenarios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity by absolute deviation in percent (upper bounds).
SEVERITY_BOUNDS = ((25, "low"), (50, "medium"), (100, "high"))
SEVERITY_TOP = "critical"

# Weights of the priority score and where each part saturates.
EVIDENCE_WEIGHT, EVIDENCE_FULL = 0.3, 5
DEVIATION_WEIGHT, DEVIATION_FULL = 0.4, 100
COST_WEIGHT, COST_FULL = 0.3, 10000


def deviation_pct(actual: Column, expected: Column) -> Column:
    """Percent distance from the expected value; 0 where nothing was expected."""
    return F.when(expected != 0, (actual - expected) / F.abs(expected) * 100).otherwise(F.lit(0.0))


def severity(deviation: Column) -> Column:
    size = F.abs(deviation)
    label = F.lit(SEVERITY_TOP)
    for bound, name in reversed(SEVERITY_BOUNDS):
        label = F.when(size < bound, name).otherwise(label)
    return label


def severity_rank(label: Column) -> Column:
    """0 for critical, rising as severity falls."""
    order = [SEVERITY_TOP] + [name for _, name in reversed(SEVERITY_BOUNDS)]
    rank = F.lit(len(order))
    for position, name in enumerate(order):
        rank = F.when(label == name, position).otherwise(rank)
    return rank


def confidence(z: Column, threshold: Column) -> Column:
    """Reaches 1 at twice the detection threshold."""
    return F.least(F.lit(1.0), F.abs(z) / (threshold * 2))


def priority(evidence_count: Column, deviation: Column, cost: Column) -> Column:
    """Weighted urgency between 0 and 1, 4 digits."""
    evidence_part = F.least(F.lit(1.0), evidence_count / EVIDENCE_FULL)
    deviation_part = F.least(F.lit(1.0), F.abs(deviation) / DEVIATION_FULL)
    cost_part = F.least(F.lit(1.0), cost / COST_FULL)
    return F.round(
        evidence_part * EVIDENCE_WEIGHT
        + deviation_part * DEVIATION_WEIGHT
        + cost_part * COST_WEIGHT,
        4,
    )


def change_pct(current: Column, previous: Column) -> Column:
    """Percent change; NULL unless the previous value is positive."""
    return F.when(previous > 0, (current - previous) / previous * 100)


def stable_id(*parts: Column) -> Column:
    """The same id for the same parts, on every run."""
    return F.sha2(F.concat_ws("|", *parts), 256)
