"""What-if savings over tables of recommendations.

Every figure is an estimate under stated assumptions, never a realized saving.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.tables import renewed

USAGE, PRICE = "usage_reduction", "price_change"
IMPLEMENT, BUDGET = "recommendation_implementation", "budget_reduction"

# Default percentage and confidence per scenario type.
DEFAULT_PCT = {USAGE: 10.0, PRICE: -10.0, IMPLEMENT: 10.0}
CONFIDENCE = {USAGE: 0.5, PRICE: 0.4, IMPLEMENT: 0.6}
DEFAULT_HORIZON = 30
ESTIMATED = "ESTIMATED SAVINGS — not realized savings"


@dataclass(frozen=True)
class Scenario:
    """One what-if question; ``pct`` defaults by type.

    ``assumptions`` and ``confidence`` of the caller replace those of the type; the line that
    says the savings are estimates always stays.
    """

    scenario_type: str
    pct: float | None = None
    horizon_days: int = DEFAULT_HORIZON
    assumptions: Sequence[str] | None = None
    confidence: float | None = None

    def __post_init__(self) -> None:
        if self.scenario_type not in DEFAULT_PCT:
            raise ValueError(f"unknown scenario type: {self.scenario_type}")
        if self.confidence is not None and not 0 <= self.confidence <= 1:
            raise ValueError("a confidence lies between 0 and 1")

    def as_struct(self) -> Column:
        pct = DEFAULT_PCT[self.scenario_type] if self.pct is None else float(self.pct)
        return F.struct(
            F.lit(self.scenario_type).alias("scenario_type"),
            F.lit(pct).alias("pct"),
            F.lit(self.horizon_days).alias("time_horizon_days"),
            (
                F.lit(None) if self.assumptions is None else F.array(*[F.lit(a) for a in (*self.assumptions, ESTIMATED)])
            ).cast("array<string>").alias("_assumptions"),
            F.lit(self.confidence).cast("double").alias("_confidence"),
        )


def _by_type(cases: dict[str, Column]) -> Column:
    kind = F.col("scenario_type")
    chain = None
    for name, value in cases.items():
        chain = F.when(kind == name, value) if chain is None else chain.when(kind == name, value)
    return chain


def _estimate(rows: DataFrame, confidence: Column, assumptions: Column) -> DataFrame:
    """Projected cost and savings from ``current_cost``, ``pct`` and ``scenario_type``.

    A usage reduction outside (0, 100) percent keeps its row, marked invalid,
    with no projection.
    """
    cost, pct = F.col("current_cost"), F.col("pct")
    valid = (F.col("scenario_type") != USAGE) | ((pct > 0) & (pct < 100))
    projected = _by_type(
        {
            USAGE: cost * (1 - pct / 100),
            PRICE: cost * (1 + pct / 100),
            IMPLEMENT: cost - cost * (pct / 100),
        }
    )
    name = F.when(F.col("entity") != "", F.col("entity")).otherwise("entity")
    unsigned = text.percent("pct")
    description = _by_type(
        {
            USAGE: F.concat(F.lit("Usage reduction of "), unsigned, F.lit(" for "), name),
            PRICE: F.concat(F.lit("Provider price change of "), text.signed_percent("pct"), F.lit(" for "), name),
            IMPLEMENT: F.concat(F.lit("Implementing recommendation for "), name),
        }
    )
    return (
        rows.withColumn("is_valid", valid)
        .withColumn("projected_cost", F.when(F.col("is_valid"), projected))
        .withColumns(
            {
                "scenario_description": description,
                "estimated_savings": F.col("current_cost") - F.col("projected_cost"),
                "estimated_savings_pct": F.when(
                    F.col("is_valid"), F.when(F.col("scenario_type") == PRICE, -pct).otherwise(pct)
                ),
                "assumptions": assumptions,
                "confidence": confidence,
            }
        )
    )


def simulate(items: DataFrame, scenarios: Sequence[Scenario]) -> DataFrame:
    """Every scenario for every item (``recommendation_id``, ``entity``, ``current_cost``).

    The scenarios are literals in the plan: each row is copied once per
    question asked, without a join.
    """
    asked = items.withColumn("_s", F.explode(F.array(*[s.as_struct() for s in scenarios]))).select(
        *items.columns, "_s.*"
    )
    label = F.lit(ESTIMATED)
    assumptions = _by_type(
        {
            USAGE: F.array(
                F.concat(F.lit("Usage volume decreases by "), text.percent("pct")),
                F.lit("Unit pricing remains constant"),
                F.lit("No new workloads added"),
                F.lit("Based on billing data only — utilization data not available"),
                label,
            ),
            PRICE: F.array(
                F.concat(F.lit("Unit pricing changes by "), text.signed_percent("pct")),
                F.lit("Usage volume remains constant"),
                F.lit("No contractual lock-in"),
                label,
            ),
            IMPLEMENT: F.array(label),
        }
    )
    confidence = _by_type({k: F.lit(v) for k, v in CONFIDENCE.items()})
    return _estimate(
        asked, F.coalesce("_confidence", confidence), F.coalesce("_assumptions", assumptions)
    ).drop("_assumptions", "_confidence")


# How a recommendation's own estimate is derived from its confidence.
MIN_CONFIDENCE, MAX_PCT, PCT_PER_CONFIDENCE, CONFIDENCE_DISCOUNT = 0.1, 30, 30, 0.8


def implementation_savings(recommendations: DataFrame, opportunities: DataFrame) -> DataFrame:
    """Estimated savings of implementing each recommendation.

    Inner join on the opportunity: a recommendation without one is skipped.
    Both sides hold at most a report's worth of rows per dataset.
    """
    facts = opportunities.select(
        "opportunity_id", "entity", "evidence", "confidence", "potential_savings_estimate"
    )
    advised = recommendations.select("dataset_id", "recommendation_id", "opportunity_id", "priority_rank")
    return savings_from_facts(advised.join(renewed(facts), "opportunity_id"))


def savings_from_facts(recommendations: DataFrame) -> DataFrame:
    """The same for recommendations that carry the facts of their opportunity."""
    sure = F.col("_sure")
    rows = recommendations.select(
        "dataset_id",
        "recommendation_id",
        "opportunity_id",
        "priority_rank",
        "entity",
        "evidence",
        F.col("confidence").alias("_sure"),
        F.lit(IMPLEMENT).alias("scenario_type"),
        F.lit(DEFAULT_HORIZON).alias("time_horizon_days"),
        (
            F.col("potential_savings_estimate") / F.greatest(F.lit(MIN_CONFIDENCE), F.col("confidence"))
        ).alias("current_cost"),
        F.least(F.lit(float(MAX_PCT)), F.col("confidence") * PCT_PER_CONFIDENCE).alias("pct"),
    )
    stated = F.concat(F.col("evidence"), F.array(F.lit(ESTIMATED)))
    return _estimate(rows, sure * CONFIDENCE_DISCOUNT, stated).drop("evidence", "_sure")


def total_savings(estimates: DataFrame) -> DataFrame:
    return estimates.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("savings_count"),
        F.sum("estimated_savings").alias("total_estimated_savings"),
    )
