"""Saving opportunities: four rules over drivers, anomalies and metered usage.

Billing data says what was charged, not how well it was used, so every text
names a candidate for investigation and never claims waste.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, text
from .anomaly import run_detection
from .filters import labelled, metered
from .panel import of_dimension
from .spend import cost_drivers, drivers_of, rolled_cost_by_dimension, with_concentration

# Rule thresholds, savings factors and confidences.
GROWTH_PCT, GROWTH_CAP, GROWTH_DIVISOR, GROWTH_CONFIDENCE = 20.0, 0.3, 200, 0.7
CONCENTRATION_THRESHOLD, CONCENTRATION_CONFIDENCE = 0.6, 0.6
DIVERGENCE_PCT, DIVERGENCE_RATIO = 15, 1.5
DIVERGENCE_SAVINGS, DIVERGENCE_CONFIDENCE = 0.1, 0.6
REPORT_LIMIT = 50

RULE_ORDER = ("cost_growth", "cost_spike", "cost_concentration", "quantity_growth")


def _opportunities(
    source: DataFrame,
    kind: str,
    entity: Column,
    description: Column,
    evidence: Column,
    savings: Column,
    confidence: Column,
    priority: Column,
    *discriminator: Column,
) -> DataFrame:
    return source.select(
        scores.stable_id(F.col("dataset_id"), F.lit(kind), entity, *discriminator).alias("opportunity_id"),
        "dataset_id",
        F.lit(kind).alias("opportunity_type"),
        entity.alias("entity"),
        description.alias("description"),
        evidence.alias("evidence"),
        savings.cast("double").alias("potential_savings_estimate"),
        confidence.cast("double").alias("confidence"),
        priority.alias("priority_score"),
    )


def _entity(kind: Column, value: Column) -> Column:
    return F.concat(kind, F.lit(":"), value)


def cost_growth(drivers: DataFrame, threshold_pct: float = GROWTH_PCT) -> DataFrame:
    """Drivers whose cost changed by at least the threshold between two months."""
    # Fixed values here and in the other rules: the sentences of a report.
    change, cost = F.col("change_pct"), F.col("cost")
    fired = drivers.where(F.abs(change) >= threshold_pct)
    dimension, value = F.col("dimension"), F.col("value")
    return _opportunities(
        fired,
        "cost_growth",
        _entity(dimension, value),
        F.concat(
            value, F.lit(" ("), dimension, F.lit(") is a candidate for investigation. Billed cost changed "),
            text.signed_percent(change), F.lit(" period-over-period ("), text.money(cost),
            F.lit(" current spend, "), text.percent("share_pct"), F.lit(" of total)."),
        ),
        F.array(
            F.concat(F.lit("Dimension: "), dimension),
            F.concat(F.lit("Entity: "), value),
            F.concat(F.lit("Current period cost: "), text.money(cost)),
            F.concat(F.lit("Period-over-period change: "), text.signed_percent(change)),
            F.concat(F.lit("Share of total spend: "), text.percent("share_pct")),
            F.lit("Data source: deterministic cost analytics"),
        ),
        cost * F.least(F.lit(GROWTH_CAP), F.abs(change) / GROWTH_DIVISOR),
        F.lit(GROWTH_CONFIDENCE),
        scores.priority(F.lit(5), change, cost),
    )


def cost_spike(anomalies: DataFrame) -> DataFrame:
    """High and critical anomalies; the saving is what was paid above expectation."""
    fired = anomalies.where(F.col("severity").isin("high", "critical"))
    kind, value = F.col("entity_type"), F.col("entity_value")
    actual, expected = F.col("actual_cost"), F.col("expected_cost")
    evidence = F.col("supporting_evidence")
    return _opportunities(
        fired,
        "cost_spike",
        _entity(kind, value),
        F.concat(
            value, F.lit(" ("), kind, F.lit(") had a "), F.col("severity"),
            F.lit(" cost spike. Billed cost was "), text.money(actual), F.lit(" vs expected "),
            text.money(expected), F.lit(" ("), text.signed_percent("deviation_pct"),
            F.lit("). This is a candidate for investigation."),
        ),
        evidence,
        F.greatest(F.lit(0.0), actual - expected),
        F.col("confidence"),
        scores.priority(F.size(evidence), F.col("deviation_pct"), actual),
        F.col("day").cast("string"),
        F.col("method"),
    )


def cost_concentration(
    drivers: DataFrame, threshold: float = CONCENTRATION_THRESHOLD
) -> DataFrame:
    """The top driver of datasets whose concentration reaches the threshold."""
    # A dataset has at most ``top_n`` drivers, so the window holds a handful of rows.
    scored = with_concentration(drivers).where(F.col("rank") == 1)
    score, total = F.col("concentration_score"), F.col("total_cost")
    dimension, value = F.col("dimension"), F.col("value")
    return _opportunities(
        scored.where(score >= threshold),
        "cost_concentration",
        _entity(dimension, value),
        F.concat(
            F.lit("Spend is concentrated: "), value, F.lit(" ("), dimension, F.lit(") represents "),
            text.percent("share_pct"),
            F.lit(" of total spend. High concentration may indicate dependency risk or optimization opportunity."),
        ),
        F.array(
            F.concat(F.lit("HHI concentration score: "), text.fixed(score, 3)),
            F.concat(
                F.lit("Top entity: "), value, F.lit(" ("), dimension, F.lit(") = "),
                text.percent("share_pct"), F.lit(" of spend"),
            ),
            F.concat(F.lit("Total spend: "), text.money(total)),
        ),
        F.lit(0.0),
        F.lit(CONCENTRATION_CONFIDENCE),
        scores.priority(F.lit(3), score * 100, total),
    )


def monthly_service_usage(billing: DataFrame) -> DataFrame:
    """Cost and quantity of metered charges per service and month.

    A table without services or quantities has none.
    """
    absent = {c: t for c, t in (("service", "string"), ("quantity", "double")) if c not in billing.columns}
    if absent:
        billing = billing.where(F.lit(False)).withColumns({c: F.lit(None).cast(t) for c, t in absent.items()})
    return (
        metered(billing)
        .where(F.col("charge_period_start").isNotNull())
        .groupBy(
            "dataset_id",
            labelled("service"),
            F.trunc("charge_period_start", "month").alias("month"),
        )
        .agg(
            F.coalesce(F.sum("billed_cost"), F.lit(0.0)).alias("cost"),
            F.sum("quantity").alias("quantity"),
        )
    )


def latest_usage_change(usage: DataFrame) -> DataFrame:
    """Last month of each service beside the one before it; one-month services drop out.

    A change is 0 where the earlier month has nothing to compare with.
    """
    w = Window.partitionBy("dataset_id", "service").orderBy("month")
    return (
        usage.withColumns(
            {
                "prior_cost": F.lag("cost").over(w),
                "prior_quantity": F.lag("quantity").over(w),
                "prior_month": F.lag("month").over(w),
                "_next": F.lead("month").over(w),
            }
        )
        .where(F.col("_next").isNull() & F.col("prior_month").isNotNull())
        .drop("_next")
        .withColumns(
            {
                "cost_change": F.coalesce(
                    scores.change_pct(F.col("cost"), F.col("prior_cost")), F.lit(0.0)
                ),
                "quantity_change": F.coalesce(
                    scores.change_pct(F.col("quantity"), F.col("prior_quantity")), F.lit(0.0)
                ),
            }
        )
    )


def quantity_growth(billing: DataFrame) -> DataFrame:
    """Services whose cost grew clearly faster than their billed quantity."""
    cost_up, quantity_up, cost = F.col("cost_change"), F.col("quantity_change"), F.col("cost")
    fired = latest_usage_change(monthly_service_usage(billing)).where(
        (cost_up > DIVERGENCE_PCT) & (cost_up > quantity_up * DIVERGENCE_RATIO)
    )
    service = F.col("service")
    return _opportunities(
        fired,
        "quantity_growth",
        _entity(F.lit("service"), service),
        F.concat(
            service, F.lit(" is a candidate for investigation: billed cost increased "),
            text.percent(cost_up), F.lit(" while billed quantity changed "), text.percent(quantity_up),
            F.lit(". This may indicate a pricing change, tier upgrade, or new resource usage."),
        ),
        F.array(
            F.concat(F.lit("Cost change: "), text.signed_percent(cost_up)),
            F.concat(F.lit("Quantity change: "), text.signed_percent(quantity_up)),
            F.concat(F.lit("Current month cost: "), text.money(cost)),
            F.lit("Note: This analysis is based on billing data only. Utilization data is not available."),
        ),
        cost * DIVERGENCE_SAVINGS,
        F.lit(DIVERGENCE_CONFIDENCE),
        scores.priority(F.lit(4), cost_up, cost),
    )


def all_rules(billing: DataFrame, drivers: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Opportunities of all four rules."""
    found = cost_growth(drivers)
    for more in (cost_spike(anomalies), cost_concentration(drivers), quantity_growth(billing)):
        found = found.unionByName(more)
    return found


def ranked(opportunities: DataFrame, limit: int = REPORT_LIMIT) -> DataFrame:
    """Highest priority first; equal scores keep rule order, then larger savings."""
    rule = F.array_position(F.array(*[F.lit(r) for r in RULE_ORDER]), F.col("opportunity_type"))
    order = Window.partitionBy("dataset_id").orderBy(
        F.desc("priority_score"),
        F.when(rule == 0, len(RULE_ORDER) + 1).otherwise(rule),
        F.desc("potential_savings_estimate"),
        "opportunity_id",
    )
    return opportunities.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def totals(opportunities: DataFrame) -> DataFrame:
    """Count and potential savings per dataset, before any report limit."""
    return opportunities.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("total_opportunities"),
        F.sum("potential_savings_estimate").alias("total_potential_savings"),
    )


def find(billing: DataFrame, anomalies: DataFrame, top_n: int = 10) -> DataFrame:
    """All opportunities of all datasets, driver changes included."""
    return all_rules(billing, cost_drivers(billing, top_n, with_change=True), anomalies)


def find_rolled(rollup: DataFrame, top_n: int = 10) -> DataFrame:
    """The same from a ``panel.dimension_rollup``; anomalies are those of services."""
    services = of_dimension(rollup, "service")
    drivers = drivers_of(rolled_cost_by_dimension(rollup, by_month=True), top_n, with_change=True)
    return all_rules(services, drivers, run_detection(services))
