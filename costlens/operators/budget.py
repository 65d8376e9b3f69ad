"""Extension: spend against budgets, and what a smaller budget would ask for.

The reference stores budgets but computes nothing from them; thresholds are ours.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tables import renewed
from .panel import TOTAL, TOTAL_VALUE, with_dimensions

AT_RISK_SHARE, OVER_SHARE = 0.8, 1.0

BUDGETS = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("entity_type", T.StringType()),
        T.StructField("entity_value", T.StringType()),
        T.StructField("period_type", T.StringType()),
        T.StructField("period_start", T.DateType()),
        T.StructField("period_end", T.DateType()),
        T.StructField("budget_amount", T.DoubleType()),
        T.StructField("currency", T.StringType()),
    ]
)


def _status(actual, amount):
    used = actual / F.nullif(amount, F.lit(0.0))
    return (
        F.when((used > OVER_SHARE) | (used.isNull() & (actual > 0)), "over_budget")
        .when(used >= AT_RISK_SHARE, "at_risk")
        .otherwise("on_track")
    )


def _daily(billing: DataFrame, entity_types: Sequence[str]) -> DataFrame:
    """Cost per entity, day and currency."""
    dims = [e for e in entity_types if e != TOTAL]
    billing = with_dimensions(billing, [*dims, "currency"])
    joint = (
        billing.where(F.col("charge_period_start").isNotNull())
        .groupBy(
            "dataset_id",
            F.to_date("charge_period_start").alias("day"),
            F.col("currency").alias("_currency"),
            *[F.col(d).cast("string").alias(d) for d in dims],
        )
        .agg(F.sum("billed_cost").alias("cost"))
    )
    if TOTAL in entity_types:
        joint = joint.withColumn(TOTAL, F.lit(TOTAL_VALUE))
    return (
        joint.unpivot(["dataset_id", "day", "_currency", "cost"], list(entity_types), "_type", "_value")
        .where(F.col("_value").isNotNull())
        .groupBy("dataset_id", "_type", "_value", "day", "_currency")
        .agg(F.sum("cost").alias("cost"))
    )


def budget_variance(billing: DataFrame, budgets: DataFrame, entity_types: Sequence[str]) -> DataFrame:
    """Actual spend, variance and status of every budget and dataset it meets.

    Charges are summed per entity, day and currency before they meet the budgets, and the
    join is an equality on the entity, so only the days of one entity are compared
    with its own budgets.  Spend counts towards budgets of its currency and budgets without one;
    a table without currencies counts towards all.
    A budget without spend keeps its row.

    The budgets are the small side of an inner join, which Spark may broadcast by its own
    size check or whose hot entities it may split; the sums, one for each budget and
    dataset, then meet the budgets again.
    """
    panel = _daily(billing, entity_types)
    same_currency = F.col("currency").isNull() | F.col("_currency").eqNullSafe(F.col("currency"))
    if "currency" not in billing.columns:
        same_currency = F.lit(True)
    spent = (
        panel.join(
            renewed(budgets),
            (F.col("entity_type") == F.col("_type"))
            & (F.col("entity_value") == F.col("_value"))
            & same_currency
            & F.col("day").between(F.col("period_start"), F.col("period_end")),
        )
        .groupBy("dataset_id", *budgets.columns)
        .agg(F.sum("cost").alias("spent"))
        .withColumnsRenamed({c: f"_{c}" for c in budgets.columns})
    )
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in budgets.columns]
    actual, amount = F.col("actual_spend"), F.col("budget_amount")
    return (
        budgets.distinct()
        .join(spent, same, "left")
        .select("dataset_id", *budgets.columns, F.coalesce("spent", F.lit(0.0)).alias("actual_spend"))
        .withColumns(
            {
                "variance": actual - amount,
                "variance_pct": (actual - amount) / F.nullif(amount, F.lit(0.0)) * 100,
                "status": _status(actual, amount),
            }
        )
    )


def budget_reduction(variance: DataFrame, pct: float) -> DataFrame:
    """The same spend against budgets cut by ``pct`` percent."""
    if not 0 < pct < 100:
        raise ValueError("a budget reduction lies between 0 and 100 percent")
    actual, reduced = F.col("actual_spend"), F.col("reduced_budget")
    return variance.withColumn("reduced_budget", F.col("budget_amount") * (1 - pct / 100)).withColumns(
        {
            "required_savings": F.greatest(F.lit(0.0), actual - reduced),
            "reduced_status": _status(actual, reduced),
        }
    )
