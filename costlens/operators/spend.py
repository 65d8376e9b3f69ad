"""Spend totals, breakdowns, trends and driver attribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.scores import change_pct
from ..functions.tables import renewed
from ..schema import BREAKDOWN_DIMENSIONS, SUMMARY_DIMENSIONS
from .filters import labelled

DEFAULT_CURRENCY = "USD"
GRAINS = {"daily": "day", "weekly": "week", "monthly": "month"}


def _amount(column: str):
    return F.coalesce(F.sum(column), F.lit(0.0))


def _settled_amount(column: str):
    """The same, added up by size: two values with the same few amounts get the same sum to the last digit, whatever order they come in."""
    return F.aggregate(F.sort_array(F.collect_list(column)), F.lit(0.0), lambda a, x: a + x)


def spend_totals(billing: DataFrame) -> DataFrame:
    """Billed and effective totals, period, most frequent currency (ties: lowest code).

    Rows are summed per currency first, so the most frequent one is picked
    from a handful of counts.
    """
    currency = F.col("currency") if "currency" in billing.columns else F.lit(None).cast("string")
    per_currency = billing.groupBy("dataset_id", currency.alias("currency")).agg(
        F.sum("billed_cost").alias("billed"),
        F.sum("effective_cost").alias("effective"),
        F.min("charge_period_start").alias("first"),
        F.max("charge_period_start").alias("last"),
        F.count(F.lit(1)).alias("n"),
    )
    votes = F.when(F.col("currency").isNotNull(), F.struct(-F.col("n"), "currency"))
    return per_currency.groupBy("dataset_id").agg(
        F.to_date(F.min("first")).alias("period_start"),
        F.to_date(F.max("last")).alias("period_end"),
        _amount("billed").alias("total_billed_cost"),
        _amount("effective").alias("total_effective_cost"),
        F.coalesce(F.min(votes)["currency"], F.lit(DEFAULT_CURRENCY)).alias("currency"),
    )


def cost_by_dimension(
    billing: DataFrame, dimensions: Sequence[str], *, by_month: bool = False, total: bool = False
) -> DataFrame:
    """Billed cost per (dimension, value), optionally per month and with the total.

    The charges are summed once per combination of the dimensions; only those
    sums are unpivoted.  A dimension the table lacks gives no rows.
    """
    dims = [d for d in dimensions if d in billing.columns]
    month = [F.trunc("charge_period_start", "month").alias("month")] if by_month else []
    joint = billing.groupBy("dataset_id", *month, *[labelled(d) for d in dims]).agg(
        F.sum("billed_cost").alias("cost")
    )
    if total:
        joint = joint.withColumn("total", F.lit("all"))
        dims = [*dims, "total"]
    keys = ["dataset_id", "month"] if by_month else ["dataset_id"]
    return (
        joint.unpivot([*keys, "cost"], dims, "dimension", "value")
        .groupBy(*keys, "dimension", "value")
        .agg(_amount("cost").alias("cost"))
    )


def rolled_cost_by_dimension(rollup: DataFrame, *, by_month: bool = False) -> DataFrame:
    """``cost_by_dimension``, with the total, from a ``panel.dimension_rollup``."""
    month = [F.trunc("charge_period_start", "month").alias("month")] if by_month else []
    return rollup.groupBy("dataset_id", *month, "dimension", labelled("value")).agg(_settled_amount("billed_cost").alias("cost"))


def top_per_dimension(costs: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("dataset_id", "dimension").orderBy(F.desc("cost"), "value")
    return costs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def top_breakdowns(
    billing: DataFrame, dimensions: Sequence[str] = SUMMARY_DIMENSIONS, limit: int = 20
) -> DataFrame:
    """The most expensive values of each dimension, in one scan."""
    return top_per_dimension(cost_by_dimension(billing, dimensions), limit)


def resource_breakdown(billing: DataFrame, dimension: str, limit: int = 25) -> DataFrame:
    """Billed and effective cost and charge count of the top values of one dimension.

    Effective cost falls back to billed cost only where a whole group has none.
    """
    if dimension not in BREAKDOWN_DIMENSIONS:
        raise ValueError(f"invalid dimension {dimension}: choose from {BREAKDOWN_DIMENSIONS}")
    if dimension not in billing.columns:
        billing = billing.limit(0).withColumn(dimension, F.lit(None).cast("string"))
    order = Window.partitionBy("dataset_id").orderBy(F.desc("billed_cost"), "value")
    return (
        billing.groupBy("dataset_id", labelled(dimension).alias("value"))
        .agg(
            _amount("billed_cost").alias("billed"),
            F.coalesce(F.sum("effective_cost"), _amount("billed_cost")).alias("effective_cost"),
            F.count(F.lit(1)).alias("row_count"),
        )
        .withColumnRenamed("billed", "billed_cost")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= limit)
    )


def spend_trend(billing: DataFrame, granularity: str = "daily") -> DataFrame:
    """Cost per day, ISO week (its Monday) or month; unknown granularity means daily."""
    grain = GRAINS.get(granularity, "day")
    period = F.date_trunc(grain, "charge_period_start").cast("date")
    return (
        billing.groupBy("dataset_id", period.alias("period"))
        .agg(
            _amount("billed_cost").alias("billed"),
            F.coalesce(F.sum("effective_cost"), _amount("billed_cost")).alias("effective_cost"),
        )
        .withColumnRenamed("billed", "billed_cost")
    )


def latest_months(billing: DataFrame, count: int = 2) -> DataFrame:
    """The latest existing months of each dataset with their cost, newest first."""
    newest = Window.partitionBy("dataset_id").orderBy(F.desc_nulls_last("month"))
    return (
        billing.groupBy("dataset_id", F.trunc("charge_period_start", "month").alias("month"))
        .agg(_amount("billed_cost").alias("cost"))
        .withColumn("age", F.row_number().over(newest))
        .where(F.col("age") <= count)
    )


def month_over_month(billing: DataFrame) -> DataFrame:
    """Change between the two latest existing months, whether adjacent or not.

    Pass unfiltered charges to get the change of the whole dataset, as the
    spend summary does even when a period is asked for.
    """
    def at(age: int, column: str):
        return F.max(F.when(F.col("age") == age, F.col(column)))

    pair = latest_months(billing).groupBy("dataset_id").agg(
        at(1, "month").alias("current_month"),
        at(2, "month").alias("prior_month"),
        at(1, "cost").alias("current_cost"),
        at(2, "cost").alias("prior_cost"),
    )
    return pair.withColumn("change_pct", change_pct(F.col("current_cost"), F.col("prior_cost")))


def spend_summary(billing: DataFrame, whole: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """One row per dataset: totals, month change and a value-to-cost map per dimension.

    ``whole`` are the charges without a period filter, for the month change.
    """
    maps = (
        top_breakdowns(billing, limit=limit)
        .groupBy("dataset_id")
        .agg(
            *[
                F.map_from_entries(
                    F.transform(
                        F.array_sort(
                            F.collect_list(
                                F.when(F.col("dimension") == d, F.struct("rank", "value", "cost"))
                            )
                        ),
                        lambda item: F.struct(item["value"], item["cost"]),
                    )
                ).alias(f"{d}_breakdown")
                for d in SUMMARY_DIMENSIONS
            ]
        )
    )
    change = month_over_month(billing if whole is None else whole).select(
        "dataset_id", F.col("change_pct").alias("mom_change_pct")
    )
    return (
        spend_totals(billing)
        .join(renewed(change), "dataset_id", "left")
        .join(renewed(maps), "dataset_id", "left")
    )


def cost_drivers(
    billing: DataFrame,
    top_n: int = 10,
    dimensions: Sequence[str] = SUMMARY_DIMENSIONS,
    *,
    with_change: bool = False,
) -> DataFrame:
    """The top values pooled over all dimensions, with their share of the total.

    ``with_change`` adds the change of each driver between the two latest
    months of its dataset; without it ``change_pct`` is NULL.  Either way the charges are
    read once: a value carries its months along.
    """
    return drivers_of(cost_by_dimension(billing, dimensions, by_month=with_change, total=True), top_n, dimensions, with_change=with_change)


def drivers_of(
    costs: DataFrame, top_n: int = 10, dimensions: Sequence[str] = SUMMARY_DIMENSIONS, *, with_change: bool = False
) -> DataFrame:
    """The same from the rows of ``cost_by_dimension``, with the total and, for the change, by month."""
    if with_change:
        costs = (
            costs.groupBy("dataset_id", "dimension", "value")
            .agg(_settled_amount("cost").alias("total"), F.collect_list(F.struct("month", "cost")).alias("months"))
            .withColumnRenamed("total", "cost")
        )
    # The total is one more "dimension", so it travels along and needs no join.
    whole, is_total = Window.partitionBy("dataset_id"), F.col("dimension") == "total"
    pooled = top_per_dimension(costs, top_n).withColumn("total_cost", F.max(F.when(is_total, F.col("cost"))).over(whole))
    if with_change:
        pooled = pooled.withColumn("all_months", F.max(F.when(is_total, F.sort_array("months", False))).over(whole))
    positions = F.array_position(F.array(*[F.lit(d) for d in dimensions]), F.col("dimension"))
    order = Window.partitionBy("dataset_id").orderBy(F.desc("cost"), positions, "value")
    top = (
        pooled.where(F.col("dimension") != "total")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top_n)
        .withColumn(
            "share_pct",
            F.when(F.col("total_cost") > 0, F.col("cost") / F.col("total_cost") * 100).otherwise(0.0),
        )
    )
    if with_change:
        change = change_pct(_in_month(1), _in_month(2))
        top = top.withColumn("change_pct", change)
    else:
        top = top.withColumn("change_pct", F.lit(None).cast("double"))
    return top.select(
        "dataset_id", "rank", "dimension", "value", "cost", "share_pct", "change_pct", "total_cost"
    )


def _in_month(age: int):
    """Cost of a value in the latest month of its dataset (1) or the one before (2)."""
    month = F.get("all_months", F.lit(age - 1))["month"]
    amounts = F.transform(
        F.filter("months", lambda m: m["month"].eqNullSafe(month)), lambda m: F.coalesce(m["cost"], F.lit(0.0))
    )
    found = F.aggregate(amounts, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size("all_months") >= age, found).otherwise(F.lit(0.0))


def _squared_share():
    share = F.col("cost") / F.col("total_cost")
    return F.when(F.col("total_cost") > 0, share * share).otherwise(0.0)


def concentration(drivers: DataFrame) -> DataFrame:
    """Sum of squared shares over the pooled drivers.

    The dimensions overlap, so the score can exceed 1; ``hhi_by_dimension``
    gives a proper index.
    """
    return drivers.groupBy("dataset_id").agg(F.sum(_squared_share()).alias("concentration_score"))


def with_concentration(drivers: DataFrame) -> DataFrame:
    """The drivers with the concentration of their dataset beside them."""
    return drivers.withColumn(
        "concentration_score", F.sum(_squared_share()).over(Window.partitionBy("dataset_id"))
    )


def hhi_by_dimension(
    billing: DataFrame, dimensions: Sequence[str] = SUMMARY_DIMENSIONS
) -> DataFrame:
    """Sum of squared shares over all values of each dimension, between 0 and 1.

    Uses ``sum(c**2) / sum(c)**2``, so each dimension needs one aggregation.
    """
    cost = F.col("cost")
    return (
        cost_by_dimension(billing, dimensions)
        .groupBy("dataset_id", "dimension")
        .agg(
            F.count(F.lit(1)).alias("value_count"),
            (F.sum(cost * cost) / F.nullif(F.pow(F.sum(cost), F.lit(2)), F.lit(0.0))).alias("hhi"),
        )
    )


def attribution_report(
    billing: DataFrame, top_n: int = 10, *, drivers: DataFrame | None = None
) -> DataFrame:
    """One row per dataset: total, drivers, concentration, month change, evidence lines."""
    if drivers is None:
        drivers = cost_drivers(billing, top_n)
    entry = F.struct("rank", "dimension", "value", "cost", "share_pct", "change_pct")
    listed = drivers.groupBy("dataset_id").agg(
        F.max("total_cost").alias("total_cost"),
        F.sum(_squared_share()).alias("concentration_score"),
        F.array_sort(F.collect_list(entry)).alias("top_drivers"),
    )
    change = month_over_month(billing).select(
        "dataset_id", F.col("change_pct").alias("period_over_period_change_pct")
    )
    top = F.col("top_drivers")[0]
    # The wording of the evidence lines.
    evidence = F.array(
        F.concat(F.lit("Total spend in period: "), text.money("total_cost")),
        F.concat(
            F.lit("Top cost driver: "),
            top["value"],
            F.lit(" ("),
            top["dimension"],
            F.lit(") at "),
            text.money(top["cost"]),
        ),
        F.concat(F.lit("Cost concentration (HHI): "), text.fixed("concentration_score", 3)),
    )
    return (
        listed.join(renewed(change), "dataset_id", "left")
        .withColumn("evidence", evidence)
    )
