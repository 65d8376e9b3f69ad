"""Extensions on prices and discounts that the reference names but does not compute."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SUMMARY_DIMENSIONS
from .filters import labelled, metered

ON_DEMAND = "On-Demand"


def discount_rate(billing: DataFrame, dimension: str) -> DataFrame:
    """One minus effective over list cost per value of a dimension."""
    return (
        billing.groupBy("dataset_id", labelled(dimension).alias("value"))
        .agg(F.sum("effective_cost").alias("effective_cost"), F.sum("list_cost").alias("list_cost"))
        .withColumn(
            "discount_rate", 1 - F.col("effective_cost") / F.nullif(F.col("list_cost"), F.lit(0.0))
        )
    )


def change_contributors(
    billing: DataFrame,
    before: tuple[str, str],
    after: tuple[str, str],
    dimensions: Sequence[str] = SUMMARY_DIMENSIONS,
    top_n: int = 10,
) -> DataFrame:
    """What moved spend between two date ranges (first and last day of each).

    Per dimension the values with the largest absolute change, their share of the
    change of the dataset, and its split into a volume part (more units at the old
    price) and a price part (new price on the new units) where both ranges have units.
    """
    day = F.to_date("charge_period_start")

    def within(bounds: tuple[str, str]):
        return day.between(F.lit(bounds[0]).cast("date"), F.lit(bounds[1]).cast("date"))

    sides = {"before": within(before), "after": within(after)}
    dims = [d for d in dimensions if d in billing.columns]
    joint = (
        billing.where(sides["before"] | sides["after"])
        .groupBy("dataset_id", *[labelled(d) for d in dims])
        .agg(
            *[F.sum(F.when(side, F.col("billed_cost")).otherwise(0.0)).alias(f"cost_{n}") for n, side in sides.items()],
            *[F.sum(F.when(side, F.col("quantity")).otherwise(0.0)).alias(f"units_{n}") for n, side in sides.items()],
        )
    )
    measures = ["cost_before", "cost_after", "units_before", "units_after"]
    values = (
        joint.withColumn("total", F.lit("all"))
        .unpivot(["dataset_id", *measures], [*dims, "total"], "dimension", "value")
        .groupBy("dataset_id", "dimension", "value")
        .agg(*[F.sum(m).alias(m) for m in measures])
        .withColumn("delta", F.col("cost_after") - F.col("cost_before"))
    )
    order = Window.partitionBy("dataset_id", "dimension").orderBy(F.desc(F.abs("delta")), "value")
    top = values.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)
    # The total is the only value of its dimension, so it survives the cut above.
    whole = F.max(F.when(F.col("dimension") == "total", F.col("delta"))).over(
        Window.partitionBy("dataset_id")
    )
    price_before = F.col("cost_before") / F.nullif(F.col("units_before"), F.lit(0.0))
    price_after = F.col("cost_after") / F.nullif(F.col("units_after"), F.lit(0.0))
    return (
        top.withColumn("total_delta", whole)
        .where(F.col("dimension") != "total")
        .withColumns(
            {
                "share_of_change": F.col("delta") / F.nullif(F.col("total_delta"), F.lit(0.0)),
                "volume_effect": F.when(
                    price_after.isNotNull(), (F.col("units_after") - F.col("units_before")) * price_before
                ),
                "price_effect": (price_after - price_before) * F.col("units_after"),
            }
        )
    )


def commitment_candidates(
    billing: DataFrame, min_share: float = 0.5, max_variation: float = 0.5
) -> DataFrame:
    """Services whose on-demand spend is large and steady from day to day."""
    on_demand = F.when(F.col("pricing_category") == ON_DEMAND, F.col("billed_cost")).otherwise(0.0)
    daily = (
        billing.where(F.col("charge_period_start").isNotNull())
        .groupBy("dataset_id", labelled("service"), F.to_date("charge_period_start").alias("day"))
        .agg(F.sum(on_demand).alias("on_demand"), F.sum("billed_cost").alias("cost"))
    )
    profile = daily.groupBy("dataset_id", "service").agg(
        F.sum("on_demand").alias("on_demand_cost"),
        (F.sum("on_demand") / F.nullif(F.sum("cost"), F.lit(0.0))).alias("on_demand_share"),
        (F.stddev_samp("on_demand") / F.nullif(F.avg("on_demand"), F.lit(0.0))).alias("variation"),
    )
    return profile.withColumn(
        "is_candidate",
        F.coalesce(
            (F.col("on_demand_share") >= min_share) & (F.col("variation") <= max_variation), F.lit(False)
        ),
    )


def regional_price_gaps(billing: DataFrame, min_gap_pct: float = 20.0) -> DataFrame:
    """SKU prices by region against the cheapest region of the same SKU."""
    prices = (
        metered(billing)
        .where(F.col("sku").isNotNull() & F.col("region").isNotNull())
        .groupBy("dataset_id", "sku", "region")
        .agg(F.sum("billed_cost").alias("cost"), F.sum("quantity").alias("quantity"))
        .withColumn("unit_price", F.col("cost") / F.col("quantity"))
        .where(F.col("unit_price") > 0)
    )
    # At most one row per region and SKU reaches this window.
    cheapest = Window.partitionBy("dataset_id", "sku")
    return (
        prices.withColumn("lowest_price", F.min("unit_price").over(cheapest))
        .withColumn("gap_pct", (F.col("unit_price") / F.col("lowest_price") - 1) * 100)
        .withColumns(
            {
                "potential_savings": F.col("cost") - F.col("lowest_price") * F.col("quantity"),
                "is_candidate": F.col("gap_pct") >= min_gap_pct,
            }
        )
    )


def idle_candidates(billing: DataFrame) -> DataFrame:
    """Resources that cost money while no quantity was billed."""
    return (
        billing.where(F.col("resource").isNotNull())
        .groupBy("dataset_id", "resource")
        .agg(
            F.sum("billed_cost").alias("cost"),
            F.sum("quantity").alias("quantity"),
            F.count(F.lit(1)).alias("row_count"),
        )
        .where((F.col("cost") > 0) & (F.coalesce("quantity", F.lit(0.0)) == 0))
    )
