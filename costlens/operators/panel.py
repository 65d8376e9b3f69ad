"""The daily panel: one row per series and day, for all entities at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series as S
from ..schema import SUMMARY_DIMENSIONS

TOTAL = "total"
TOTAL_VALUE = "all"


def daily_rollup(
    billing: DataFrame, dimensions: Sequence[str] = SUMMARY_DIMENSIONS
) -> DataFrame:
    """Charges summed to one row per dataset, day and dimension combination.

    The result keeps the canonical column names, so every operator that needs
    no finer grain runs on it unchanged: one scan of the charges then serves
    the whole decision run.  Charges with and without a positive quantity stay
    apart, because rules on quantities look at the former only.
    """
    dims = [d for d in dimensions if d in billing.columns]
    sums = [c for c in ("billed_cost", "effective_cost", "quantity") if c in billing.columns]
    has_quantity = (F.col("quantity") > 0) if "quantity" in sums else F.lit(False)
    return (
        billing.groupBy(
            "dataset_id",
            F.date_trunc("day", "charge_period_start").cast("timestamp_ntz").alias("charge_period_start"),
            *dims,
            F.coalesce(has_quantity, F.lit(False)).alias("is_metered"),
        )
        .agg(*[F.sum(c).alias(c) for c in sums], F.count(F.lit(1)).alias("charge_count"))
    )


def dimension_rollup(billing: DataFrame, dimensions: Sequence[str] = SUMMARY_DIMENSIONS) -> DataFrame:
    """Charges summed to one row per dataset, day and value of one dimension; ``total`` is one more dimension.

    Each dimension is summed for itself inside the tasks, so what is shuffled grows with days and values, not
    with the combinations that the charges hold.  It serves all rules that look at one dimension at a time.
    """
    dims = [d for d in dimensions if d in billing.columns]
    quantity = F.col("quantity") if "quantity" in billing.columns else F.lit(None).cast("double")
    return (
        billing.select(
            "dataset_id",
            F.date_trunc("day", "charge_period_start").cast("timestamp_ntz").alias("charge_period_start"),
            "billed_cost",
            quantity.alias("quantity"),
            F.coalesce(quantity > 0, F.lit(False)).alias("is_metered"),
            *[F.col(d).cast("string").alias(d) for d in dims],
            F.lit(TOTAL_VALUE).alias(TOTAL),
        )
        .unpivot(
            ["dataset_id", "charge_period_start", "is_metered", "billed_cost", "quantity"], [*dims, TOTAL], "dimension", "value"
        )
        .groupBy("dataset_id", "charge_period_start", "dimension", "value", "is_metered")
        .agg(F.sum("billed_cost").alias("billed_cost"), F.sum("quantity").alias("quantity"))
    )


def of_dimension(rollup: DataFrame, dimension: str) -> DataFrame:
    """The charges of a ``dimension_rollup`` by one dimension, under canonical names."""
    return rollup.where(F.col("dimension") == dimension).withColumnRenamed("value", dimension).drop("dimension")


def with_dimensions(billing: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """The charges with an empty column for each dimension they lack."""
    absent = {d: F.lit(None).cast("string") for d in dimensions if d not in billing.columns}
    return billing.withColumns(absent) if absent else billing


def daily_series(billing: DataFrame, entity_types: Sequence[str] = ("service",)) -> DataFrame:
    """Billed cost per entity and day; ``total`` is the whole dataset.

    Charges are summed per day and combination of the asked dimensions first,
    and only those sums are copied once per entity type.  A dimension the table lacks gives no series.
    """
    dims = [e for e in entity_types if e != TOTAL]
    billing = with_dimensions(billing, dims)
    day = F.to_date("charge_period_start").alias("day")
    dated = billing.where(F.col("charge_period_start").isNotNull())
    if len(entity_types) == 1:
        value = F.col(dims[0]).cast("string") if dims else F.lit(TOTAL_VALUE)
        return (
            dated.select("dataset_id", value.alias("entity_value"), day, "billed_cost")
            .where(F.col("entity_value").isNotNull())
            .groupBy("dataset_id", "entity_value", "day")
            .agg(F.sum("billed_cost").alias("cost"))
            .select("dataset_id", F.lit(entity_types[0]).alias("entity_type"), "entity_value", "day", "cost")
        )
    joint = dated.groupBy(
        "dataset_id", day, *[F.col(d).cast("string").alias(d) for d in dims]
    ).agg(F.sum("billed_cost").alias("cost"))
    if TOTAL in entity_types:
        joint = joint.withColumn(TOTAL, F.lit(TOTAL_VALUE))
    return (
        joint.unpivot(["dataset_id", "day", "cost"], list(entity_types), "entity_type", "entity_value")
        .where(F.col("entity_value").isNotNull())
        .groupBy("dataset_id", "entity_type", "entity_value", "day")
        .agg(F.sum("cost").alias("cost"))
    )


def densify(panel: DataFrame) -> DataFrame:
    """Fill the missing days of each series with zero cost (never done by default)."""
    keys = list(S.SERIES)
    days = (
        panel.groupBy(*keys)
        .agg(F.min("day").alias("first"), F.max("day").alias("last"))
        .select(*keys, F.explode(F.sequence("first", "last")).alias("day"))
    )
    return days.join(panel, [*keys, "day"], "left").withColumn(
        "cost", F.coalesce("cost", F.lit(0.0))
    )


def with_length(panel: DataFrame, out: str = "n") -> DataFrame:
    return panel.withColumn(out, F.count(F.lit(1)).over(S.whole()))


def entities(billing: DataFrame, entity_type: str, top: int | None = None) -> DataFrame:
    """Distinct non-null entities; ``top`` keeps the most expensive ones."""
    spend = (
        with_dimensions(billing, [entity_type]).select("dataset_id", F.col(entity_type).cast("string").alias("entity_value"), "billed_cost")
        .where(F.col("entity_value").isNotNull())
        .groupBy("dataset_id", "entity_value")
        .agg(F.coalesce(F.sum("billed_cost"), F.lit(0.0)).alias("cost"))
    )
    if top is not None:
        order = Window.partitionBy("dataset_id").orderBy(F.desc("cost"), "entity_value")
        spend = spend.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= top)
    return spend.select("dataset_id", F.lit(entity_type).alias("entity_type"), "entity_value")


def date_range(billing: DataFrame) -> DataFrame:
    return billing.groupBy("dataset_id").agg(
        F.min("charge_period_start").alias("period_start"),
        F.max("charge_period_start").alias("period_end"),
    )


def with_positions(panel: DataFrame, shares: Sequence[float] = (0.6, 0.8)) -> DataFrame:
    """Row position (from 0), series length, and ``floor(share * n)`` for each share."""
    numbered = panel.withColumns(
        {
            "position": F.row_number().over(S.by_day()) - 1,
            "n": F.count(F.lit(1)).over(S.whole()),
        }
    )
    return numbered.withColumns(
        {f"split_{round(share * 100)}": F.floor(F.col("n") * F.lit(share)) for share in shares}
    )


def series_bounds(panel: DataFrame) -> DataFrame:
    """First and last day and cost of each series."""
    return panel.groupBy(*S.SERIES).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.min_by("cost", "day").alias("first_cost"),
        F.max_by("cost", "day").alias("last_cost"),
    )


def with_rolling(panel: DataFrame, window: int = 14) -> DataFrame:
    """Rolling mean and sample deviation that include the current row."""
    need = max(3, window // 2)
    spread = S.rolling(F.stddev_samp, "cost", 1 - window, 0, need)
    return panel.withColumns(
        {
            "rolling_mean": S.rolling(F.avg, "cost", 1 - window, 0, need),
            "rolling_std": F.nullif(spread, F.lit(0.0)),
        }
    )


def with_trailing_average(panel: DataFrame, window: int = 7) -> DataFrame:
    """Mean of up to ``window`` rows before the current one."""
    frame = S.by_day().rowsBetween(-window, -1)
    return panel.withColumn("trailing_average", F.avg("cost").over(frame))
