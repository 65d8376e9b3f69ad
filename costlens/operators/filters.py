"""Row filters and dimension labels used by every operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import UNKNOWN


def in_period(
    billing: DataFrame,
    start: str | None = None,
    end: str | None = None,
    *,
    end_inclusive: bool = False,
) -> DataFrame:
    """Charges that start between two instants, either of which may be left out.

    A bare date as ``end`` means its midnight, so charges later on that day are
    left out unless ``end_inclusive`` is set.  Both bounds reach the Parquet
    scan, and the month folders are pruned where the table has them.
    """
    when = F.col("charge_period_start")
    monthly = "charge_month" in billing.columns

    def month(instant: Column) -> Column:
        # folders are named by the instant, not by how a caller spells it
        return F.date_format(instant, "yyyy-MM")

    if start is not None:
        first = F.lit(start).cast("timestamp_ntz")
        billing = billing.where(when >= first)
        if monthly:
            billing = billing.where(F.col("charge_month") >= month(first))
    if end is not None:
        last = F.lit(end).cast("timestamp_ntz")
        if end_inclusive:
            billing = billing.where(when < F.date_add(last.cast("date"), 1).cast("timestamp_ntz"))
        else:
            billing = billing.where(when <= last)
        if monthly:
            billing = billing.where(F.col("charge_month") <= month(last))
    return billing


def for_entity(billing: DataFrame, entity_type: str, entity_value: str) -> DataFrame:
    """Charges of one entity; ``total`` keeps all of them."""
    if entity_type == "total":
        return billing
    return billing.where(F.col(entity_type).cast("string") == F.lit(entity_value))


def metered(billing: DataFrame) -> DataFrame:
    """Charges with a positive billed quantity."""
    return billing.where(F.col("quantity") > 0)


def labelled(dimension: str) -> Column:
    """Dimension value as text, ``unknown`` where it is missing."""
    return F.coalesce(F.col(dimension).cast("string"), F.lit(UNKNOWN)).alias(dimension)
