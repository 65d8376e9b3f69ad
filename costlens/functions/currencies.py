"""The currencies of a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Currencies that a report or a record names; all are counted, and ``currencies`` lists all.
NAMED_CURRENCIES = 1000


def currencies(billing: DataFrame) -> DataFrame:
    """``dataset_id, currency, row_count``: every currency of each dataset."""
    currency = F.col("currency") if "currency" in billing.columns else F.lit(None).cast("string")
    counted = billing.groupBy("dataset_id", currency.alias("currency")).agg(F.count(F.lit(1)).alias("row_count"))
    return counted.where(F.col("currency").isNotNull())


def named_currencies(billing: DataFrame, limit: int = NAMED_CURRENCIES) -> DataFrame:
    """``dataset_id, currency_count, currencies``: all counted, the first ``limit`` of them in an array.

    A task passes on its first ones only, so no array and no task grows with the currencies of a dataset.
    """
    found = currencies(billing)
    order = Window.partitionBy("dataset_id").orderBy("currency")
    first = found.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= limit)
    listed = first.groupBy("dataset_id").agg(F.array_sort(F.collect_list("currency")).alias("currencies"))
    counts = found.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("currency_count"))
    return counts.join(listed, "dataset_id")
