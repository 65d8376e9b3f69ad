"""Helpers on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def renewed(table: DataFrame) -> DataFrame:
    """The same table with column identities of its own.

    Joining two tables that come from the same source makes Spark rewrite one side,
    which then no longer matches a kept copy and is computed again.  New
    identities avoid the rewrite.
    """
    return table.select([F.col(f"`{c}`").alias(c) for c in table.columns])
