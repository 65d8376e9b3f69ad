"""Formatted text for reports: money, percentages, list literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(col: Column | str) -> Column:
    """``$1,234.50``; a negative amount reads ``$-1,234.50``."""
    return F.format_string("$%,.2f", col)


def percent(col: Column | str, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", col)


def signed_percent(col: Column | str) -> Column:
    return F.format_string("%+.1f%%", col)


def fixed(col: Column | str, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f", col)


def quoted_list(items: Column) -> Column:
    """``['EUR', 'USD']`` from an array of strings."""
    return F.concat(F.lit("['"), F.array_join(items, "', '"), F.lit("']"))
