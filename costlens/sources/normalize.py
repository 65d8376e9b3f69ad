"""Raw FOCUS columns to the canonical schema."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import DATE_FIELDS, NUMERIC_FIELDS, column_mapping, detect_version
from ..session import require_utc
from . import dates


def rename_to_canonical(df: DataFrame, version: str | None = None) -> DataFrame:
    """Rename the FOCUS columns that exist; all others pass through."""
    return df.withColumnsRenamed(column_mapping(version or detect_version(df.columns)))


def number(col: Column, dtype: T.DataType) -> Column:
    """Double, or NULL for anything that is not a number (NaN included)."""
    if isinstance(dtype, T.StringType):
        # Java reads "1d" and "1f" as numbers; a billing file does not.
        col = F.when(~col.rlike(r"(?i)[0-9.][df]\s*$"), col)
    value = col.try_cast("double")
    return F.when(~F.isnan(value), value)


def utc_timestamp(col: Column, dtype: T.DataType, spelling: str = dates.ISO) -> Column:
    """UTC wall time, or NULL for anything that is not a timestamp; texts are ISO or in the given format."""
    if isinstance(dtype, T.TimestampNTZType):
        return col
    if isinstance(dtype, T.StringType):
        return dates.spelt(col, spelling)
    return col.try_cast("timestamp").cast("timestamp_ntz")


def date_votes(df: DataFrame, version: str | None = None) -> dict[str, dates.Vote]:
    """How the date columns of an export are spelt, by canonical name; reads the export once."""
    return dates.vote(rename_to_canonical(df, version), DATE_FIELDS)


def to_canonical(
    df: DataFrame,
    *,
    dataset_id: str | None = None,
    version: str | None = None,
    date_formats: Mapping[str, str] | None = None,
) -> DataFrame:
    """Rename, then type the numeric and date fields; bad values become NULL.

    ``dataset_id`` tags every row; leave it out when the input already has the column.  Dates are ISO 8601, and
    for the columns that ``date_formats`` names (``{column: vote.format}`` from ``date_votes``) of that format too.
    """
    require_utc(df.sparkSession)
    renamed = rename_to_canonical(df, version)
    columns = []
    for field in renamed.schema.fields:
        col = F.col(f"`{field.name}`")
        if field.name in NUMERIC_FIELDS:
            col = number(col, field.dataType)
        elif field.name in DATE_FIELDS:
            col = utc_timestamp(col, field.dataType, (date_formats or {}).get(field.name, dates.ISO))
        columns.append(col.alias(field.name))
    if dataset_id is not None:
        columns = [F.lit(dataset_id).alias("dataset_id")] + [
            c for c, f in zip(columns, renamed.schema.fields) if f.name != "dataset_id"
        ]
    return renamed.select(columns)
