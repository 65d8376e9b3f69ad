"""Dates that are not spelt as ISO 8601: one format per column, chosen by a vote of its values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISO = "iso"
#: Patterns of each format, tried in this order; a format listed earlier wins a tie.
FORMATS: Mapping[str, Sequence[str]] = {
    "year_first": ("yyyy/M/d[ H:mm[:ss]]", "yyyy.M.d[ H:mm[:ss]]"),
    "compact": ("yyyyMMdd", "yyyyMMddHHmmss"),
    "month_first": ("M/d/yyyy[ H:mm[:ss]]", "M/d/yyyy h:mm[:ss] a", "M-d-yyyy[ H:mm[:ss]]", "M/d/yy[ H:mm[:ss]]"),
    "day_first": ("d/M/yyyy[ H:mm[:ss]]", "d/M/yyyy h:mm[:ss] a", "d-M-yyyy[ H:mm[:ss]]", "d/M/yy[ H:mm[:ss]]", "d.M.yyyy[ H:mm[:ss]]"),
    "month_name": ("MMM d, yyyy[ H:mm[:ss]]", "MMMM d, yyyy[ H:mm[:ss]]", "MMM d yyyy[ H:mm[:ss]]", "MMMM d yyyy[ H:mm[:ss]]"),
    "day_month_name": ("d MMM yyyy[ H:mm[:ss]]", "d MMMM yyyy[ H:mm[:ss]]", "d-MMM-yyyy[ H:mm[:ss]]"),
}


@dataclass(frozen=True)
class Vote:
    """The format of a column: how many of its values are there, are ISO dates, and are dates of the chosen format.

    ``ambiguous`` if the other order of day and month reads as many of them, in other dates.
    """

    column: str
    format: str
    present: int
    iso: int
    parsed: int
    ambiguous: bool


def iso(col: Column) -> Column:
    """UTC wall time of an ISO spelling, or NULL; eight digits alone are a compact date, not a year."""
    return F.when(~F.trim(col).rlike(r"^\d{5,}$"), col).try_cast("timestamp").cast("timestamp_ntz")


def parsed(col: Column, name: str) -> Column:
    """UTC wall time of a text in one format, or NULL."""
    if name == ISO:
        return iso(col)
    text = F.trim(col)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(pattern)) for pattern in FORMATS[name]]).cast("timestamp_ntz")


def spelt(col: Column, name: str) -> Column:
    """ISO spellings wherever they stand, everything else by the column's format."""
    return iso(col) if name == ISO else F.coalesce(iso(col), parsed(col, name))


def vote(df: DataFrame, columns: Sequence[str]) -> dict[str, Vote]:
    """The format that reads most of the values that are not ISO, for each text column; one pass, a few counts per task.

    Between day first and month first the one that reads more wins, month first if both read the same.
    """
    texts = [c for c in columns if c in df.columns and df.schema[c].dataType.typeName() == "string"]
    if not texts:
        return {}
    counts = {}
    for i, name in enumerate(texts):
        col = F.col(f"`{name}`")
        plain = iso(col)
        counts |= {f"present_{i}": F.count(col), f"iso_{i}": F.count(plain)}
        month, day = parsed(col, "month_first"), parsed(col, "day_first")
        counts[f"other_{i}"] = F.count_if(plain.isNull() & month.isNotNull() & day.isNotNull() & (month != day))
        for form in FORMATS:
            counts[f"{form}_{i}"] = F.count_if(plain.isNull() & parsed(col, form).isNotNull())
    found = df.agg(*[c.alias(n) for n, c in counts.items()]).first()
    votes = {}
    for i, name in enumerate(texts):
        read = {form: found[f"{form}_{i}"] for form in FORMATS}
        best = max(read, key=lambda form: read[form])  # the first of equals
        tie = best == "month_first" and read["day_first"] == read["month_first"] and found[f"other_{i}"] > 0
        votes[name] = Vote(name, best if read[best] else ISO, found[f"present_{i}"], found[f"iso_{i}"], read[best], tie)
    return votes
