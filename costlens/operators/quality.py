"""Data quality of canonical charges, all datasets in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..functions.currencies import NAMED_CURRENCIES
from ..functions.tables import renewed
from ..schema import DATE_FIELDS, DUPLICATE_KEYS, NUMERIC_FIELDS, missing_required

#: A numeric field with more missing values than this share is an issue.
MISSING_SHARE = 0.1

# Findings sort by field position; findings without a field come after all fields.
_AFTER_FIELDS = 1_000_000


def _fields(billing: DataFrame) -> list[T.StructField]:
    return [f for f in billing.schema.fields if f.name not in ("dataset_id", "charge_month")]


#: Types whose every value has a 64-bit hash of its own: the hash of up to eight bytes is one-to-one.
_SHORT = (
    T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.BooleanType,
    T.DateType, T.TimestampType, T.TimestampNTZType,
)


def _key(*columns) -> Column:
    """64-bit hash of some values."""
    return F.xxhash64(*columns)


def _check(*columns) -> Column:
    """A second number that tells values of equal hash apart: another hash, the length, and which values are missing."""
    size, missing = F.lit(0), F.lit(0)
    for i, column in enumerate(columns):
        size += F.coalesce(F.octet_length(column.cast("string")), F.lit(0))
        missing += F.when(column.isNull(), 1 << i).otherwise(0)
    return F.shiftleft(F.hash(*columns).cast("long"), 32) + F.shiftleft(size.cast("long") % (1 << 24), 8) + missing


#: Position of the cell that stands for the whole row.
_ROW = -1
#: Parts that the names of one dataset's currencies are ranked in, side by side.
_PARTS = 64


def _cell(position: int, key=None, check=None, name=None, flagged=None) -> Column:
    return F.struct(
        F.lit(position).alias("position"),
        F.lit(key).cast("bigint").alias("key"),
        F.lit(check).cast("bigint").alias("check"),
        F.lit(name).cast("string").alias("name"),
        F.lit(flagged).cast("boolean").alias("flagged"),
    )


def _row_cell(billing: DataFrame) -> Column:
    """The fields that identify a charge, and whether its period is reversed."""
    keys = [F.col(k) for k in DUPLICATE_KEYS if k in billing.columns]
    has_period = {"charge_period_start", "charge_period_end"} <= set(billing.columns)
    backwards = F.col("charge_period_start") > F.col("charge_period_end") if has_period else None
    return _cell(_ROW, _key(*keys) if keys else None, _check(*keys) if keys else None, None, backwards)


def _field_cells(billing: DataFrame, distinct: str) -> list[Column]:
    """A cell for each field: the hash of its value (or that it has one), the name of a currency, whether it is negative."""
    cells = []
    for position, field in enumerate(_fields(billing)):
        column, check = F.col(f"`{field.name}`"), None
        value = column
        if not isinstance(field.dataType, _SHORT):
            nested = isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType))
            value = F.to_json(value) if nested else value.cast("string")
            check = F.when(column.isNotNull(), _check(value))
        key = _key(value) if distinct == "exact" else F.lit(0)
        cells.append(
            _cell(
                position,
                F.when(column.isNotNull(), key),
                check if distinct == "exact" else None,
                column.cast("string") if field.name == "currency" else None,
                column < 0 if field.name in NUMERIC_FIELDS else None,
            )
        )
    return cells


def _counted(billing: DataFrame, cells: list[Column], limit: int = NAMED_CURRENCIES) -> DataFrame:
    """``dataset_id, position, n, missing, unique, flagged, copies, name_count, names`` of each cell, from one reading of the charges.

    A value travels as its hash, once per task; text and row keys also carry a second hash with their length, so two of them
    are counted as one only if 64 + 32 bits and 24 bits of length agree.  Numbers, dates and times have no equal hashes.
    Names are ranked in parts, and of each part the first ``limit`` go on: no array and no task grows with the currencies.
    """
    values = (
        billing.select("dataset_id", F.inline(F.array(*cells)))
        .groupBy("dataset_id", "position", "key", "check", "name")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("flagged"))
    )
    sums = [F.sum(c).alias(c) for c in ("n", "missing", "unique", "flagged", "copies", "name_count")]
    named = values.groupBy("dataset_id", "position", "name").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(0)).alias("missing"),
        F.count("key").alias("unique"),
        F.sum("flagged").alias("flagged"),
        F.sum(F.col("n") - 1).alias("copies"),
    )
    part = F.coalesce(F.pmod(F.xxhash64("name"), F.lit(_PARTS)), F.lit(0)).alias("part")
    first = Window.partitionBy("dataset_id", "position", "part").orderBy(F.asc_nulls_last("name"))
    parts = (
        named.select("*", part, F.col("name").isNotNull().cast("bigint").alias("name_count"))
        .withColumn("name", F.when(F.row_number().over(first) <= limit, F.col("name")))
        .groupBy("dataset_id", "position", "part").agg(*sums, F.collect_list("name").alias("names"))
    )
    return (
        parts.groupBy("dataset_id", "position").agg(*sums, F.flatten(F.collect_list("names")).alias("names"))
        .withColumn("names", F.slice(F.array_sort("names"), 1, limit))
    )


def distinct_counts(billing: DataFrame) -> DataFrame:
    """``dataset_id, position, unique_count``: distinct values of each field, NULL not counted."""
    counted = _counted(billing, _field_cells(billing, "exact"))
    return counted.select("dataset_id", "position", F.col("unique").alias("unique_count"))


def _profile(counted: DataFrame, billing: DataFrame, distinct: str = "exact") -> DataFrame:
    """Null, negative and distinct values of each cell; that of whole rows has no field name."""
    names = F.array(*[F.lit(f.name) for f in _fields(billing)]).cast("array<string>")
    # charges without a dataset id have no distinct counts
    unique = F.when(F.col("dataset_id").isNotNull(), F.col("unique")).otherwise(0)
    return counted.select(
        "*",
        F.get(names, F.col("position")).alias("field_name"),
        F.col("n").alias("row_count"),
        F.col("missing").alias("null_count"),
        (F.col("missing") / F.col("n")).alias("null_rate"),
        (unique if distinct == "exact" else F.lit(None)).cast("bigint").alias("unique_count"),
        F.col("flagged").alias("invalid_count"),
    )


def field_profile(billing: DataFrame) -> DataFrame:
    """Null rate, distinct values and negative values of every field."""
    return _profile(_counted(billing, _field_cells(billing, "exact")), billing).select(
        "dataset_id",
        "position",
        "field_name",
        "row_count",
        "null_count",
        "null_rate",
        "unique_count",
        "invalid_count",
    )


def approximate_distinct(billing: DataFrame, rsd: float = 0.02) -> DataFrame:
    """Estimated distinct values per field, without shuffling the values themselves."""
    names = [f.name for f in _fields(billing)]
    wide = billing.groupBy("dataset_id").agg(
        *[F.approx_count_distinct(f"`{n}`", rsd).alias(n) for n in names]
    )
    return wide.unpivot(["dataset_id"], names, "field_name", "unique_count")


def row_checks(billing: DataFrame) -> DataFrame:
    """Rows, duplicates (first one kept) and reversed charge periods per dataset.

    Two rows are duplicates when 64 + 32 bits of hash, the length and the missing values of their keys agree.
    """
    counted = _counted(billing, [_row_cell(billing)])
    return counted.select("dataset_id", *[c.alias(n) for n, c in _row_columns().items()])


def _row_columns() -> dict[str, Column]:
    """What the cell of whole rows says; without key fields no row is another's copy."""
    return {
        "total_rows": F.col("n"),
        "duplicate_rows": F.when(F.col("unique") > 0, F.col("copies")).otherwise(0).cast("bigint"),
        "reversed_periods": F.col("flagged"),
    }


def _finding(level: str, seq, field, n, message):
    return F.struct(
        F.lit(level).alias("level"),
        seq.cast("int").alias("seq"),
        field.alias("field_name"),
        n.cast("bigint").alias("n"),
        message.alias("message"),
    )


def _kept(*candidates):
    return F.filter(F.array(*candidates), lambda item: item.isNotNull())


def _field_findings():
    """Findings of one profile row; rules that do not fire are dropped."""
    field, missing, negative = F.col("field_name"), F.col("null_count"), F.col("invalid_count")
    is_number, is_date = field.isin(*NUMERIC_FIELDS), field.isin(*DATE_FIELDS)
    seq = F.col("position")
    return _kept(
        F.when(
            is_number & (negative > 0),
            _finding(
                "warning",
                seq,
                field,
                negative,
                F.format_string("%s: %d negative values (may be credits)", field, negative),
            ),
        ),
        F.when(
            is_number & (missing > F.col("row_count") * MISSING_SHARE),
            _finding(
                "issue",
                seq,
                field,
                missing,
                F.format_string("%s: %d missing values (%.1f%%)", field, missing, F.col("null_rate") * 100),
            ),
        ),
        F.when(
            is_date & (missing > 0),
            _finding(
                "issue",
                seq,
                field,
                missing,
                F.format_string("%s: %d invalid or missing dates", field, missing),
            ),
        ),
        F.when(
            (field == "billed_cost") & (missing > 0),
            _finding(
                "issue",
                F.lit(_AFTER_FIELDS + 2),
                field,
                missing,
                F.format_string("%d rows have missing billed_cost", missing),
            ),
        ),
    )


def _row_findings(columns: list[str]):
    absent = missing_required(columns)
    copies, backwards = F.col("duplicate_rows"), F.col("reversed_periods")
    codes, many = F.col("currencies"), F.col("currency_count")
    more = F.when(many > F.size(codes), F.format_string(" and %d more", many - F.size(codes))).otherwise("")
    none = F.lit(None).cast("string")
    return _kept(
        F.when(
            F.lit(bool(absent)),
            _finding(
                "issue", F.lit(-1), none, F.lit(len(absent)), F.lit(f"Missing required fields: {absent}")
            ),
        ),
        F.when(
            copies > 0,
            _finding(
                "warning",
                F.lit(_AFTER_FIELDS),
                none,
                copies,
                F.format_string("%d potential duplicate rows detected", copies),
            ),
        ),
        F.when(
            many > 1,
            _finding(
                "warning",
                F.lit(_AFTER_FIELDS + 1),
                F.lit("currency"),
                many,
                F.concat(F.lit("Multiple currencies detected: "), text.quoted_list(codes), more),
            ),
        ),
        F.when(
            backwards > 0,
            _finding(
                "issue",
                F.lit(_AFTER_FIELDS + 1),
                none,
                backwards,
                F.format_string("%d rows have charge_period_start > charge_period_end", backwards),
            ),
        ),
    )


def _assessed(billing: DataFrame, distinct: str = "exact") -> DataFrame:
    """One row per dataset with counts, field metrics and the ordered findings.

    The charges are read once for the fields, the row keys and the currencies, and once more for the distinct values if
    those are asked for.  Everything after that has at most one row per dataset, field and currency.
    """
    if distinct not in ("exact", "none"):
        raise ValueError(f"distinct is 'exact' or 'none', not {distinct!r}")
    known = billing.where(F.col("dataset_id").isNotNull())
    cells = _profile(_counted(known, [_row_cell(known), *_field_cells(known, "none")]), known, "none")
    if distinct == "exact":
        cells = cells.drop("unique_count").join(renewed(distinct_counts(known)), ["dataset_id", "position"], "left")
    metric = F.struct("position", "field_name", "null_rate", "unique_count", "invalid_count")
    is_row = F.col("position") == _ROW
    joined = (
        cells.withColumn("found", _field_findings())
        .groupBy("dataset_id")
        .agg(
            F.array_sort(F.collect_list(F.when(~is_row, metric))).alias("field_metrics"),
            F.flatten(F.collect_list("found")).alias("field_findings"),
            *[F.max(F.when(is_row, c)).alias(n) for n, c in _row_columns().items()],
            F.max("name_count").alias("currency_count"),
            F.flatten(F.collect_list("names")).alias("currencies"),
        )
    )
    ordered = F.array_sort(
        F.concat("field_findings", _row_findings(billing.columns)),
        lambda a, b: F.when(a["seq"] < b["seq"], -1)
        .when(a["seq"] > b["seq"], 1)
        .when(a["level"] < b["level"], -1)
        .when(a["level"] > b["level"], 1)
        .otherwise(0),
    )
    return joined.withColumn("found", ordered)


def findings(billing: DataFrame) -> DataFrame:
    """Issues and warnings, one row each, numbered in report order by ``seq``."""
    return _assessed(billing, "none").select("dataset_id", F.inline("found"))


def row_consistency(billing: DataFrame) -> DataFrame:
    """Duplicates, currency consistency and date order of each dataset."""
    return _assessed(billing, "none").select(
        "dataset_id",
        "total_rows",
        "duplicate_rows",
        "currencies",
        (F.col("currency_count") <= 1).alias("currency_consistency"),
        "reversed_periods",
        (F.col("reversed_periods") == 0).alias("date_range_valid"),
    )


def status_of(issues, warnings):
    """FAIL on any issue, WARN on any warning, else PASS."""
    return F.when(issues > 0, "FAIL").when(warnings > 0, "WARN").otherwise("PASS")


def quality_report(billing: DataFrame, distinct: str = "exact") -> DataFrame:
    """One row per dataset with status, counts, null rates, metrics, issues, warnings.

    Distinct values are the costly part and decide nothing; ``distinct="none"`` leaves
    them NULL, and ``approximate_distinct`` estimates them without a shuffle.
    """

    def messages(level: str):
        kept = F.filter("found", lambda item: item["level"] == level)
        return F.transform(kept, lambda item: item["message"])

    assessed = _assessed(billing, distinct).withColumns(
        {"issues": messages("issue"), "warnings": messages("warning")}
    )
    return assessed.select(
        "dataset_id",
        status_of(F.size("issues"), F.size("warnings")).alias("overall_status"),
        "total_rows",
        (F.col("total_rows") - F.col("duplicate_rows")).alias("valid_rows"),
        "duplicate_rows",
        (F.col("currency_count") <= 1).alias("currency_consistency"),
        (F.col("reversed_periods") == 0).alias("date_range_valid"),
        F.map_from_entries(
            F.transform("field_metrics", lambda m: F.struct(m["field_name"], F.round(m["null_rate"], 4)))
        ).alias("null_rate_by_field"),
        "field_metrics",
        "issues",
        "warnings",
    )
