"""Data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from costlens.operators import quality
from costlens.schema import DATE_FIELDS, DUPLICATE_KEYS, NUMERIC_FIELDS

from .inputs import COLUMNS, define, sql
from .registry import query
from .source_queries import everything

_FIELDS = [c for c in COLUMNS if c != "dataset_id"]


def _profile_sql() -> str:
    return " UNION ALL ".join(
        f"""SELECT dataset_id, {i} AS position, '{c}' AS field_name, count(*) AS row_count,
              count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count,
              {f'count(*) FILTER (WHERE {c} < 0)' if c in NUMERIC_FIELDS else '0'}::BIGINT AS invalid_count
            FROM everything GROUP BY 1"""
        for i, c in enumerate(_FIELDS)
    )


define("profile", _profile_sql(), "everything")
define(
    "row_checks",
    f"""SELECT dataset_id, sum(n)::BIGINT AS total_rows, sum(n - 1)::BIGINT AS duplicate_rows,
          sum(reversed)::BIGINT AS reversed_periods
        FROM (SELECT dataset_id, count(*) AS n, count(*) FILTER (WHERE charge_period_start > charge_period_end) AS reversed
              FROM everything GROUP BY dataset_id, {', '.join(DUPLICATE_KEYS)}) GROUP BY 1""",
    "everything",
)
define(
    "codes",
    """SELECT dataset_id, string_agg(DISTINCT currency, ',' ORDER BY currency) AS currencies,
         count(DISTINCT currency) AS n FROM everything GROUP BY 1""",
    "everything",
)
_NUMERIC = ", ".join(f"'{c}'" for c in NUMERIC_FIELDS)
_DATES = ", ".join(f"'{c}'" for c in DATE_FIELDS)
define(
    "findings",
    f"""SELECT dataset_id, 'warning' AS level, position AS seq, field_name, invalid_count AS n,
          field_name || ': ' || invalid_count || ' negative values (may be credits)' AS message
        FROM profile WHERE field_name IN ({_NUMERIC}) AND invalid_count > 0
        UNION ALL SELECT dataset_id, 'issue', position, field_name, null_count,
          field_name || ': ' || null_count || ' missing values (' || printf('%.1f', null_count * 100.0 / row_count) || '%)'
        FROM profile WHERE field_name IN ({_NUMERIC}) AND null_count > row_count * 0.1
        UNION ALL SELECT dataset_id, 'issue', position, field_name, null_count,
          field_name || ': ' || null_count || ' invalid or missing dates'
        FROM profile WHERE field_name IN ({_DATES}) AND null_count > 0
        UNION ALL SELECT dataset_id, 'issue', 1000002, field_name, null_count,
          null_count || ' rows have missing billed_cost'
        FROM profile WHERE field_name = 'billed_cost' AND null_count > 0
        UNION ALL SELECT dataset_id, 'warning', 1000000, NULL, duplicate_rows,
          duplicate_rows || ' potential duplicate rows detected' FROM row_checks WHERE duplicate_rows > 0
        UNION ALL SELECT dataset_id, 'issue', 1000001, NULL, reversed_periods,
          reversed_periods || ' rows have charge_period_start > charge_period_end' FROM row_checks WHERE reversed_periods > 0
        UNION ALL SELECT dataset_id, 'warning', 1000001, 'currency', n,
          'Multiple currencies detected: [''' || replace(currencies, ',', ''', ''') || ''']' FROM codes WHERE n > 1""",
    "profile",
    "row_checks",
    "codes",
)
define(
    "quality",
    """SELECT r.dataset_id, CASE WHEN f.issues > 0 THEN 'FAIL' WHEN f.warnings > 0 THEN 'WARN' ELSE 'PASS' END AS overall_status,
         total_rows, total_rows - duplicate_rows AS valid_rows, duplicate_rows, c.n <= 1 AS currency_consistency,
         reversed_periods = 0 AS date_range_valid, coalesce(f.issues, 0) AS issues, coalesce(f.warnings, 0) AS warnings,
         coalesce(f.issue_text, '') AS issue_text, coalesce(f.warning_text, '') AS warning_text
       FROM row_checks r JOIN codes c USING (dataset_id)
       LEFT JOIN (SELECT dataset_id, count(*) FILTER (WHERE level = 'issue') AS issues,
           count(*) FILTER (WHERE level = 'warning') AS warnings,
           string_agg(message, ' | ' ORDER BY seq) FILTER (WHERE level = 'issue') AS issue_text,
           string_agg(message, ' | ' ORDER BY seq) FILTER (WHERE level = 'warning') AS warning_text
         FROM findings GROUP BY 1) f USING (dataset_id)""",
    "row_checks",
    "codes",
    "findings",
)


@query(
    "D02 D03",
    sql(
        """SELECT dataset_id, field_name, row_count, null_count, round(null_count / row_count, 6) AS null_rate,
             unique_count, invalid_count FROM profile""",
        "profile",
    ),
)
def field_profile(spark, sf_dir):
    return quality.field_profile(everything(spark, sf_dir)).select(
        "dataset_id",
        "field_name",
        "row_count",
        "null_count",
        F.round("null_rate", 6).alias("null_rate"),
        "unique_count",
        "invalid_count",
    )


@query(
    "D04 D05 D06 D10",
    sql("SELECT dataset_id, level, seq, field_name, n, message FROM findings", "findings"),
)
def quality_findings(spark, sf_dir):
    return quality.findings(everything(spark, sf_dir))


@query(
    "D07 D08 D09",
    sql(
        """SELECT dataset_id, total_rows, duplicate_rows, currencies, n <= 1 AS currency_consistency, reversed_periods,
             reversed_periods = 0 AS date_range_valid FROM row_checks JOIN codes USING (dataset_id)""",
        "row_checks",
        "codes",
    ),
)
def row_consistency(spark, sf_dir):
    return quality.row_consistency(everything(spark, sf_dir)).withColumn(
        "currencies", F.array_join("currencies", ",")
    )


@query("D11 D12", sql("SELECT * FROM quality", "quality"))
def quality_report(spark, sf_dir):
    return quality.quality_report(everything(spark, sf_dir)).select(
        "dataset_id",
        "overall_status",
        "total_rows",
        "valid_rows",
        "duplicate_rows",
        "currency_consistency",
        "date_range_valid",
        F.size("issues").cast("bigint").alias("issues"),
        F.size("warnings").cast("bigint").alias("warnings"),
        F.array_join("issues", " | ").alias("issue_text"),
        F.array_join("warnings", " | ").alias("warning_text"),
    )
