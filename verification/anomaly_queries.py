"""Detectors and the anomaly report."""

from __future__ import annotations

from pyspark.sql import functions as F

from costlens.operators import anomaly

from .inputs import charges, define, sql
from .panel_queries import KEYS, K, r, service_panel
from .registry import query

_SEVERITY = """CASE WHEN abs(deviation_pct) < 25 THEN 'low' WHEN abs(deviation_pct) < 50 THEN 'medium'
  WHEN abs(deviation_pct) < 100 THEN 'high' ELSE 'critical' END"""


def _scored(source: str, expected: str, z: str, threshold: float, method: str, lines: str, where: str = "TRUE") -> str:
    return f"""SELECT *, {_SEVERITY} AS severity, least(1.0::DOUBLE, abs(z) / ({threshold} * 2)) AS confidence,
          '{method}' AS method, {lines} AS evidence
        FROM (SELECT *, CASE WHEN expected <> 0 THEN (cost - expected) / abs(expected) * 100 ELSE 0 END AS deviation_pct
              FROM (SELECT {K}, day, cost, n, {expected} AS expected, {z} AS z FROM {source}) WHERE abs(z) >= {threshold} AND {where})"""


_MONEY = "format('{{:,.2f}}', {})"


def _lines(baseline: str, label: str, threshold: float) -> str:
    return (
        f"'{baseline}' || ' | Actual: $' || {_MONEY.format('cost')} || ' | {label}' "
        f"|| printf('%.2f', z) || ' (threshold: {threshold}) | Deviation: ' || printf('%+.1f', deviation_pct) || '%'"
    )


define(
    "rolling",
    f"""SELECT *, count(cost) OVER f AS c, avg(cost) OVER f AS m, nullif(stddev_samp(cost) OVER f, 0) AS s FROM numbered
        WINDOW f AS (PARTITION BY {K} ORDER BY day ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""",
    "numbered",
)
define(
    "found_rolling",
    _scored(
        "rolling",
        "m",
        "CASE WHEN c >= 7 THEN (cost - m) / s END",
        3.0,
        "rolling_zscore",
        _lines("Rolling mean (14d): ", "Z-score: ", 3.0),
        "n >= 15",
    ),
    "rolling",
)
define(
    "found_robust",
    _scored(
        "median_mad",
        "median",
        "CASE WHEN mad = 0 THEN (cost - median) / nullif(std, 0) ELSE 0.6745::DOUBLE * (cost - median) / mad END",
        3.5,
        "robust_zscore",
        _lines("Median baseline: ", "Modified Z-score: ", 3.5),
    ),
    "median_mad",
)
define(
    "found_ewma",
    _scored(
        "ewma",
        "ewma",
        "(cost - ewma) / ewma_std",
        3.0,
        "ewma",
        _lines("EWMA baseline (span=14): ", "EWMA Z-score: ", 3.0),
        "n >= 5",
    ),
    "ewma",
)
define(
    "found_second",
    f"SELECT * FROM found_ewma e WHERE NOT EXISTS (SELECT 1 FROM found_robust b WHERE b.dataset_id = e.dataset_id AND b.entity_value = e.entity_value AND b.day = e.day)",
    "found_ewma",
    "found_robust",
)
define(
    "found",
    "SELECT * FROM found_robust WHERE n >= 7 UNION ALL SELECT * FROM found_second WHERE n >= 7",
    "found_robust",
    "found_second",
)
_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"
define(
    "found_ranked",
    f"""SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY {_RANK}, abs(deviation_pct) DESC,
          entity_value, day, method) AS rank FROM found""",
    "found",
)

_COLUMNS = f"""{K}, day, round(cost, 2) AS actual_cost, round(expected, 3) AS expected_cost,
  round(cost - expected, 3) AS deviation, round(deviation_pct, 3) AS deviation_pct, round(z, 3) AS z_score,
  severity, method, round(confidence, 3) AS confidence, evidence"""


def _without_expected(evidence):
    """Leave the expected amount out of the text: a median of two amounts can lie on
    half a cent, where the last digit hangs on the order of addition.  The amount
    itself is compared with one digit more."""
    return F.transform(
        evidence,
        lambda line: F.when(line.startswith("Actual"), line).otherwise(F.substring_index(line, "$", 1)),
    )


def _shown(rows, *more):
    return rows.select(
        *KEYS,
        "day",
        *r("actual_cost"),
        *r("expected_cost deviation deviation_pct z_score", 3),
        "severity",
        "method",
        *r("confidence", 3),
        F.array_join(_without_expected(F.col("supporting_evidence")), " | ").alias("evidence"),
        *more,
    )


@query("N01 N05 N06 N07 N08", sql(f"SELECT {_COLUMNS} FROM found_rolling", "found_rolling"))
def rolling_zscore(spark, sf_dir):
    return _shown(anomaly.rolling_zscore(service_panel(spark, sf_dir)))


@query("N02 N05 N06 N07 N08", sql(f"SELECT {_COLUMNS} FROM found_robust", "found_robust"))
def robust_zscore(spark, sf_dir):
    return _shown(anomaly.robust_zscore(service_panel(spark, sf_dir)))


@query("N03 N05 N06 N07 N08", sql(f"SELECT {_COLUMNS} FROM found_ewma", "found_ewma"))
def ewma_zscore(spark, sf_dir):
    return _shown(anomaly.ewma_zscore(service_panel(spark, sf_dir)))


define(
    "found_sensitive",
    _scored(
        "ewma", "ewma", "(cost - ewma) / ewma_std", 2.0, "ewma", _lines("EWMA baseline (span=14): ", "EWMA Z-score: ", 2.0)
    ),
    "ewma",
)


@query("N03 N05 N06 N07 N08", sql(f"SELECT {_COLUMNS} FROM found_sensitive", "found_sensitive"))
def ewma_zscore_sensitive(spark, sf_dir):
    """Threshold 2, which the driver tables do reach."""
    return _shown(anomaly.ewma_zscore(service_panel(spark, sf_dir), threshold=2.0))


_RESIDUAL_EVIDENCE = (
    f"'Actual: $' || {_MONEY.format('cost')} || ' | Expected: ' || ' | Deviation: ' "
    "|| printf('%+.1f', deviation_pct) || '% | Z-score: ' || printf('%.2f', z) || ' | Detection method: moving_average'"
)
define(
    "trailed",
    f"""SELECT *, avg(cost) OVER (PARTITION BY {K} ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS base
        FROM numbered""",
    "numbered",
)
define(
    "found_residual",
    _scored(
        f"(SELECT *, stddev_samp(cost - base) OVER (PARTITION BY {K}) AS s FROM trailed)",
        "base",
        "(cost - base) / nullif(s, 0)",
        3.0,
        "moving_average",
        _RESIDUAL_EVIDENCE,
        "expected <> 0",
    ),
    "trailed",
)


@query("N04", sql(f"SELECT {_COLUMNS} FROM found_residual", "found_residual"))
def residual_anomalies(spark, sf_dir):
    """Residuals of the seven-day trailing average."""
    from costlens.operators import panel

    rows = panel.with_trailing_average(service_panel(spark, sf_dir))
    return _shown(anomaly.residual_anomalies(rows, "trailing_average", "moving_average"))


@query("J02", sql(f"SELECT {_COLUMNS} FROM found_second", "found_second"))
def detector_dedup(spark, sf_dir):
    rows = service_panel(spark, sf_dir)
    return _shown(anomaly.drop_found(anomaly.ewma_zscore(rows), anomaly.robust_zscore(rows)))


@query(
    "J03",
    sql(f"SELECT {_COLUMNS} FROM found_robust UNION ALL SELECT {_COLUMNS} FROM found_second", "found_robust", "found_second"),
)
def detector_union(spark, sf_dir):
    rows = service_panel(spark, sf_dir)
    return _shown(anomaly.combine(anomaly.robust_zscore(rows), anomaly.ewma_zscore(rows)))


_NEW = """FROM found_sensitive s WHERE NOT EXISTS (SELECT 1 FROM found_robust f WHERE f.dataset_id = s.dataset_id
  AND f.entity_type = s.entity_type AND f.entity_value = s.entity_value AND f.day = s.day)"""


@query("J02", sql(f"SELECT {_COLUMNS} {_NEW}", "found_sensitive", "found_robust"))
def detector_dedup_sensitive(spark, sf_dir):
    """Threshold 2 for the secondary detector, so that it finds days of its own and days found before."""
    rows = service_panel(spark, sf_dir)
    return _shown(anomaly.drop_found(anomaly.ewma_zscore(rows, threshold=2.0), anomaly.robust_zscore(rows)))


@query(
    "J03",
    sql(f"SELECT {_COLUMNS} FROM found_robust UNION ALL SELECT {_COLUMNS} {_NEW}", "found_sensitive", "found_robust"),
)
def detector_union_sensitive(spark, sf_dir):
    """Rows of both detectors."""
    rows = service_panel(spark, sf_dir)
    return _shown(anomaly.combine(anomaly.robust_zscore(rows), anomaly.ewma_zscore(rows, threshold=2.0)))


DETECTION = ("billed_cost", "service", "charge_period_start")


@query("N09 T04", sql(f"SELECT {_COLUMNS}, rank FROM found_ranked WHERE rank <= 100", "found_ranked"))
def anomaly_report(spark, sf_dir):
    """The capped report, most severe first."""
    found = anomaly.run_detection(charges(spark, sf_dir, DETECTION), "no_such_column")
    return _shown(anomaly.ranked(found), F.col("rank").cast("bigint").alias("rank"))


define(
    "anomaly_counts",
    """SELECT dataset_id, count(*) AS total_anomalies, count(*) FILTER (WHERE severity = 'critical') AS critical_count,
         count(*) FILTER (WHERE severity = 'high') AS high_count FROM found GROUP BY 1""",
    "found",
)


@query(
    "A13 A12",
    sql(
        """SELECT d.dataset_id, d.first AS period_start, d.last AS period_end, coalesce(total_anomalies, 0) AS total_anomalies,
             coalesce(critical_count, 0) AS critical_count, coalesce(high_count, 0) AS high_count
           FROM (SELECT dataset_id, min(charge_period_start) AS first, max(charge_period_start) AS last FROM charges GROUP BY 1) d
           LEFT JOIN anomaly_counts USING (dataset_id)""",
        "anomaly_counts",
        "charges",
    ),
)
def anomaly_counters(spark, sf_dir):
    billing = charges(spark, sf_dir, DETECTION)
    return anomaly.report(billing, anomaly.run_detection(billing))


define(
    "total_numbered",
    """SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY day) AS rn, count(*) OVER (PARTITION BY dataset_id) AS n
       FROM (SELECT dataset_id, 'total' AS entity_type, 'all' AS entity_value, CAST(charge_period_start AS DATE) AS day,
               sum(billed_cost) AS cost FROM charges GROUP BY ALL)""",
    "charges",
)
define(
    "total_robust",
    """SELECT *, median(abs(cost - median)) OVER (PARTITION BY dataset_id) AS mad,
         stddev_samp(cost) OVER (PARTITION BY dataset_id) AS std
       FROM (SELECT *, median(cost) OVER (PARTITION BY dataset_id) AS median FROM total_numbered)""",
    "total_numbered",
)


@query(
    "N09",
    sql(
        "SELECT "
        + _COLUMNS
        + " FROM ("
        + _scored(
            "total_robust",
            "median",
            "CASE WHEN mad = 0 THEN (cost - median) / nullif(std, 0) ELSE 0.6745::DOUBLE * (cost - median) / mad END",
            3.5,
            "robust_zscore",
            _lines("Median baseline: ", "Modified Z-score: ", 3.5),
        )
        + ")",
        "total_robust",
    ),
)
def total_anomalies(spark, sf_dir):
    """Robust detections on the total of each dataset."""
    found = anomaly.run_detection(charges(spark, sf_dir, ("billed_cost", "charge_period_start")), "total")
    return _shown(found.where(F.col("method") == "robust_zscore"))
