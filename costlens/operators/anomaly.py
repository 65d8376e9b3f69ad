"""Anomaly detectors over the daily panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, text
from ..functions import series as S
from ..functions.tables import renewed
from .panel import TOTAL, daily_series, date_range, with_length, with_rolling

ROLLING, ROBUST, EWMA, SEASONAL = "rolling_zscore", "robust_zscore", "ewma", "seasonal"

# Detector defaults.
ROLLING_WINDOW, ROLLING_THRESHOLD = 14, 3.0
ROBUST_THRESHOLD, MAD_SCALE = 3.5, 0.6745
EWMA_SPAN, EWMA_THRESHOLD, EWMA_MIN_ROWS = 14, 3.0, 5
MIN_SERIES = 7
REPORT_LIMIT = 100


# The wording of the evidence lines here and in the detectors below.
def _detections(
    flagged: DataFrame, method: Column, threshold: Column, baseline: Column, z_label: Column
) -> DataFrame:
    """Common detection rows from ``cost``, ``expected`` and ``z`` of flagged days."""
    scored = flagged.withColumns(
        {
            "method": method,
            "deviation_pct": scores.deviation_pct(F.col("cost"), F.col("expected")),
            "_threshold": threshold,
        }
    )
    evidence = F.array(
        F.concat(baseline, text.money("expected")),
        F.concat(F.lit("Actual: "), text.money("cost")),
        F.concat(z_label, text.fixed("z"), F.format_string(" (threshold: %.1f)", "_threshold")),
        F.concat(F.lit("Deviation: "), text.signed_percent("deviation_pct")),
    )
    return _rows(scored, evidence)


def _rows(scored: DataFrame, evidence: Column) -> DataFrame:
    return scored.select(
        scores.stable_id(*[F.col(k) for k in S.SERIES], F.col("day").cast("string"), F.col("method")).alias("id"),
        *S.SERIES,
        "day",
        F.col("cost").alias("actual_cost"),
        F.col("expected").alias("expected_cost"),
        (F.col("cost") - F.col("expected")).alias("deviation"),
        "deviation_pct",
        F.col("z").alias("z_score"),
        scores.severity(F.col("deviation_pct")).alias("severity"),
        "method",
        F.round(scores.confidence(F.col("z"), F.col("_threshold")), 3).alias("confidence"),
        evidence.alias("supporting_evidence"),
        F.lit("open").alias("status"),
    )


def rolling_zscore(
    panel: DataFrame, window: int = ROLLING_WINDOW, threshold: float = ROLLING_THRESHOLD
) -> DataFrame:
    """Distance from the rolling mean in rolling deviations; needs window + 1 rows.

    The current day is part of its own window, as in the usual rolling z-score.
    """
    scored = with_length(with_rolling(panel, window)).withColumns(
        {
            "expected": F.col("rolling_mean"),
            "z": (F.col("cost") - F.col("rolling_mean")) / F.col("rolling_std"),
        }
    )
    flagged = scored.where((F.col("n") > window) & (F.abs("z") >= threshold))
    return _detections(
        flagged,
        F.lit(ROLLING),
        F.lit(threshold),
        F.lit(f"Rolling mean ({window}d): "),
        F.lit("Z-score: "),
    )


def with_robust(panel: DataFrame) -> DataFrame:
    """Median, MAD and modified z; a zero MAD falls back to the standard deviation."""
    spread = F.nullif(F.stddev_samp("cost").over(S.whole()), F.lit(0.0))
    off = F.col("cost") - F.col("median")
    return (
        S.with_median_mad(panel, "cost", "median", "mad")
        .withColumn("_std", spread)
        .withColumn(
            "robust_z",
            F.when(F.col("mad") == 0, off / F.col("_std")).otherwise(MAD_SCALE * off / F.col("mad")),
        )
        .drop("_std")
    )


def robust_zscore(panel: DataFrame, threshold: float = ROBUST_THRESHOLD) -> DataFrame:
    """Days whose modified z-score reaches the threshold."""
    flagged = (
        with_robust(panel)
        .where(F.abs("robust_z") >= threshold)
        .withColumns({"expected": F.col("median"), "z": F.col("robust_z")})
    )
    return _detections(
        flagged,
        F.lit(ROBUST),
        F.lit(threshold),
        F.lit("Median baseline: "),
        F.lit("Modified Z-score: "),
    )


def with_ewma(panel: DataFrame, span: int = EWMA_SPAN) -> DataFrame:
    """Exponentially weighted mean, its residual, the residuals' deviation and z.

    Where the weighted deviation is missing or 0, the deviation of the
    whole series stands in, unless that is 0 too.
    """
    smooth = S.with_ewm_mean(panel, "cost", "ewma", span)
    off = F.col("cost") - F.col("ewma")
    noise = F.abs(off) <= S.NOISE * F.abs("cost")
    residual = smooth.withColumn("residual", F.when(noise, F.lit(0.0)).otherwise(off))
    spread = S.with_ewm_std(residual, "residual", "ewma_std", span).withColumn(
        "_global", F.nullif(F.stddev_samp("cost").over(S.whole()), F.lit(0.0))
    )
    return (
        spread.withColumn("ewma_std", F.coalesce(F.nullif("ewma_std", F.lit(0.0)), "_global"))
        .withColumn("ewma_z", F.col("residual") / F.col("ewma_std"))
        .drop("_global")
    )


def ewma_zscore(
    panel: DataFrame, span: int = EWMA_SPAN, threshold: float = EWMA_THRESHOLD
) -> DataFrame:
    """Days far from the exponentially weighted mean; needs five rows."""
    flagged = (
        with_length(with_ewma(panel, span))
        .where((F.col("n") >= EWMA_MIN_ROWS) & (F.abs("ewma_z") >= threshold))
        .withColumns({"expected": F.col("ewma"), "z": F.col("ewma_z")})
    )
    return _detections(
        flagged,
        F.lit(EWMA),
        F.lit(threshold),
        F.lit(f"EWMA baseline (span={span}): "),
        F.lit("EWMA Z-score: "),
    )


def residual_anomalies(
    panel: DataFrame, expected: str, method: str, threshold: float = 3.0
) -> DataFrame:
    """Detections against any expected value, such as a forecast or a seasonal baseline."""
    off = F.col("cost") - F.col("expected")
    scored = (
        panel.withColumn("expected", F.col(expected))
        .withColumn("_std", F.nullif(F.stddev_samp(off).over(S.whole()), F.lit(0.0)))
        .withColumns(
            {
                "z": off / F.col("_std"),
                "method": F.lit(method),
                "_threshold": F.lit(threshold),
                "deviation_pct": scores.deviation_pct(F.col("cost"), F.col("expected")),
            }
        )
        .where((F.col("expected") != 0) & (F.abs("z") >= threshold))
    )
    evidence = F.array(
        F.concat(F.lit("Actual: "), text.money("cost")),
        F.concat(F.lit("Expected: "), text.money("expected")),
        F.concat(F.lit("Deviation: "), text.signed_percent("deviation_pct")),
        F.concat(F.lit("Z-score: "), text.fixed("z")),
        F.concat(F.lit("Detection method: "), F.col("method")),
    )
    return _rows(scored, evidence)


def seasonal_baseline(panel: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Extension: the expected cost of a day is the median of its weekday."""
    weekday = Window.partitionBy(*S.SERIES, F.weekday("day"))
    return residual_anomalies(
        panel.withColumn("weekday_median", F.median("cost").over(weekday)),
        "weekday_median",
        SEASONAL,
        threshold,
    )


def drop_found(secondary: DataFrame, primary: DataFrame) -> DataFrame:
    """Detections whose series and day the primary detector has not found already."""
    keys = [*S.SERIES, "day"]
    return secondary.join(renewed(primary.select(*keys)), keys, "left_anti")


def combine(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """All primary detections and the secondary ones on other days."""
    return primary.unionByName(drop_found(secondary, primary))


def detect(panel: DataFrame, min_rows: int = MIN_SERIES) -> DataFrame:
    """Robust z-score, then EWMA on the days the former did not flag.

    Gives the rows of ``combine(robust_zscore(p), ewma_zscore(p))`` with one
    partitioning of the panel: both scores are computed side by side and
    the first that fires names the method.
    """
    long_enough = with_length(panel).where(F.col("n") >= min_rows)
    scored = with_ewma(with_robust(long_enough))
    robust = F.abs("robust_z") >= ROBUST_THRESHOLD
    ewma = (F.col("n") >= EWMA_MIN_ROWS) & (F.abs("ewma_z") >= EWMA_THRESHOLD)
    is_robust = F.col("_method") == ROBUST

    def pick(when_robust: Column, when_ewma: Column) -> Column:
        return F.when(is_robust, when_robust).otherwise(when_ewma)

    flagged = (
        scored.withColumn("_method", F.when(robust, ROBUST).when(ewma, EWMA))
        .where(F.col("_method").isNotNull())
        .withColumns(
            {
                "expected": pick(F.col("median"), F.col("ewma")),
                "z": pick(F.col("robust_z"), F.col("ewma_z")),
            }
        )
    )
    return _detections(
        flagged,
        F.col("_method"),
        pick(F.lit(ROBUST_THRESHOLD), F.lit(EWMA_THRESHOLD)),
        pick(F.lit("Median baseline: "), F.lit(f"EWMA baseline (span={EWMA_SPAN}): ")),
        pick(F.lit("Modified Z-score: "), F.lit("EWMA Z-score: ")),
    )


def run_detection(billing: DataFrame, entity_type: str = "service") -> DataFrame:
    """Detections for every entity of a type; an unknown type means service."""
    if entity_type != TOTAL and entity_type not in billing.columns:
        entity_type = "service"
    return detect(daily_series(billing, (entity_type,)))


def ranked(anomalies: DataFrame, limit: int = REPORT_LIMIT) -> DataFrame:
    """Most severe first, then largest deviation; ``limit`` rows per dataset."""
    order = Window.partitionBy("dataset_id").orderBy(
        scores.severity_rank(F.col("severity")),
        F.desc(F.abs("deviation_pct")),
        "entity_type",
        "entity_value",
        "day",
        "method",
    )
    return anomalies.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def counters(anomalies: DataFrame) -> DataFrame:
    """Detections per dataset, counted before any report limit."""
    return anomalies.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("total_anomalies"),
        F.count_if(F.col("severity") == "critical").alias("critical_count"),
        F.count_if(F.col("severity") == "high").alias("high_count"),
    )


def report(billing: DataFrame, anomalies: DataFrame) -> DataFrame:
    """One row per dataset: period and counters, zeros where nothing was found."""
    zero = F.lit(0).cast("bigint")
    return (
        date_range(billing)
        .join(renewed(counters(anomalies)), "dataset_id", "left")
        .withColumns(
            {c: F.coalesce(c, zero) for c in ("total_anomalies", "critical_count", "high_count")}
        )
    )
