"""Daily panel and window columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from costlens.functions import series as S
from costlens.operators import anomaly, forecast, opportunity, panel

from . import spend_queries  # noqa: F401  (defines the usage fragment)
from .inputs import charges, define, sql
from .registry import query

KEYS = ["dataset_id", "entity_type", "entity_value"]
K = "dataset_id, entity_type, entity_value"
W = f"PARTITION BY {K} ORDER BY day"

define(
    "panel",
    """SELECT dataset_id, 'service' AS entity_type, service AS entity_value,
         CAST(charge_period_start AS DATE) AS day, sum(billed_cost) AS cost
       FROM charges WHERE service IS NOT NULL GROUP BY ALL""",
    "charges",
)
define(
    "numbered",
    f"""SELECT *, row_number() OVER ({W}) AS rn, count(*) OVER (PARTITION BY {K}) AS n FROM panel""",
    "panel",
)


def service_panel(spark, sf_dir):
    billing = charges(spark, sf_dir, ("billed_cost", "service", "charge_period_start"))
    return panel.daily_series(billing, ("service",))


def r(names, digits=2):
    return [F.round(n, digits).alias(n) for n in names.split()]


# A mean of a few amounts can lie on a decimal tie, where the last digit hangs on
# the order of addition; both sides nudge means off it before rounding.
NUDGE = 0.000003


def means(names):
    return [F.round(F.col(n) + NUDGE, 4).alias(n) for n in names.split()]


def means_sql(**columns):
    return ", ".join(f"round({value} + {NUDGE:f}, 4) AS {name}" for name, value in columns.items())


@query(
    "A09",
    sql(
        "SELECT * REPLACE (round(cost, 2) AS cost) FROM panel UNION ALL "
        + " UNION ALL ".join(
            f"""SELECT dataset_id, '{kind}', {value}, CAST(charge_period_start AS DATE), round(sum(billed_cost), 2)
                FROM charges WHERE {value} IS NOT NULL GROUP BY ALL"""
            for kind, value in (("region", "region"), ("total", "'all'"))
        ),
        "panel",
    ),
)
def daily_series(spark, sf_dir):
    billing = charges(spark, sf_dir, ("billed_cost", "service", "region", "charge_period_start"))
    return panel.daily_series(billing, ("service", "region", "total")).select(*KEYS, "day", *r("cost"))


@query(
    "A09 P02",
    sql(
        """SELECT dataset_id, day, provider, service, metered, round(sum(billed_cost), 2) AS billed_cost,
             count(*) AS charge_count
           FROM (SELECT *, CAST(charge_period_start AS DATE) AS day, quantity > 0 AS metered FROM charges)
           GROUP BY dataset_id, day, provider, account, service, region, metered""",
        "charges",
    ),
)
def daily_rollup(spark, sf_dir):
    """The shared pre-aggregation of the decision run."""
    return panel.daily_rollup(charges(spark, sf_dir)).select(
        "dataset_id",
        F.to_date("charge_period_start").alias("day"),
        "provider",
        "service",
        F.col("is_metered").alias("metered"),
        *r("billed_cost"),
        "charge_count",
    )


@query(
    "W01",
    sql(
        f"""SELECT {K}, day, CASE WHEN c >= 7 THEN round(m + {NUDGE:f}, 4) END AS rolling_mean,
              CASE WHEN c >= 7 AND s > 0 THEN round(s, 3) END AS rolling_std
            FROM (SELECT *, count(cost) OVER f AS c, avg(cost) OVER f AS m, stddev_samp(cost) OVER f AS s FROM panel
                  WINDOW f AS ({W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))""",
        "panel",
    ),
)
def rolling_stats(spark, sf_dir):
    return panel.with_rolling(service_panel(spark, sf_dir)).select(
        *KEYS, "day", *means("rolling_mean"), *r("rolling_std", 3)
    )


# Straight from the definition: every row against the 500 rows before it.
# The weight of an older row is below 1e-31.
_DECAY = "(13.0::DOUBLE / 15)"


def _weighted(source: str, value: str) -> str:
    return f"""SELECT a.dataset_id, a.entity_type, a.entity_value, a.rn,
          sum(b.{value} * pow({_DECAY}, a.rn - b.rn)) / sum(pow({_DECAY}, a.rn - b.rn)) AS mean,
          sum(pow({_DECAY}, a.rn - b.rn)) AS w, sum(pow({_DECAY}, 2 * (a.rn - b.rn))) AS w2
        FROM {source} a JOIN {source} b ON a.dataset_id = b.dataset_id AND a.entity_value = b.entity_value
          AND b.rn BETWEEN a.rn - 500 AND a.rn GROUP BY ALL"""


define("smoothed", _weighted("numbered", "cost"), "numbered")
define(
    "residuals",
    "SELECT n.*, s.mean AS ewma, n.cost - s.mean AS residual FROM numbered n JOIN smoothed s USING (dataset_id, entity_type, entity_value, rn)",
    "numbered",
    "smoothed",
)
define("residual_means", _weighted("residuals", "residual"), "residuals")
define(
    "spread",
    f"""SELECT a.dataset_id, a.entity_type, a.entity_value, a.rn,
          sum(pow({_DECAY}, a.rn - b.rn) * (b.residual - m.mean) ** 2) / any_value(m.w) AS variance,
          any_value(m.w) AS w, any_value(m.w2) AS w2
        FROM residuals a JOIN residuals b ON a.dataset_id = b.dataset_id AND a.entity_value = b.entity_value
          AND b.rn BETWEEN a.rn - 500 AND a.rn
        JOIN residual_means m ON m.dataset_id = a.dataset_id AND m.entity_value = a.entity_value AND m.rn = a.rn
        GROUP BY ALL""",
    "residuals",
    "residual_means",
)
define(
    "ewma",
    f"""SELECT r.*, coalesce(nullif(CASE WHEN rn > 1 THEN sqrt(s.variance * s.w * s.w / (s.w * s.w - s.w2)) END, 0),
            nullif(stddev_samp(cost) OVER (PARTITION BY {K}), 0)) AS ewma_std
        FROM residuals r JOIN spread s USING (dataset_id, entity_type, entity_value, rn)""",
    "residuals",
    "spread",
)


@query(
    "W02 W03",
    sql(f"SELECT {K}, day, round(ewma, 3) AS ewma, round(ewma_std, 3) AS ewma_std FROM ewma", "ewma"),
)
def ewm_stats(spark, sf_dir):
    return anomaly.with_ewma(service_panel(spark, sf_dir)).select(*KEYS, "day", *r("ewma ewma_std", 3))


define(
    "median_mad",
    f"""SELECT *, median(abs(cost - median)) OVER (PARTITION BY {K}) AS mad
        FROM (SELECT *, median(cost) OVER (PARTITION BY {K}) AS median, stddev_samp(cost) OVER (PARTITION BY {K}) AS std
              FROM numbered)""",
    "numbered",
)


@query(
    "W04",
    sql(f"SELECT DISTINCT {K}, round(median, 3) AS median, round(mad, 3) AS mad FROM median_mad", "median_mad"),
)
def median_mad(spark, sf_dir):
    scored = S.with_median_mad(service_panel(spark, sf_dir), "cost", "median", "mad")
    return scored.select(*KEYS, *r("median mad", 3)).distinct()


_LAGS = ", ".join(f"lag(cost, {k}) OVER w AS lag_{k}" for k in (1, 7, 14, 28))


def _rolled(function: str, k: int) -> str:
    frame = f"({W} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count(cost) OVER {frame} >= {k} THEN {function}(cost) OVER {frame} END"


define(
    "features",
    f"""SELECT *, lag_1 / nullif(lag_8, 0) - 1 AS growth_7d, lag_1 / nullif(lag_29, 0) - 1 AS growth_28d,
          CAST(isodow(day) - 1 AS BIGINT) AS day_of_week, CAST(dayofmonth(day) AS BIGINT) AS day_of_month,
          CAST(weekofyear(day) AS BIGINT) AS week_of_year, CAST(month(day) AS BIGINT) AS month
        FROM (SELECT *, {_LAGS}, lag(cost, 8) OVER w AS lag_8, lag(cost, 29) OVER w AS lag_29,
            {_rolled('avg', 7)} AS rolling_mean_7, {_rolled('avg', 14)} AS rolling_mean_14,
            {_rolled('stddev_samp', 7)} AS rolling_std_7
          FROM numbered WINDOW w AS ({W}))""",
    "numbered",
)


def _feature_sql(source: str) -> str:
    return f"""SELECT {K}, day, {', '.join(f'round({c}, 3) AS {c}' for c in ('lag_1', 'lag_7', 'lag_14', 'lag_28', 'rolling_mean_7', 'rolling_mean_14', 'rolling_std_7'))},
      round(growth_7d, 6) AS growth_7d, round(growth_28d, 6) AS growth_28d, day_of_week, day_of_month, week_of_year, month
    FROM {source}"""


@query("W05 W06 W07", sql(_feature_sql("features"), "features"))
def lag_features(spark, sf_dir):
    """All rows, with NULL where a feature has too little history."""
    return _feature_columns(forecast.features(service_panel(spark, sf_dir), keep_incomplete=True))


def _feature_columns(rows):
    return rows.select(
        *KEYS,
        "day",
        *r("lag_1 lag_7 lag_14 lag_28 rolling_mean_7 rolling_mean_14 rolling_std_7", 3),
        *r("growth_7d growth_28d", 6),
        *[F.col(c).cast("bigint").alias(c) for c in ("day_of_week", "day_of_month", "week_of_year", "month")],
    )


define("complete", "SELECT * FROM features WHERE lag_29 IS NOT NULL AND cost IS NOT NULL AND lag_29 <> 0 AND lag_8 <> 0", "features")


@query("F05", sql(_feature_sql("complete"), "complete"))
def forecast_features(spark, sf_dir):
    """Only rows whose features are complete."""
    return _feature_columns(forecast.features(service_panel(spark, sf_dir)))


@query(
    "W08",
    sql(
        f"""SELECT {K}, day, round(avg(cost) OVER ({W} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 4) AS trailing_average
            FROM panel""",
        "panel",
    ),
)
def trailing_average(spark, sf_dir):
    return panel.with_trailing_average(service_panel(spark, sf_dir)).select(*KEYS, "day", *r("trailing_average", 4))


CHANGE = "CASE WHEN {p} > 0 THEN ({c} - {p}) / {p} * 100 ELSE 0 END"
define(
    "usage_change",
    f"""SELECT *, {CHANGE.format(c='cost', p='prior_cost')} AS cost_change,
          {CHANGE.format(c='quantity', p='prior_quantity')} AS quantity_change
        FROM (SELECT *, lag(cost) OVER w AS prior_cost, lag(quantity) OVER w AS prior_quantity,
                lag(month) OVER w AS prior_month,
                row_number() OVER (PARTITION BY dataset_id, service ORDER BY month DESC) AS age
              FROM usage WINDOW w AS (PARTITION BY dataset_id, service ORDER BY month))
        WHERE age = 1 AND prior_month IS NOT NULL""",
    "usage",
)


@query(
    "W09",
    sql(
        """SELECT dataset_id, service, month, prior_month, round(cost, 2) AS cost, round(prior_cost, 2) AS prior_cost,
             round(cost_change, 4) AS cost_change, round(quantity_change, 4) AS quantity_change FROM usage_change""",
        "usage_change",
    ),
)
def previous_month(spark, sf_dir):
    billing = charges(spark, sf_dir, ("billed_cost", "quantity", "service", "charge_period_start"))
    usage = opportunity.monthly_service_usage(billing)
    return opportunity.latest_usage_change(usage).select(
        "dataset_id",
        "service",
        "month",
        "prior_month",
        *r("cost prior_cost"),
        *r("cost_change quantity_change", 4),
    )


@query(
    "W10",
    sql(
        f"""SELECT {K}, day, rn - 1 AS position, n, CAST(floor(n * 0.6::DOUBLE) AS BIGINT) AS split_60,
              CAST(floor(n * 0.8::DOUBLE) AS BIGINT) AS split_80 FROM numbered""",
        "numbered",
    ),
)
def split_positions(spark, sf_dir):
    return panel.with_positions(service_panel(spark, sf_dir)).select(
        *KEYS, "day", F.col("position").cast("bigint").alias("position"), "n", "split_60", "split_80"
    )


@query(
    "W11",
    sql(
        f"""SELECT {K}, count(*) AS n, min(day) AS first_day, max(day) AS last_day,
              round(arg_min(cost, day), 2) AS first_cost, round(arg_max(cost, day), 2) AS last_cost
            FROM panel GROUP BY ALL""",
        "panel",
    ),
)
def series_bounds(spark, sf_dir):
    return panel.series_bounds(service_panel(spark, sf_dir)).select(
        *KEYS, "n", "first_day", "last_day", *r("first_cost last_cost")
    )
