"""Forecasts, hold-out metrics, gate, fallback."""

from __future__ import annotations

from pyspark.sql import functions as F

from costlens.functions.trees import Ensemble
from costlens.operators import forecast, panel

from .inputs import charges, define, sql
from .panel_queries import KEYS, K, means, means_sql, r, service_panel
from .registry import query

HORIZON = 30
_KEYED = "PARTITION BY dataset_id, entity_type, entity_value"

define("steps", f"SELECT CAST(range AS INTEGER) AS step FROM range(1, {HORIZON + 1})")
define(
    "last_rows",
    f"""SELECT *, avg(cost) OVER ({_KEYED} ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS newest,
          avg(cost) OVER ({_KEYED} ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS earlier FROM numbered""",
    "numbered",
)
_POINTS = f"{K}, '{{method}}' AS method, step, CAST(day + step AS DATE) AS day, round({{value}}, 3) AS yhat"


def _points_sql(method: str, value: str, where: str = "TRUE") -> str:
    return f"SELECT {_POINTS.format(method=method, value=value)} FROM last_rows CROSS JOIN steps WHERE rn = n AND {where}"


def _points(rows):
    return rows.select(*KEYS, "method", "step", "day", F.round("yhat", 3).alias("yhat"))


@query("F02", sql(_points_sql("naive", "cost"), "last_rows", "steps"))
def naive_forecast(spark, sf_dir):
    return _points(forecast.naive(service_panel(spark, sf_dir), HORIZON))


@query("F03 W08", sql(_points_sql("moving_average", "newest", "n >= 7"), "last_rows", "steps"))
def moving_average_forecast(spark, sf_dir):
    return _points(forecast.moving_average(service_panel(spark, sf_dir), HORIZON))


define(
    "holdout",
    f"""SELECT {K}, 'naive' AS method, cost AS actual, base AS predicted FROM (
          SELECT *, max(CASE WHEN rn = split THEN cost END) OVER ({_KEYED}) AS base
          FROM (SELECT *, greatest(1, floor(n * 0.8::DOUBLE)) AS split FROM numbered) WHERE n >= 5) WHERE rn > split
        UNION ALL SELECT {K}, 'moving_average', cost, earlier FROM last_rows
          WHERE n >= 9 AND rn > greatest(7, floor(n * 0.8::DOUBLE))""",
    "numbered",
    "last_rows",
)
define(
    "metrics",
    f"""SELECT {K}, method, count(*) AS holdout_rows, avg(abs(predicted - actual)) AS mae,
          sqrt(avg((predicted - actual) ** 2)) AS rmse, sum(abs(predicted - actual)) / sum(abs(actual)) AS wape,
          avg(predicted - actual) AS bias FROM holdout GROUP BY ALL""",
    "holdout",
)


def _holdouts(spark, sf_dir):
    rows = service_panel(spark, sf_dir)
    return forecast.metrics(forecast.naive_holdout(rows).unionByName(forecast.moving_average_holdout(rows)))


@query(
    "F01 F02 F03",
    sql(
        f"SELECT {K}, method, holdout_rows, round(rmse, 3) AS rmse, round(wape, 6) AS wape, "
        f"{means_sql(mae='mae', bias='bias')} FROM metrics",
        "metrics",
    ),
)
def forecast_metrics(spark, sf_dir):
    return _holdouts(spark, sf_dir).select(*KEYS, "method", "holdout_rows", *means("mae bias"), *r("rmse", 3), *r("wape", 6))


@query(
    "F08",
    sql(
        f"""SELECT {K}, method, round(wape, 6) AS wape FROM metrics QUALIFY row_number() OVER ({_KEYED}
              ORDER BY wape, CASE method WHEN 'naive' THEN 1 ELSE 2 END) = 1""",
        "metrics",
    ),
)
def best_method(spark, sf_dir):
    """Every method gated by WAPE, the simpler one winning a tie."""
    return forecast.best_method(_holdouts(spark, sf_dir)).select(*KEYS, "method", *r("wape", 6))


@query(
    "F08",
    sql(
        f"""SELECT {K}, round(a.wape, 6) AS wape, round(b.wape, 6) AS baseline_wape, a.wape < b.wape AS passed
            FROM (SELECT * FROM metrics WHERE method = 'moving_average') a
            JOIN (SELECT * FROM metrics WHERE method = 'naive') b USING (dataset_id, entity_type, entity_value)""",
        "metrics",
    ),
)
def model_gate(spark, sf_dir):
    """The gate, with the moving average standing in for the model."""
    found = _holdouts(spark, sf_dir)
    gate = forecast.passes_gate(
        found.where(F.col("method") == "moving_average"), found.where(F.col("method") == "naive")
    )
    return gate.select(*KEYS, *r("wape baseline_wape", 6), "passed")


PARAMS = (0.2, 0.05, 0.1)
# Level, trend and the seven weekly parts, one row per step.  The weekly list
# turns by one place with every step, so its head belongs to the current day.
define(
    "smoothing_input",
    f"""SELECT {K}, rn, n, day, cost, part, k FROM (
          SELECT *, 'holdout' AS part, greatest(7, floor(n * 0.8::DOUBLE)) AS k FROM numbered WHERE n >= 10
          UNION ALL SELECT *, 'forecast' AS part, n AS k FROM numbered WHERE n >= 10) WHERE rn <= k""",
    "numbered",
)
define(
    "smoothing_start",
    f"""SELECT {K}, part, n, k::BIGINT AS k, avg(cost) FILTER (WHERE rn <= 7) AS first_week,
          avg(cost) FILTER (WHERE rn > 7 AND rn <= 14) AS second_week,
          list(cost ORDER BY rn) FILTER (WHERE rn <= 7) AS first_days
        FROM smoothing_input GROUP BY ALL""",
    "smoothing_input",
)
define(
    "smoothing_run",
    f"""SELECT {K}, part, n, k, 0::BIGINT AS rn, first_week::DOUBLE AS level, ((second_week - first_week) / 7)::DOUBLE AS trend,
          list_transform(first_days, lambda x: (x - first_week)::DOUBLE) AS season FROM smoothing_start
        UNION ALL
        SELECT s.dataset_id, s.entity_type, s.entity_value, s.part, s.n, s.k, i.rn,
          s.level + s.trend + {PARAMS[0]}::DOUBLE * (i.cost - s.level - s.trend - s.season[1]),
          s.trend + {PARAMS[1]}::DOUBLE * (i.cost - s.level - s.trend - s.season[1]),
          list_append(s.season[2:7], s.season[1] + {PARAMS[2]}::DOUBLE * (i.cost - s.level - s.trend - s.season[1]))
        FROM smoothing_run s JOIN smoothing_input i ON i.dataset_id = s.dataset_id AND i.entity_value = s.entity_value
          AND i.part = s.part AND i.rn = s.rn + 1""",
    "smoothing_start",
    "smoothing_input",
)
define("smoothing_end", "SELECT * FROM smoothing_run WHERE rn = k", "smoothing_run")


@query(
    "F04",
    sql(
        f"""SELECT {K}, 'forecast' AS kind, step, CAST(l.day + step AS DATE) AS day, NULL::DOUBLE AS actual,
              round(greatest(0, level + trend * step + season[(step - 1) % 7 + 1]), 2) AS yhat
            FROM smoothing_end JOIN (SELECT {K}, max(day) AS day FROM panel GROUP BY ALL) l USING ({K}) CROSS JOIN steps
            WHERE part = 'forecast'
            UNION ALL SELECT {K}, 'holdout', CAST(p.rn - e.k AS INTEGER), p.day, round(p.cost, 2),
              round(level + trend * (p.rn - e.k) + season[(p.rn - e.k - 1) % 7 + 1], 2)
            FROM (SELECT * FROM smoothing_end WHERE part = 'holdout') e
            JOIN (SELECT {K}, rn, day, cost FROM numbered) p USING ({K}) WHERE p.rn > e.k""",
        "smoothing_end",
        "numbered",
        "panel",
        "steps",
    ),
)
def holt_winters_given(spark, sf_dir):
    """Additive trend and week with given parameters."""
    fitted = forecast.holt_winters(service_panel(spark, sf_dir), HORIZON, PARAMS)
    return fitted.select(*KEYS, "kind", "step", "day", *r("actual yhat"))


@query("F04 F01")
def holt_winters_fitted(spark, sf_dir):
    """Parameters by least squares per series: an optimization, so no SQL; see the tests."""
    fitted = forecast.holt_winters(service_panel(spark, sf_dir), HORIZON)
    return forecast.metrics(forecast.smoothing_holdout(fitted))


define(
    "modelled",
    """SELECT *, CASE WHEN position < floor(n_clean * 0.6::DOUBLE) THEN 'train'
           WHEN position < floor(n_clean * 0.8::DOUBLE) THEN 'val' ELSE 'test' END AS split
       FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, entity_value ORDER BY day) - 1 AS position,
               count(*) OVER (PARTITION BY dataset_id, entity_value) AS n_clean FROM complete WHERE n >= 28)
       WHERE n_clean >= 10""",
    "complete",
)


@query(
    "F06",
    sql(f"SELECT {K}, day, n_clean, position, split FROM modelled", "modelled"),
)
def temporal_split(spark, sf_dir):
    return forecast.modelled_rows(service_panel(spark, sf_dir)).select(
        *KEYS, "day", "n_clean", F.col("position").cast("bigint").alias("position"), "split"
    )


@query(
    "F08",
    sql(
        f"""SELECT {K}, day, round(cost, 2) AS actual, round(last_value, 2) AS predicted FROM (
              SELECT *, max(CASE WHEN position = floor(n_clean * 0.6::DOUBLE) - 1 THEN cost END)
                OVER (PARTITION BY dataset_id, entity_value) AS last_value FROM modelled) WHERE split = 'val'""",
        "modelled",
    ),
)
def gate_baseline(spark, sf_dir):
    rows = forecast.gate_baseline(forecast.modelled_rows(service_panel(spark, sf_dir)))
    return rows.select(*KEYS, "day", *r("actual predicted"))


@query("F07 F08 F09")
def boosted_forecast(spark, sf_dir):
    """One boosted-tree model over all series, gated, then rolled forward day by day.

    Spark ML has its own trees, so no SQL gives these values; see the tests.
    """
    rows = service_panel(spark, sf_dir)
    parts = forecast.modelled_rows(rows)
    model = forecast.fit_boosted(parts)
    gate = forecast.passes_gate(
        forecast.metrics(forecast.boosted_holdout(model, parts)),
        forecast.metrics(forecast.gate_baseline(parts)),
    )
    points = forecast.boosted_forecast(model, rows, HORIZON)
    return points.join(gate.select(*KEYS, "passed"), KEYS, "left")


#: A small model whose splits use every feature, said once more in SQL below.
GIVEN = Ensemble(
    (
        (1.0, (0, 70000.0, (4, 60000.0, 45000.0, 65000.0), (5, 85000.0, 80000.0, 110000.0))),
        (0.5, (7, 4.0, (11, 0.5, 6000.0, -4000.5), (8, 15.0, -9000.25, 2500.0))),
        (0.25, (6, 60000.0, (1, 75000.0, -8000.0, 12000.0), (3, 50000.0, 3000.0, (12, 0.0, -16000.0, 20000.0)))),
        (0.125, (9, 26.0, (10, 3.0, 1000.0, 2000.0), (2, 74000.0, -3000.0, 5000.0))),
    )
)
_GIVEN_SQL = """CASE WHEN lag_1 <= 70000 THEN CASE WHEN rolling_mean_7 <= 60000 THEN 45000 ELSE 65000 END
        WHEN rolling_mean_14 <= 85000 THEN 80000 ELSE 110000 END::DOUBLE
      + 0.5::DOUBLE * CASE WHEN day_of_week <= 4 THEN CASE WHEN growth_7d <= 0.5 THEN 6000 ELSE -4000.5 END
        WHEN day_of_month <= 15 THEN -9000.25 ELSE 2500 END
      + 0.25::DOUBLE * CASE WHEN rolling_std_7 <= 60000 THEN CASE WHEN lag_7 <= 75000 THEN -8000 ELSE 12000 END
        WHEN lag_28 <= 50000 THEN 3000 WHEN growth_28d <= 0 THEN -16000 ELSE 20000 END
      + 0.125::DOUBLE * CASE WHEN week_of_year <= 26 THEN CASE WHEN month <= 3 THEN 1000 ELSE 2000 END
        WHEN lag_14 <= 74000 THEN -3000 ELSE 5000 END"""

define(
    "boosted_start",
    f"SELECT {K}, max(day) AS last_day, list(cost ORDER BY day) AS past FROM numbered WHERE n >= 29 AND rn > n - 29 GROUP BY ALL",
    "numbered",
)


def rolled_sql(run: str, start: str, keys: str = K) -> str:
    """Body of the recursion ``run`` from the rows of ``start`` (keys, last_day, past), one row more for each step."""
    return f"""SELECT {keys}, last_day, 0 AS step, past, NULL::DOUBLE AS yhat FROM {start}
        UNION ALL
        SELECT {keys}, last_day, step, list_append(past, greatest(0, found)), greatest(0, found) FROM (
          SELECT *, {_GIVEN_SQL} AS found FROM (
            SELECT {keys}, last_day, past, step + 1 AS step, past[-1] AS lag_1, past[-7] AS lag_7, past[-14] AS lag_14, past[-28] AS lag_28,
              list_avg(past[-7:]) AS rolling_mean_7, list_avg(past[-14:]) AS rolling_mean_14,
              list_aggregate(past[-7:], 'stddev_samp') AS rolling_std_7,
              coalesce(past[-1] / nullif(past[-8], 0) - 1, 0) AS growth_7d, coalesce(past[-1] / nullif(past[-29], 0) - 1, 0) AS growth_28d,
              isodow(last_day + step + 1) - 1 AS day_of_week, dayofmonth(last_day + step + 1) AS day_of_month,
              weekofyear(last_day + step + 1) AS week_of_year, month(last_day + step + 1) AS month
            FROM {run} WHERE step < {HORIZON}))"""


define("boosted_run", rolled_sql("boosted_run", "boosted_start"), "boosted_start")


@query(
    "F09",
    sql(
        f"""SELECT {K}, 'boosted_trees' AS method, step, CAST(last_day + step AS DATE) AS day, round(yhat, 3) AS yhat
            FROM boosted_run WHERE step > 0""",
        "boosted_run",
    ),
)
def boosted_given(spark, sf_dir):
    """Thirty days by a given model, each day's prediction being history for the next."""
    return _points(forecast.boosted_forecast(GIVEN, service_panel(spark, sf_dir), HORIZON))


define(
    "boosted_errors",
    f"""SELECT {K}, count(*) AS holdout_rows, avg(abs(found - cost)) AS mae, sum(abs(found - cost)) / sum(abs(cost)) AS wape,
          avg(found - cost) AS bias, sum(abs(base - cost)) / sum(abs(cost)) AS baseline_wape FROM (
          SELECT *, {_GIVEN_SQL} AS found,
            max(CASE WHEN position = floor(n_clean * 0.6::DOUBLE) - 1 THEN cost END) OVER (PARTITION BY dataset_id, entity_value) AS base
          FROM modelled) WHERE split = 'val' GROUP BY ALL""",
    "modelled",
)


@query(
    "F07 F08",
    sql(
        f"""SELECT {K}, holdout_rows, round(wape, 6) AS wape, round(baseline_wape, 6) AS baseline_wape, wape < baseline_wape AS passed,
              {means_sql(mae='mae', bias='bias')} FROM boosted_errors""",
        "boosted_errors",
    ),
)
def boosted_gate_given(spark, sf_dir):
    """A given model on the validation rows of every series, against the last training value."""
    parts = forecast.modelled_rows(service_panel(spark, sf_dir))
    found = forecast.metrics(forecast.boosted_holdout(GIVEN, parts))
    gate = forecast.passes_gate(found, forecast.metrics(forecast.gate_baseline(parts)))
    return gate.select(*KEYS, "holdout_rows", *r("wape baseline_wape", 6), "passed", *means("mae bias"))


define(
    "given_points",
    f"""SELECT {K}, 'boosted_trees' AS method, step, yhat FROM boosted_run JOIN (SELECT {K} FROM boosted_errors WHERE wape < baseline_wape)
          USING ({K}) WHERE step > 0
        UNION ALL SELECT {K}, 'exp_smoothing', step, greatest(0, level + trend * step + season[(step - 1) % 7 + 1])
          FROM smoothing_end CROSS JOIN steps WHERE part = 'forecast'
            AND NOT EXISTS (SELECT 1 FROM boosted_errors b WHERE b.dataset_id = smoothing_end.dataset_id
              AND b.entity_value = smoothing_end.entity_value AND wape < baseline_wape)""",
    "boosted_run",
    "boosted_errors",
    "smoothing_end",
    "steps",
)


@query(
    "F10 F11 F12",
    sql(
        f"""SELECT {K}, method, count(*) AS n_points, round(sum(yhat), 1) AS forecast_total,
              CASE method WHEN 'boosted_trees' THEN 4 END AS n_trees, any_value(e.holdout_rows) AS holdout_rows,
              any_value(round(e.wape, 6)) AS wape, any_value(round(e.baseline_wape, 6)) AS baseline_wape
            FROM given_points LEFT JOIN (SELECT {K}, 'boosted_trees' AS method, holdout_rows, wape, baseline_wape FROM boosted_errors) e
              USING ({K}, method) GROUP BY ALL""",
        "given_points",
        "boosted_errors",
    ),
)
def forecast_result_given(spark, sf_dir):
    """The whole chain with a given model and given weights: trees where they pass their gate, smoothing elsewhere."""
    rows = service_panel(spark, sf_dir)
    chain = forecast.boosted_chain(rows, HORIZON, model=GIVEN)
    trees = F.col("method") == forecast.BOOSTED
    return forecast.forecast_result(rows, HORIZON, params=PARAMS, boosted=chain).select(
        *KEYS,
        "method",
        F.size("points").cast("bigint").alias("n_points"),
        F.round(F.aggregate("points", F.lit(0.0), lambda a, p: a + p["yhat"]), 1).alias("forecast_total"),
        "n_trees",
        # the SQL has the errors of the trees only; those of smoothing are compared in holt_winters_given
        F.when(trees, F.col("holdout_rows")).alias("holdout_rows"),
        *[F.when(trees, F.round(c, 6)).alias(c) for c in ("wape", "baseline_wape")],
    )


define(
    "resource_series",
    """SELECT dataset_id, 'resource' AS entity_type, resource AS entity_value, count(DISTINCT CAST(charge_period_start AS DATE)) AS n,
         min(CAST(charge_period_start AS DATE)) AS first_day, max(CAST(charge_period_start AS DATE)) AS last_day
       FROM charges GROUP BY ALL""",
    "charges",
)
define(
    "chosen",
    """SELECT *, CASE WHEN n >= 10 THEN 'exp_smoothing' WHEN n >= 7 THEN 'moving_average' WHEN n >= 5 THEN 'naive'
         ELSE 'skipped' END AS method FROM resource_series""",
    "resource_series",
)


def _resource_panel(spark, sf_dir):
    billing = charges(spark, sf_dir, ("billed_cost", "resource", "charge_period_start"))
    return panel.daily_series(billing, ("resource",))


@query("F10", sql(f"SELECT {K}, n, first_day, last_day, method FROM chosen", "chosen"))
def forecast_fallback(spark, sf_dir):
    """The method each of many short series gets; too short ones are skipped."""
    return forecast.chosen_methods(_resource_panel(spark, sf_dir))


@query("F10", sql(f"SELECT {K}, n, first_day, last_day FROM chosen WHERE method = 'skipped'", "chosen"))
def skipped_series(spark, sf_dir):
    return forecast.skipped(_resource_panel(spark, sf_dir))


@query(
    "F12",
    sql(
        f"""SELECT {K}, method, CASE method WHEN 'exp_smoothing' THEN 'holtwinters-v1' WHEN 'moving_average' THEN 'ma-7d-v1'
              ELSE 'naive-v1' END AS model_version, {HORIZON}::INTEGER AS forecast_horizon_days, first_day AS training_start,
              last_day AS training_end, CASE WHEN method = 'moving_average' THEN 7 END AS "window"
            FROM chosen WHERE method <> 'skipped'""",
        "chosen",
    ),
)
def forecast_metadata(spark, sf_dir):
    return forecast.metadata(_resource_panel(spark, sf_dir), HORIZON).select(
        *KEYS, "method", "model_version", "forecast_horizon_days", "training_start", "training_end", "window"
    )


define(
    "resource_rows",
    f"""SELECT *, row_number() OVER ({_KEYED} ORDER BY day) AS rn, count(*) OVER ({_KEYED}) AS n FROM (
          SELECT dataset_id, 'resource' AS entity_type, resource AS entity_value, CAST(charge_period_start AS DATE) AS day,
            sum(billed_cost) AS cost FROM charges WHERE resource IS NOT NULL GROUP BY ALL)""",
    "charges",
)
# a series under 27 days has no weekly pattern: seven zeros that never change
define(
    "resource_start",
    f"""SELECT {K}, n, CASE WHEN n >= 27 THEN {PARAMS[2]}::DOUBLE ELSE 0 END AS gamma,
          CASE WHEN n >= 27 THEN first_week ELSE days[1] END AS level,
          CASE WHEN n >= 27 THEN (second_week - first_week) / 7 ELSE days[2] - days[1] END AS trend,
          list_transform(days, lambda x: CASE WHEN n >= 27 THEN x - first_week ELSE 0 END::DOUBLE) AS season
        FROM (SELECT {K}, n, avg(cost) FILTER (WHERE rn <= 7) AS first_week, avg(cost) FILTER (WHERE rn BETWEEN 8 AND 14) AS second_week,
                list(cost ORDER BY rn) FILTER (WHERE rn <= 7) AS days FROM resource_rows WHERE n >= 10 GROUP BY ALL)""",
    "resource_rows",
)
define(
    "resource_run",
    f"""SELECT {K}, n, gamma, 0::BIGINT AS rn, level::DOUBLE AS level, trend::DOUBLE AS trend, season FROM resource_start
        UNION ALL
        SELECT s.dataset_id, s.entity_type, s.entity_value, s.n, s.gamma, i.rn,
          s.level + s.trend + {PARAMS[0]}::DOUBLE * (i.cost - s.level - s.trend - s.season[1]),
          s.trend + {PARAMS[1]}::DOUBLE * (i.cost - s.level - s.trend - s.season[1]),
          list_append(s.season[2:7], s.season[1] + s.gamma * (i.cost - s.level - s.trend - s.season[1]))
        FROM resource_run s JOIN resource_rows i ON i.dataset_id = s.dataset_id AND i.entity_value = s.entity_value AND i.rn = s.rn + 1""",
    "resource_start",
    "resource_rows",
)
define(
    "resource_values",
    f"""SELECT {K}, CASE WHEN n >= 7 THEN 'moving_average' ELSE 'naive' END AS method, max(day) AS last_day,
          CASE WHEN n >= 7 THEN avg(cost) FILTER (WHERE rn > n - 7) ELSE max_by(cost, rn) END AS level, 0::DOUBLE AS trend, NULL::DOUBLE[] AS season
        FROM resource_rows WHERE n BETWEEN 5 AND 9 GROUP BY dataset_id, entity_type, entity_value, n
        UNION ALL SELECT {K}, 'exp_smoothing', last_day, level, trend, season
        FROM resource_run JOIN (SELECT {K}, max(day) AS last_day FROM resource_rows GROUP BY ALL) USING ({K}) WHERE rn = n""",
    "resource_rows",
    "resource_run",
)


@query(
    "F10 F11",
    sql(
        f"""SELECT {K}, method, step, CAST(last_day + step AS DATE) AS day, round(CASE WHEN method = 'exp_smoothing'
              THEN greatest(0, level + trend * step + season[(step - 1) % 7 + 1]) ELSE level END, 3) AS yhat
            FROM resource_values CROSS JOIN steps""",
        "resource_values",
        "steps",
    ),
)
def forecast_short_given(spark, sf_dir):
    """All resources by the method their length allows, smoothing with given weights."""
    return _points(forecast.forecast_panel(_resource_panel(spark, sf_dir), HORIZON, params=PARAMS))


@query("F10 F11")
def forecast_short_series(spark, sf_dir):
    """All resources by the method their length allows, fitted; see the tests."""
    return forecast.forecast_panel(_resource_panel(spark, sf_dir), HORIZON)


@query("F11")
def forecast_total(spark, sf_dir):
    """Total of each dataset, fitted."""
    return forecast.forecast_total(charges(spark, sf_dir, ("billed_cost", "charge_period_start")), HORIZON)


@query("F11")
def forecast_one_service(spark, sf_dir):
    billing = charges(spark, sf_dir, ("billed_cost", "service", "charge_period_start"))
    return forecast.forecast_entity(billing, "service", "Brand#7", HORIZON)
