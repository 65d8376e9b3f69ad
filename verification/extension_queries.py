"""Extensions the reference declares."""

from __future__ import annotations

from pyspark.sql import functions as F

from costlens.operators import anomaly, budget, pricing, replay

from .anomaly_queries import _COLUMNS, _MONEY, _scored, _shown
from .forecast_queries import GIVEN, PARAMS, rolled_sql
from .inputs import charges, define, sql, table
from .panel_queries import KEYS, K, means, means_sql, r, service_panel
from .registry import query

# Budgets: one per region of the world and year, same amount for all.
_YEARS = range(1995, 2002)
_AMOUNT = 40_000_000.0


def budgets(spark, sf_dir):
    years = F.explode(F.array(*[F.lit(y) for y in _YEARS])).alias("year")
    return table(spark, sf_dir, "region").select("r_name", "r_regionkey", years).select(
        F.concat("r_name", F.lit("-"), F.col("year").cast("string")).alias("name"),
        F.lit("provider").alias("entity_type"),
        F.col("r_name").alias("entity_value"),
        F.lit("annual").alias("period_type"),
        F.make_date("year", F.lit(1), F.lit(1)).alias("period_start"),
        F.make_date("year", F.lit(12), F.lit(31)).alias("period_end"),
        ((F.col("r_regionkey") + 1) * _AMOUNT).alias("budget_amount"),
        F.lit("USD").alias("currency"),
    )


define(
    "budgets",
    f"""SELECT r_name || '-' || y AS name, 'provider' AS entity_type, r_name AS entity_value, 'annual' AS period_type,
          make_date(y, 1, 1) AS period_start, make_date(y, 12, 31) AS period_end,
          (r_regionkey + 1)::DOUBLE * {_AMOUNT} AS budget_amount, 'USD' AS currency
        FROM region CROSS JOIN (SELECT CAST(range AS INTEGER) AS y FROM range({_YEARS.start}, {_YEARS.stop}))""",
)
define(
    "variance",
    """SELECT dataset_id, name, period_start, period_end, budget_amount, coalesce(sum(billed_cost), 0) AS actual_spend
       FROM budgets LEFT JOIN charges ON provider = entity_value
         AND CAST(charge_period_start AS DATE) BETWEEN period_start AND period_end GROUP BY ALL""",
    "budgets",
    "charges",
)
_STATUS = "CASE WHEN actual_spend / {b} > 1 THEN 'over_budget' WHEN actual_spend / {b} >= 0.8 THEN 'at_risk' ELSE 'on_track' END"
_VARIANCE = f"""SELECT dataset_id, name, round(actual_spend, 2) AS actual_spend,
  round(actual_spend - budget_amount, 2) AS variance,
  round((actual_spend - budget_amount) / budget_amount * 100, 4) AS variance_pct,
  {_STATUS.format(b='budget_amount')} AS status FROM variance"""


def _variance(spark, sf_dir):
    billing = charges(spark, sf_dir, ("billed_cost", "provider", "charge_period_start", "currency"))
    return budget.budget_variance(billing, budgets(spark, sf_dir), ("provider",))


@query("E01", sql(_VARIANCE, "variance"))
def budget_variance(spark, sf_dir):
    return _variance(spark, sf_dir).select(
        "dataset_id", "name", *r("actual_spend variance"), *r("variance_pct", 4), "status"
    )


@query(
    "E06",
    sql(
        f"""SELECT dataset_id, name, round(budget_amount * 0.9::DOUBLE, 2) AS reduced_budget,
              round(greatest(0, actual_spend - budget_amount * 0.9::DOUBLE), 2) AS required_savings,
              {_STATUS.format(b='(budget_amount * 0.9::DOUBLE)')} AS reduced_status FROM variance""",
        "variance",
    ),
)
def budget_reduction(spark, sf_dir):
    return budget.budget_reduction(_variance(spark, sf_dir), 10).select(
        "dataset_id", "name", *r("reduced_budget required_savings"), "reduced_status"
    )


define(
    "weekday_medians",
    f"""SELECT *, stddev_samp(cost - base) OVER (PARTITION BY {K}) AS s
        FROM (SELECT *, median(cost) OVER (PARTITION BY {K}, isodow(day)) AS base FROM numbered)""",
    "numbered",
)
define(
    "found_seasonal",
    _scored(
        "weekday_medians",
        "base",
        "(cost - base) / nullif(s, 0)",
        3.0,
        "seasonal",
        f"'Actual: $' || {_MONEY.format('cost')} || ' | Expected: ' || ' | Deviation: ' || printf('%+.1f', deviation_pct) "
        "|| '% | Z-score: ' || printf('%.2f', z) || ' | Detection method: seasonal'",
        "expected <> 0",
    ),
    "weekday_medians",
)


@query("E02", sql(f"SELECT {_COLUMNS} FROM found_seasonal", "found_seasonal"))
def seasonal_baseline(spark, sf_dir):
    return _shown(anomaly.seasonal_baseline(service_panel(spark, sf_dir)))


_BEFORE, _AFTER = ("1999-01-01", "1999-12-31"), ("2000-01-01", "2000-12-31")
_DIMS = ("provider", "account", "service", "region")


def _contributors() -> str:
    def side(bounds, column):
        return (
            f"sum(CASE WHEN CAST(charge_period_start AS DATE) BETWEEN DATE '{bounds[0]}' AND DATE '{bounds[1]}' "
            f"THEN {column} ELSE 0 END)"
        )

    return " UNION ALL ".join(
        f"""SELECT dataset_id, '{d}' AS dimension, coalesce({d}, 'unknown') AS value,
              {side(_BEFORE, 'billed_cost')} AS c0, {side(_AFTER, 'billed_cost')} AS c1,
              {side(_BEFORE, 'quantity')} AS q0, {side(_AFTER, 'quantity')} AS q1
            FROM charges WHERE CAST(charge_period_start AS DATE) BETWEEN DATE '{_BEFORE[0]}' AND DATE '{_AFTER[1]}' GROUP BY ALL"""
        for d in _DIMS
    )


define("moved", _contributors(), "charges")
define(
    "moved_ranked",
    """SELECT *, c1 - c0 AS delta, sum(c1 - c0) OVER (PARTITION BY dataset_id, dimension) AS total_delta,
         row_number() OVER (PARTITION BY dataset_id, dimension ORDER BY abs(c1 - c0) DESC, value) AS rank FROM moved""",
    "moved",
)


@query(
    "E03",
    sql(
        """SELECT dataset_id, dimension, value, rank, round(delta, 2) AS delta, round(delta / total_delta, 6) AS share_of_change,
             round((q1 - q0) * c0 / q0, 3) AS volume_effect, round((c1 / q1 - c0 / q0) * q1, 3) AS price_effect
           FROM moved_ranked WHERE rank <= 10""",
        "moved_ranked",
    ),
)
def change_contributors(spark, sf_dir):
    columns = ("billed_cost", "quantity", "charge_period_start", *_DIMS)
    found = pricing.change_contributors(charges(spark, sf_dir, columns), _BEFORE, _AFTER, _DIMS)
    return found.select(
        "dataset_id",
        "dimension",
        "value",
        F.col("rank").cast("bigint").alias("rank"),
        *r("delta"),
        *r("share_of_change", 6),
        *r("volume_effect price_effect", 3),
    )


@query(
    "E04",
    sql(
        """SELECT dataset_id, service AS value, round(sum(effective_cost), 2) AS effective_cost,
             round(sum(list_cost), 2) AS list_cost, round(1 - sum(effective_cost) / sum(list_cost), 6) AS discount_rate
           FROM charges GROUP BY ALL""",
        "charges",
    ),
)
def discount_rate(spark, sf_dir):
    billing = charges(spark, sf_dir, ("effective_cost", "list_cost", "service"))
    return pricing.discount_rate(billing, "service").select(
        "dataset_id", "value", *r("effective_cost list_cost"), *r("discount_rate", 6)
    )


define(
    "on_demand",
    """SELECT dataset_id, service, sum(od) AS on_demand_cost, sum(od) / sum(cost) AS on_demand_share,
         stddev_samp(od) / avg(od) AS variation
       FROM (SELECT dataset_id, service, CAST(charge_period_start AS DATE) AS day, sum(billed_cost) AS cost,
               sum(CASE WHEN pricing_category = 'On-Demand' THEN billed_cost ELSE 0 END) AS od
             FROM charges GROUP BY ALL) GROUP BY ALL""",
    "charges",
)


@query(
    "E05",
    sql(
        """SELECT dataset_id, service, round(on_demand_cost, 2) AS on_demand_cost, round(on_demand_share, 6) AS on_demand_share,
             round(variation, 6) AS variation, on_demand_share >= 0.5 AND variation <= 0.5 AS is_candidate FROM on_demand""",
        "on_demand",
    ),
)
def commitment_candidates(spark, sf_dir):
    columns = ("billed_cost", "service", "pricing_category", "charge_period_start")
    return pricing.commitment_candidates(charges(spark, sf_dir, columns)).select(
        "dataset_id", "service", *r("on_demand_cost"), *r("on_demand_share variation", 6), "is_candidate"
    )


define(
    "prices",
    """SELECT *, min(price) OVER (PARTITION BY dataset_id, sku) AS lowest FROM (
         SELECT dataset_id, sku, region, sum(billed_cost) AS cost, sum(quantity) AS quantity,
           sum(billed_cost) / sum(quantity) AS price
         FROM charges WHERE quantity > 0 AND region IS NOT NULL GROUP BY ALL)""",
    "charges",
)


@query(
    "E05",
    sql(
        """SELECT dataset_id, sku, region, round(price, 4) AS unit_price, round((price / lowest - 1) * 100, 4) AS gap_pct,
             round(cost - lowest * quantity, 2) AS potential_savings, (price / lowest - 1) * 100 >= 5 AS is_candidate
           FROM prices""",
        "prices",
    ),
)
def regional_price_gaps(spark, sf_dir):
    columns = ("billed_cost", "quantity", "sku", "region")
    return pricing.regional_price_gaps(charges(spark, sf_dir, columns), 5.0).select(
        "dataset_id", "sku", "region", *r("unit_price gap_pct", 4), *r("potential_savings"), "is_candidate"
    )


@query(
    "E05",
    sql(
        """SELECT dataset_id, resource, round(sum(billed_cost), 2) AS cost, count(*) AS row_count FROM charges
           GROUP BY ALL HAVING sum(billed_cost) > 0 AND coalesce(sum(quantity), 0) = 0""",
        "charges",
    ),
)
def idle_candidates(spark, sf_dir):
    columns = ("billed_cost", "quantity", "resource")
    return pricing.idle_candidates(charges(spark, sf_dir, columns)).select(
        "dataset_id", "resource", *r("cost"), "row_count"
    )


_ORIGINS = ("1998-06-30", "2000-12-31", "2024-01-20")
define(
    "origins",
    " UNION ALL ".join(f"SELECT DATE '{o}' AS origin" for o in _ORIGINS),
)
define(
    "origin_tail",
    f"""SELECT {K}, origin, day, cost, row_number() OVER (PARTITION BY {K}, origin ORDER BY day DESC) AS age,
          count(*) OVER (PARTITION BY {K}, origin) AS n
        FROM panel JOIN origins ON day <= origin""",
    "panel",
    "origins",
)
define(
    "origin_points",
    f"""SELECT {K}, origin, max(day) AS last_day, 'naive' AS method, max(CASE WHEN age = 1 THEN cost END) AS yhat
        FROM origin_tail GROUP BY ALL
        UNION ALL SELECT {K}, origin, max(day), 'moving_average', avg(cost) FROM origin_tail WHERE age <= 7 AND n >= 7 GROUP BY {K}, origin""",
    "origin_tail",
)


@query(
    "E07",
    sql(
        f"""SELECT o.dataset_id, o.entity_type, o.entity_value, CAST(origin AS VARCHAR) AS origin, method, count(*) AS scored_days,
              round(sum(abs(yhat - cost)) / sum(abs(cost)), 6) AS wape,
              {means_sql(mae='avg(abs(yhat - cost))', bias='avg(yhat - cost)')}
            FROM origin_points o JOIN panel p ON p.dataset_id = o.dataset_id AND p.entity_value = o.entity_value
              AND p.day > last_day AND p.day <= last_day + 30 GROUP BY ALL""",
        "origin_points",
        "panel",
    ),
)
def rolling_origin_backtest(spark, sf_dir):
    found = replay.backtest(service_panel(spark, sf_dir), _ORIGINS, methods=("naive", "moving_average"))
    return found.select(*KEYS, "origin", "method", "scored_days", *means("mae bias"), *r("wape", 6))


define(
    "origin_counts",
    f"SELECT {K}, origin, any_value(n) AS k, max(day) AS last_day FROM origin_tail GROUP BY {K}, origin",
    "origin_tail",
)
define(
    "origin_start",
    f"""SELECT {K}, origin, max(day) AS last_day, list(cost ORDER BY day) AS past FROM origin_tail WHERE age <= 29 AND n >= 29
        GROUP BY {K}, origin""",
    "origin_tail",
)
define("origin_run", rolled_sql("origin_run", "origin_start", f"{K}, origin"), "origin_start")
# up to 26 known days: no weekly pattern, and a start from the first two days
define(
    "plain_run",
    f"""SELECT {K}, 0::BIGINT AS rn, min_by(cost, rn)::DOUBLE AS level,
          (max(cost) FILTER (WHERE rn = 2) - max(cost) FILTER (WHERE rn = 1))::DOUBLE AS trend FROM numbered GROUP BY {K}
        UNION ALL
        SELECT s.dataset_id, s.entity_type, s.entity_value, i.rn, s.level + s.trend + {PARAMS[0]}::DOUBLE * (i.cost - s.level - s.trend),
          s.trend + {PARAMS[1]}::DOUBLE * (i.cost - s.level - s.trend)
        FROM plain_run s JOIN numbered i ON i.dataset_id = s.dataset_id AND i.entity_value = s.entity_value AND i.rn = s.rn + 1
        WHERE i.rn <= 26""",
    "numbered",
)
define(
    "origin_forecasts",
    f"""SELECT {K}, origin, method, last_day + step AS day, yhat FROM origin_points CROSS JOIN steps
        UNION ALL SELECT {K}, origin, 'boosted_trees', last_day + step, yhat FROM origin_run WHERE step > 0
        UNION ALL SELECT {K}, origin, 'exp_smoothing', last_day + step, greatest(0, level + trend * step + season[(step - 1) % 7 + 1])
          FROM origin_counts JOIN (SELECT {K}, rn AS k, level, trend, season FROM smoothing_run WHERE part = 'forecast') USING ({K}, k)
          CROSS JOIN steps WHERE k >= 27
        UNION ALL SELECT {K}, origin, 'exp_smoothing', last_day + step, greatest(0, level + trend * step)
          FROM origin_counts JOIN (SELECT {K}, rn AS k, level, trend FROM plain_run) USING ({K}, k) CROSS JOIN steps WHERE k BETWEEN 10 AND 26""",
    "origin_points",
    "origin_run",
    "origin_counts",
    "smoothing_run",
    "plain_run",
    "steps",
)


@query(
    "E07",
    sql(
        f"""SELECT o.dataset_id, o.entity_type, o.entity_value, CAST(origin AS VARCHAR) AS origin, method, count(*) AS scored_days,
              round(sum(abs(yhat - cost)) / sum(abs(cost)), 6) AS wape,
              {means_sql(mae='avg(abs(yhat - cost))', bias='avg(yhat - cost)')}
            FROM origin_forecasts o JOIN panel p ON p.dataset_id = o.dataset_id AND p.entity_value = o.entity_value AND p.day = o.day
            GROUP BY ALL""",
        "origin_forecasts",
        "panel",
    ),
)
def backtest_every_method(spark, sf_dir):
    """All four methods at three origins, with given smoothing weights and a given tree model."""
    found = replay.backtest(service_panel(spark, sf_dir), _ORIGINS, params=PARAMS, model=GIVEN)
    return found.select(*KEYS, "origin", "method", "scored_days", *means("mae bias"), *r("wape", 6))


@query(
    "E07",
    sql(
        """SELECT dataset_id, count(*) AS row_count, round(sum(billed_cost), 2) AS billed_cost FROM charges
           WHERE charge_period_start <= TIMESTAMP '2000-03-15 00:00:00' GROUP BY 1""",
        "charges",
    ),
)
def known_at(spark, sf_dir):
    billing = charges(spark, sf_dir, ("billed_cost", "charge_period_start"))
    return (
        replay.as_of(billing, "2000-03-15")
        .groupBy("dataset_id")
        .agg(F.count(F.lit(1)).alias("row_count"), F.round(F.sum("billed_cost"), 2).alias("billed_cost"))
    )


def _is_spike():
    return (F.dayofmonth("day") == 15) & F.month("day").isin(1, 4, 9)


define(
    "spiked",
    f"""SELECT {K}, day, CASE WHEN is_spike THEN cost * 6 ELSE cost END AS cost, is_spike
        FROM (SELECT *, dayofmonth(day) = 15 AND month(day) IN (1, 4, 9) AS is_spike FROM panel)""",
    "panel",
)
define(
    "spiked_found",
    f"""SELECT {K}, day FROM (SELECT *, median(abs(cost - median)) OVER (PARTITION BY {K}) AS mad
          FROM (SELECT *, median(cost) OVER (PARTITION BY {K}) AS median FROM spiked))
        WHERE abs(0.6745::DOUBLE * (cost - median) / mad) >= 3.5""",
    "spiked",
)
define("labelled", f"SELECT {K}, day FROM spiked WHERE is_spike", "spiked")


@query(
    "E08",
    sql(
        f"""SELECT l.dataset_id, labelled, found_labels, mean_delay_days, detected, true_detections,
              round(true_detections / detected, 6) AS precision, round(found_labels / labelled, 6) AS recall
            FROM (SELECT dataset_id, count(*) AS labelled, count(delay) AS found_labels, avg(delay) AS mean_delay_days
                  FROM (SELECT l.dataset_id, l.entity_value, l.day, min(f.day - l.day) AS delay FROM labelled l
                        LEFT JOIN spiked_found f ON f.dataset_id = l.dataset_id AND f.entity_value = l.entity_value
                          AND f.day BETWEEN l.day AND l.day + 2 GROUP BY ALL) GROUP BY 1) l
            FULL JOIN (SELECT dataset_id, count(*) AS detected, count(*) FILTER (WHERE EXISTS (
                    SELECT 1 FROM labelled l WHERE f.dataset_id = l.dataset_id AND f.entity_value = l.entity_value
                      AND f.day BETWEEN l.day AND l.day + 2)) AS true_detections
                  FROM spiked_found f GROUP BY 1) d USING (dataset_id)""",
        "labelled",
        "spiked_found",
    ),
)
def detector_evaluation(spark, sf_dir):
    """Robust detections against spikes planted in every series."""
    rows = service_panel(spark, sf_dir)
    spiked = rows.withColumn("cost", F.when(_is_spike(), F.col("cost") * 6).otherwise(F.col("cost")))
    found = replay.evaluate_detections(anomaly.robust_zscore(spiked), rows.where(_is_spike()), tolerance=2)
    return found.select(
        "dataset_id",
        "labelled",
        "found_labels",
        "mean_delay_days",
        "detected",
        "true_detections",
        *r("precision recall", 6),
    )
