"""Opportunity rules and what-if savings."""

from __future__ import annotations

from pyspark.sql import functions as F

from costlens import session
from costlens.operators import anomaly, opportunity, panel, scenario, spend
from costlens.operators.scenario import Scenario

from . import anomaly_queries, panel_queries, spend_queries  # noqa: F401  (SQL fragments)
from .inputs import charges, define, sql
from .panel_queries import r
from .registry import query

_MONEY = "format('{{:,.2f}}', {})"


def _priority(count: str, deviation: str, cost: str) -> str:
    return (
        f"round(least(1.0::DOUBLE, {count} / 5::DOUBLE) * 0.3::DOUBLE + least(1.0::DOUBLE, abs({deviation}) / 100) * 0.4::DOUBLE"
        f" + least(1.0::DOUBLE, {cost} / 10000) * 0.3::DOUBLE, 4)"
    )


define(
    "growth_rule",
    f"""SELECT dataset_id, 'cost_growth' AS opportunity_type, dimension || ':' || value AS entity, 6 AS lines,
          cost * least(0.3::DOUBLE, abs(change_pct) / 200) AS savings, 0.7::DOUBLE AS confidence,
          {_priority('5', 'change_pct', 'cost')} AS priority,
          value || ' (' || dimension || ') is a candidate for investigation. Billed cost changed '
            || printf('%+.1f', change_pct) || '% period-over-period ($' || {_MONEY.format('cost')} || ' current spend, '
            || printf('%.1f', share_pct) || '% of total).' AS description,
          '' AS tie
        FROM drivers WHERE abs(change_pct) >= 20""",
    "drivers",
)
define(
    "spike_rule",
    f"""SELECT dataset_id, 'cost_spike' AS opportunity_type, entity_type || ':' || entity_value AS entity, 4 AS lines,
          greatest(0.0::DOUBLE, cost - expected) AS savings, round(confidence, 3) AS confidence,
          {_priority('4', 'deviation_pct', 'cost')} AS priority,
          entity_value || ' (' || entity_type || ') had a ' || severity || ' cost spike. Billed cost was $'
            || {_MONEY.format('cost')} || ' vs expected ' AS description, day::VARCHAR AS tie
        FROM found WHERE severity IN ('high', 'critical')""",
    "found",
)
define(
    "concentration_rule",
    f"""SELECT dataset_id, 'cost_concentration' AS opportunity_type, dimension || ':' || value AS entity, 3 AS lines,
          0.0::DOUBLE AS savings, 0.6::DOUBLE AS confidence,
          {_priority('3', 'concentration_score * 100', 'total_cost')} AS priority,
          'Spend is concentrated: ' || value || ' (' || dimension || ') represents ' || printf('%.1f', share_pct)
            || '% of total spend. High concentration may indicate dependency risk or optimization opportunity.' AS description,
          '' AS tie
        FROM drivers JOIN hhi USING (dataset_id) WHERE rank = 1 AND concentration_score >= 0.6""",
    "drivers",
    "hhi",
)
define(
    "divergence_rule",
    f"""SELECT dataset_id, 'quantity_growth' AS opportunity_type, 'service:' || service AS entity, 4 AS lines,
          cost * 0.1::DOUBLE AS savings, 0.6::DOUBLE AS confidence, {_priority('4', 'cost_change', 'cost')} AS priority,
          service || ' is a candidate for investigation: billed cost increased ' || printf('%.1f', cost_change)
            || '% while billed quantity changed ' || printf('%.1f', quantity_change)
            || '%. This may indicate a pricing change, tier upgrade, or new resource usage.' AS description, '' AS tie
        FROM usage_change WHERE cost_change > 15 AND cost_change > quantity_change * 1.5""",
    "usage_change",
)
define(
    "opportunities",
    "SELECT * FROM growth_rule UNION ALL SELECT * FROM spike_rule UNION ALL SELECT * FROM concentration_rule "
    "UNION ALL SELECT * FROM divergence_rule",
    "growth_rule",
    "spike_rule",
    "concentration_rule",
    "divergence_rule",
)
define(
    "opportunity_rank",
    """SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY priority DESC,
         CASE opportunity_type WHEN 'cost_growth' THEN 1 WHEN 'cost_spike' THEN 2 WHEN 'cost_concentration' THEN 3 ELSE 4 END,
         savings DESC, entity, tie) AS rank FROM opportunities""",
    "opportunities",
)
_SHOWN = """dataset_id, opportunity_type, entity, lines::BIGINT AS lines, round(savings, 3) AS savings,
  round(confidence, 3) AS confidence, priority, description"""

USED = (
    "billed_cost",
    "effective_cost",
    "quantity",
    "charge_period_start",
    "provider",
    "account",
    "service",
    "region",
)


def shown(found, *more):
    """Columns that both engines can produce; ids are hashes of ours."""
    spike = F.col("opportunity_type") == "cost_spike"
    before_expected = F.concat(F.split_part(F.col("description"), F.lit(" vs expected "), F.lit(1)), F.lit(" vs expected "))
    return found.select(
        "dataset_id",
        "opportunity_type",
        "entity",
        F.size("evidence").cast("bigint").alias("lines"),
        F.round("potential_savings_estimate", 3).alias("savings"),
        F.round("confidence", 3).alias("confidence"),
        F.col("priority_score").alias("priority"),
        F.when(spike, before_expected).otherwise(F.col("description")).alias("description"),
        *more,
    )


@query("R02", sql(f"SELECT {_SHOWN} FROM growth_rule", "growth_rule"))
def cost_growth(spark, sf_dir):
    return shown(opportunity.cost_growth(spend.cost_drivers(charges(spark, sf_dir, USED), with_change=True)))


@query("R01 R03", sql(f"SELECT {_SHOWN} FROM spike_rule", "spike_rule"))
def cost_spike(spark, sf_dir):
    return shown(opportunity.cost_spike(anomaly.run_detection(charges(spark, sf_dir, USED))))


@query("R04", sql(f"SELECT {_SHOWN} FROM concentration_rule", "concentration_rule"))
def cost_concentration(spark, sf_dir):
    return shown(opportunity.cost_concentration(spend.cost_drivers(charges(spark, sf_dir, USED))))


@query("R05", sql(f"SELECT {_SHOWN} FROM divergence_rule", "divergence_rule"))
def quantity_growth(spark, sf_dir):
    return shown(opportunity.quantity_growth(charges(spark, sf_dir, USED)))


# A price rise in the last month, which the driver tables do not have of themselves.
_RISE, _RISE_FROM = 500, "2001-11-01"


def _risen_sql(text: str) -> str:
    """The same SQL over charges with the price rise."""
    head, _, tail = text.partition(",\ncharges AS (")
    body, _, rest = tail.partition("),\n")
    risen = f"CASE WHEN charge_period_start >= TIMESTAMP '{_RISE_FROM}' THEN billed_cost * {_RISE} ELSE billed_cost END"
    return f"{head},\nplain AS ({body}),\ncharges AS (SELECT * REPLACE ({risen} AS billed_cost) FROM plain),\n{rest}"


@query("R05", _risen_sql(sql(f"SELECT {_SHOWN} FROM divergence_rule", "divergence_rule")))
def quantity_growth_after_rise(spark, sf_dir):
    """The rule on charges whose last month became dearer while quantities did not grow with it."""
    risen = F.col("charge_period_start") >= F.lit(_RISE_FROM).cast("timestamp_ntz")
    billing = charges(spark, sf_dir, USED).withColumn(
        "billed_cost", F.when(risen, F.col("billed_cost") * _RISE).otherwise(F.col("billed_cost"))
    )
    return shown(opportunity.quantity_growth(billing))


def _kept(rows, name):
    """The rows written to the shared folder, read back, and where they lie."""
    path = session.scratch_table(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path), path


def found(spark, sf_dir):
    """All opportunities; the charges are read once, for sums of each dimension that rules and detection share."""
    rollup, path = _kept(panel.dimension_rollup(charges(spark, sf_dir, USED)), "rollup")
    rows, _ = _kept(opportunity.find_rolled(rollup), "opportunities")
    session.drop_table(spark, path)
    return rows


@query("J04 R01", sql(f"SELECT {_SHOWN} FROM opportunities", "opportunities"))
def rule_union(spark, sf_dir):
    return shown(found(spark, sf_dir))


@query(
    "R06 T06",
    sql(f"SELECT {_SHOWN}, rank FROM opportunity_rank WHERE rank <= 50", "opportunity_rank"),
)
def ranked_opportunities(spark, sf_dir):
    return shown(opportunity.ranked(found(spark, sf_dir)), F.col("rank").cast("bigint").alias("rank"))


@query(
    "A14 R06",
    sql(
        """SELECT dataset_id, count(*) AS total_opportunities, round(sum(savings), 2) AS total_potential_savings
           FROM opportunities GROUP BY 1""",
        "opportunities",
    ),
)
def opportunity_totals(spark, sf_dir):
    return opportunity.totals(found(spark, sf_dir)).select(
        "dataset_id", "total_opportunities", *r("total_potential_savings")
    )


# --- what-if ----------------------------------------------------------------

SCENARIOS = (
    Scenario("usage_reduction", 15),
    Scenario("usage_reduction"),
    Scenario("usage_reduction", 120),
    Scenario("price_change", 20, 90),
    Scenario("price_change"),
    Scenario("recommendation_implementation"),
    Scenario("recommendation_implementation", 25),
)


def _asked() -> str:
    rows = []
    for s in SCENARIOS:
        default = {"usage_reduction": 10.0, "price_change": -10.0, "recommendation_implementation": 10.0}
        rows.append(f"('{s.scenario_type}', {s.pct if s.pct is not None else default[s.scenario_type]}::DOUBLE, {s.horizon_days}::BIGINT)")
    return ", ".join(rows)


define(
    "services",
    "SELECT dataset_id, 'service:' || service AS entity, sum(billed_cost) AS current_cost FROM charges GROUP BY ALL",
    "charges",
)
define(
    "what_if",
    f"""SELECT *, CASE WHEN scenario_type = 'usage_reduction' THEN pct > 0 AND pct < 100 ELSE TRUE END AS is_valid,
          CASE scenario_type WHEN 'usage_reduction' THEN current_cost * (1 - pct / 100)
            WHEN 'price_change' THEN current_cost * (1 + pct / 100)
            ELSE current_cost - current_cost * (pct / 100) END AS projected
        FROM services CROSS JOIN (VALUES {_asked()}) AS s(scenario_type, pct, time_horizon_days)""",
    "services",
)


@query(
    "R08 R09 R10 R11",
    sql(
        """SELECT dataset_id, entity, scenario_type, pct, time_horizon_days, round(current_cost, 2) AS current_cost, is_valid,
             CASE WHEN is_valid THEN round(projected, 4) END AS projected_cost,
             CASE WHEN is_valid THEN round(current_cost - projected, 4) END AS estimated_savings,
             CASE WHEN is_valid THEN CASE scenario_type WHEN 'price_change' THEN -pct ELSE pct END END AS estimated_savings_pct,
             CASE scenario_type WHEN 'usage_reduction' THEN 0.5::DOUBLE WHEN 'price_change' THEN 0.4::DOUBLE ELSE 0.6::DOUBLE END AS confidence,
             CASE scenario_type WHEN 'usage_reduction' THEN 'Usage reduction of ' || printf('%.1f', pct) || '% for ' || entity
               WHEN 'price_change' THEN 'Provider price change of ' || printf('%+.1f', pct) || '% for ' || entity
               ELSE 'Implementing recommendation for ' || entity END AS scenario_description,
             CASE scenario_type WHEN 'usage_reduction' THEN 5 WHEN 'price_change' THEN 4 ELSE 1 END::BIGINT AS assumptions
           FROM what_if""",
        "what_if",
    ),
)
def what_if(spark, sf_dir):
    """Every scenario for the spend of every service."""
    items = (
        charges(spark, sf_dir, ("billed_cost", "service"))
        .groupBy("dataset_id", F.concat(F.lit("service:"), "service").alias("entity"))
        .agg(F.sum("billed_cost").alias("current_cost"))
    )
    return scenario.simulate(items, SCENARIOS).select(
        "dataset_id",
        "entity",
        "scenario_type",
        "pct",
        F.col("time_horizon_days").cast("bigint").alias("time_horizon_days"),
        *r("current_cost"),
        "is_valid",
        *r("projected_cost estimated_savings", 4),
        "estimated_savings_pct",
        "confidence",
        "scenario_description",
        F.size("assumptions").cast("bigint").alias("assumptions"),
    )


define("advised", "SELECT * FROM opportunity_rank WHERE rank <= 10", "opportunity_rank")
define(
    "estimates",
    """SELECT dataset_id, entity, rank, savings / greatest(0.1::DOUBLE, confidence) AS current_cost,
         least(30.0::DOUBLE, confidence * 30) AS pct, confidence * 0.8::DOUBLE AS confidence, lines
       FROM advised""",
    "advised",
)
