"""Filters, totals, breakdowns, trends, drivers."""

from __future__ import annotations

from pyspark.sql import functions as F

from costlens import session, sources
from costlens.operators import filters, opportunity, panel, spend
from costlens.schema import BREAKDOWN_DIMENSIONS, SUMMARY_DIMENSIONS

from .inputs import charges, define, settled, sql
from .registry import query

SPEND = ("billed_cost", "effective_cost", "charge_period_start", "currency", *SUMMARY_DIMENSIONS)


def money(*names: str):
    """Columns rounded to cents, as they are compared."""
    return [F.round(n, 2).alias(n) for n in names]


_PERIODS = (
    ("both", "2024-01-05", "2024-01-20", False),
    ("both", "1996-03-01", "1997-02-28", False),
    ("from", "2000-06-15", None, False),
    ("until", None, "1999-12-31", False),
    ("inclusive", "2024-01-05", "2024-01-20", True),
)
# spellings that Spark casts as SQL does, for the table with month folders
_SPELT = (
    ("unpadded", "1996-3-1", "1996-11-30", False),
    ("year", "1996", "1998", False),
    ("instant", "1996-03-01 12:00:00", "1996-04-30 12:00:00", False),
    ("inclusive", None, "1996-02-29", True),
)


def _instant(text: str) -> str:
    """The same instant in full."""
    day, _, clock = text.partition(" ")
    year, month, date = (day.split("-") + ["1", "1"])[:3]
    return f"{year}-{int(month):02d}-{int(date):02d} {clock or '00:00:00'}"


def _period_sql(periods=_PERIODS) -> str:
    parts = []
    for label, start, end, inclusive in periods:
        upper = None if inclusive else end
        conditions = [
            f"charge_period_start >= TIMESTAMP '{_instant(start)}'" if start else "",
            f"charge_period_start <= TIMESTAMP '{_instant(upper)}'" if upper else "",
            f"CAST(charge_period_start AS DATE) <= DATE '{end}'" if inclusive else "",
        ]
        where = " AND ".join(c for c in conditions if c)
        parts.append(
            f"SELECT '{label} {start} {end}' AS period, dataset_id, count(*) AS row_count, "
            f"round(sum(billed_cost), 2) AS billed_cost FROM charges WHERE {where} GROUP BY ALL"
        )
    return " UNION ALL ".join(parts)


def _in_periods(billing, periods):
    parts = [
        filters.in_period(billing, start, end, end_inclusive=inclusive)
        .groupBy("dataset_id")
        .agg(F.count(F.lit(1)).alias("row_count"), F.round(F.sum("billed_cost"), 2).alias("billed_cost"))
        .select(F.lit(f"{label} {start} {end}").alias("period"), "*")
        for label, start, end, inclusive in periods
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query("P01", sql(_period_sql(), "charges"))
def period_filter(spark, sf_dir):
    return _in_periods(charges(spark, sf_dir, ("billed_cost", "charge_period_start")), _PERIODS)


@query("P01", sql(_period_sql(_PERIODS + _SPELT), "charges"))
def period_filter_stored(spark, sf_dir):
    """The same on the stored table, whose month folders are pruned, with bounds spelt in other ways."""
    path = session.scratch_table(spark, "periods")
    sources.write_canonical(charges(spark, sf_dir, ("billed_cost", "charge_period_start")), path)
    found = settled(_in_periods(sources.read_table(spark, path), _PERIODS + _SPELT))
    session.drop_table(spark, path)
    return found


@query(
    "P02",
    sql(
        """SELECT 'service' AS kind, count(*) AS row_count, round(coalesce(sum(billed_cost), 0), 2) AS billed_cost
           FROM charges WHERE CAST(service AS VARCHAR) = 'Brand#7'
           UNION ALL SELECT 'account', count(*), round(coalesce(sum(billed_cost), 0), 2) FROM charges WHERE account = '42'
           UNION ALL SELECT 'quote', count(*), round(coalesce(sum(billed_cost), 0), 2) FROM charges
             WHERE service = 'x'' OR ''1''=''1'
           UNION ALL SELECT 'total', count(*), round(coalesce(sum(billed_cost), 0), 2) FROM charges""",
        "charges",
    ),
)
def entity_filter(spark, sf_dir):
    billing = charges(spark, sf_dir, ("billed_cost", "service", "account"))
    asked = [
        ("service", "service", "Brand#7"),
        ("account", "account", "42"),
        ("quote", "service", "x' OR '1'='1"),
        ("total", "total", "all"),
    ]
    parts = [
        filters.for_entity(billing, kind, value).agg(
            F.lit(label).alias("kind"),
            F.count(F.lit(1)).alias("row_count"),
            F.round(F.coalesce(F.sum("billed_cost"), F.lit(0.0)), 2).alias("billed_cost"),
        )
        for label, kind, value in asked
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query(
    "P03",
    sql(
        """SELECT dataset_id, count(*) AS row_count, round(sum(quantity), 2) AS quantity
           FROM charges WHERE quantity IS NOT NULL AND quantity > 0 GROUP BY 1""",
        "charges",
    ),
)
def quantity_guard(spark, sf_dir):
    return (
        filters.metered(charges(spark, sf_dir, ("quantity",)))
        .groupBy("dataset_id")
        .agg(F.count(F.lit(1)).alias("row_count"), F.round(F.sum("quantity"), 2).alias("quantity"))
    )


@query(
    "P05",
    sql(
        """SELECT dataset_id, coalesce(CAST(region AS VARCHAR), 'unknown') AS region,
             coalesce(CAST(sub_account AS VARCHAR), 'unknown') AS sub_account, count(*) AS row_count
           FROM charges GROUP BY ALL""",
        "charges",
    ),
)
def null_label(spark, sf_dir):
    return (
        charges(spark, sf_dir, ("region", "sub_account"))
        .groupBy("dataset_id", filters.labelled("region"), filters.labelled("sub_account"))
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


define(
    "totals",
    """SELECT dataset_id, CAST(min(charge_period_start) AS DATE) AS period_start,
         CAST(max(charge_period_start) AS DATE) AS period_end,
         coalesce(sum(billed_cost), 0) AS total_billed_cost,
         coalesce(sum(effective_cost), 0) AS total_effective_cost
       FROM everything GROUP BY 1""",
    "everything",
)
define(
    "modal",
    """SELECT dataset_id, currency FROM (
         SELECT dataset_id, currency, row_number() OVER (PARTITION BY dataset_id ORDER BY count(*) DESC, currency) AS rn
         FROM everything WHERE currency IS NOT NULL GROUP BY 1, 2) WHERE rn = 1""",
    "everything",
)


@query(
    "A01",
    sql(
        """SELECT t.dataset_id, period_start, period_end, round(total_billed_cost, 2) AS total_billed_cost,
             round(total_effective_cost, 2) AS total_effective_cost, coalesce(currency, 'USD') AS currency
           FROM totals t LEFT JOIN modal USING (dataset_id)""",
        "totals",
        "modal",
    ),
)
def spend_totals(spark, sf_dir):
    from .source_queries import everything

    return spend.spend_totals(everything(spark, sf_dir)).select(
        "dataset_id", "period_start", "period_end", *money("total_billed_cost", "total_effective_cost"), "currency"
    )


def _by_dimension(dims=SUMMARY_DIMENSIONS, source="charges", extra=""):
    return " UNION ALL ".join(
        f"SELECT dataset_id, {extra} '{d}' AS dimension, coalesce(CAST({d} AS VARCHAR), 'unknown') AS value, "
        f"coalesce(sum(billed_cost), 0) AS cost FROM {source} GROUP BY ALL"
        for d in dims
    )


define("costs", _by_dimension(), "charges")
define(
    "ranked_costs",
    "SELECT *, row_number() OVER (PARTITION BY dataset_id, dimension ORDER BY cost DESC, value) AS rank FROM costs",
    "costs",
)


@query(
    "A02 T01",
    sql("SELECT dataset_id, dimension, value, round(cost, 2) AS cost, rank FROM ranked_costs WHERE rank <= 20", "ranked_costs"),
)
def top_breakdowns(spark, sf_dir):
    return spend.top_breakdowns(charges(spark, sf_dir, SPEND)).select(
        "dataset_id", "dimension", "value", *money("cost"), F.col("rank").cast("bigint").alias("rank")
    )


def _breakdown_sql() -> str:
    return " UNION ALL ".join(
        f"""SELECT '{d}' AS dimension, dataset_id, value, round(cost, 2) AS billed_cost,
              round(effective, 2) AS effective_cost, row_count, rank
            FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY cost DESC, value) AS rank
              FROM (SELECT dataset_id, coalesce(CAST({d} AS VARCHAR), 'unknown') AS value,
                coalesce(sum(billed_cost), 0) AS cost,
                coalesce(sum(effective_cost), sum(billed_cost)) AS effective, count(*) AS row_count
              FROM charges GROUP BY ALL)) WHERE rank <= 25"""
        for d in BREAKDOWN_DIMENSIONS
    )


@query("A03 T01", sql(_breakdown_sql(), "charges"))
def resource_breakdown(spark, sf_dir):
    result = None
    for d in BREAKDOWN_DIMENSIONS:
        billing = charges(spark, sf_dir, ("billed_cost", "effective_cost", d))
        part = spend.resource_breakdown(billing, d).select(
            F.lit(d).alias("dimension"),
            "dataset_id",
            "value",
            *money("billed_cost", "effective_cost"),
            "row_count",
            F.col("rank").cast("bigint").alias("rank"),
        )
        result = part if result is None else result.unionByName(part)
    return result


def _trend_sql(grain: str) -> str:
    return sql(
        f"""SELECT dataset_id, CAST(date_trunc('{grain}', charge_period_start) AS DATE) AS period,
              round(sum(billed_cost), 2) AS billed_cost,
              round(coalesce(sum(effective_cost), sum(billed_cost)), 2) AS effective_cost
            FROM charges GROUP BY 1, 2""",
        "charges",
    )


def _trend(spark, sf_dir, granularity):
    billing = charges(spark, sf_dir, ("billed_cost", "effective_cost", "charge_period_start"))
    return spend.spend_trend(billing, granularity).select(
        "dataset_id", "period", *money("billed_cost", "effective_cost")
    )


@query("A04 T03", _trend_sql("day"))
def spend_trend_daily(spark, sf_dir):
    return _trend(spark, sf_dir, "daily")


@query("A04", _trend_sql("week"))
def spend_trend_weekly(spark, sf_dir):
    return _trend(spark, sf_dir, "weekly")


@query("A04", _trend_sql("month"))
def spend_trend_monthly(spark, sf_dir):
    return _trend(spark, sf_dir, "monthly")


define(
    "recent_months",
    """SELECT * FROM (
         SELECT dataset_id, CAST(date_trunc('month', charge_period_start) AS DATE) AS month, sum(billed_cost) AS cost,
           row_number() OVER (PARTITION BY dataset_id ORDER BY date_trunc('month', charge_period_start) DESC) AS age
         FROM charges GROUP BY dataset_id, date_trunc('month', charge_period_start)) WHERE age <= 2""",
    "charges",
)
define(
    "mom",
    """SELECT dataset_id, max(CASE WHEN age = 1 THEN month END) AS current_month,
         max(CASE WHEN age = 2 THEN month END) AS prior_month,
         max(CASE WHEN age = 1 THEN cost END) AS current_cost, max(CASE WHEN age = 2 THEN cost END) AS prior_cost
       FROM recent_months GROUP BY 1""",
    "recent_months",
)
MOM_PCT = "CASE WHEN prior_cost > 0 THEN (current_cost - prior_cost) / prior_cost * 100 END"


@query(
    "A05 T02",
    sql(
        f"""SELECT dataset_id, current_month, prior_month, round(current_cost, 2) AS current_cost,
              round(prior_cost, 2) AS prior_cost, round({MOM_PCT}, 4) AS change_pct FROM mom""",
        "mom",
    ),
)
def month_over_month(spark, sf_dir):
    billing = charges(spark, sf_dir, ("billed_cost", "charge_period_start"))
    return spend.month_over_month(billing).select(
        "dataset_id",
        "current_month",
        "prior_month",
        *money("current_cost", "prior_cost"),
        F.round("change_pct", 4).alias("change_pct"),
    )


define("totals_clean", "SELECT dataset_id, sum(billed_cost) AS total_cost FROM charges GROUP BY 1", "charges")
define(
    "monthly_costs",
    _by_dimension(extra="CAST(date_trunc('month', charge_period_start) AS DATE) AS month,"),
    "charges",
)
define(
    "changes",
    """SELECT c.dataset_id, c.dimension, c.value,
         sum(CASE WHEN age = 1 THEN c.cost ELSE 0 END) AS current_cost,
         sum(CASE WHEN age = 2 THEN c.cost ELSE 0 END) AS prior_cost
       FROM monthly_costs c JOIN recent_months m ON c.dataset_id = m.dataset_id AND c.month = m.month
       GROUP BY ALL""",
    "monthly_costs",
    "recent_months",
)
define(
    "drivers",
    f"""SELECT r.dataset_id, r.dimension, r.value, r.cost, t.total_cost, r.cost / t.total_cost * 100 AS share_pct,
          {MOM_PCT} AS change_pct, r.rank
        FROM (SELECT dataset_id, dimension, value, cost, row_number() OVER (PARTITION BY dataset_id ORDER BY cost DESC,
                CASE dimension WHEN 'provider' THEN 1 WHEN 'account' THEN 2 WHEN 'service' THEN 3 ELSE 4 END, value) AS rank
              FROM ranked_costs WHERE rank <= 10) r
        JOIN totals_clean t USING (dataset_id)
        LEFT JOIN changes USING (dataset_id, dimension, value) WHERE r.rank <= 10""",
    "ranked_costs",
    "totals_clean",
    "changes",
)
define(
    "hhi",
    "SELECT dataset_id, sum((cost / total_cost) ** 2) AS concentration_score FROM drivers GROUP BY 1",
    "drivers",
)


@query(
    "A06 J05 T05",
    sql(
        """SELECT dataset_id, rank, dimension, value, round(cost, 2) AS cost, round(share_pct, 4) AS share_pct,
             round(change_pct, 4) AS change_pct, round(total_cost, 2) AS total_cost FROM drivers""",
        "drivers",
    ),
)
def cost_drivers(spark, sf_dir):
    return spend.cost_drivers(charges(spark, sf_dir, SPEND), with_change=True).select(
        "dataset_id",
        F.col("rank").cast("bigint").alias("rank"),
        "dimension",
        "value",
        *money("cost"),
        F.round("share_pct", 4).alias("share_pct"),
        F.round("change_pct", 4).alias("change_pct"),
        *money("total_cost"),
    )


@query("A07", sql("SELECT dataset_id, round(concentration_score, 6) AS concentration_score FROM hhi", "hhi"))
def concentration(spark, sf_dir):
    drivers = spend.cost_drivers(charges(spark, sf_dir, SPEND))
    return spend.concentration(drivers).select(
        "dataset_id", F.round("concentration_score", 6).alias("concentration_score")
    )


@query(
    "A07",
    sql(
        """SELECT dataset_id, dimension, count(*) AS value_count, round(sum((cost / total_cost) ** 2), 6) AS hhi
           FROM costs JOIN totals_clean USING (dataset_id) GROUP BY ALL""",
        "costs",
        "totals_clean",
    ),
)
def hhi_by_dimension(spark, sf_dir):
    return spend.hhi_by_dimension(charges(spark, sf_dir, SPEND)).withColumn("hhi", F.round("hhi", 6))


@query(
    "A08",
    sql(
        f"""SELECT h.dataset_id, round(d.total_cost, 2) AS total_cost,
              round(h.concentration_score, 6) AS concentration_score,
              round({MOM_PCT}, 4) AS period_over_period_change_pct, n.drivers,
              'Total spend in period: $' || format('{{:,.2f}}', d.total_cost) || ' | Top cost driver: ' || d.value || ' ('
                || d.dimension || ') at $' || format('{{:,.2f}}', d.cost) || ' | Cost concentration (HHI): '
                || printf('%.3f', h.concentration_score) AS evidence
            FROM hhi h JOIN drivers d ON d.dataset_id = h.dataset_id AND d.rank = 1
            JOIN (SELECT dataset_id, string_agg(dimension || ':' || value, ', ' ORDER BY rank) AS drivers
                  FROM drivers GROUP BY 1) n ON n.dataset_id = h.dataset_id
            LEFT JOIN mom ON mom.dataset_id = h.dataset_id""",
        "hhi",
        "drivers",
        "mom",
    ),
)
def attribution_report(spark, sf_dir):
    names = F.transform("top_drivers", lambda d: F.concat(d["dimension"], F.lit(":"), d["value"]))
    return spend.attribution_report(charges(spark, sf_dir, SPEND)).select(
        "dataset_id",
        *money("total_cost"),
        F.round("concentration_score", 6).alias("concentration_score"),
        F.round("period_over_period_change_pct", 4).alias("period_over_period_change_pct"),
        F.array_join(names, ", ").alias("drivers"),
        F.array_join("evidence", " | ").alias("evidence"),
    )


def _maps(label: str) -> str:
    return (
        f"(SELECT string_agg(value || '=' || format('{{:.2f}}', cost), ', ' ORDER BY rank) FROM ranked_costs r "
        f"WHERE r.rank <= 20 AND r.dimension = '{label}' AND r.dataset_id = t.dataset_id) AS {label}_breakdown"
    )


define(
    "totals_pair",
    """SELECT dataset_id, CAST(min(charge_period_start) AS DATE) AS period_start,
         CAST(max(charge_period_start) AS DATE) AS period_end, sum(billed_cost) AS billed, sum(effective_cost) AS effective
       FROM charges GROUP BY 1""",
    "charges",
)


@query(
    "A01 A02 A05",
    sql(
        f"""SELECT t.dataset_id, period_start, period_end, round(billed, 2) AS total_billed_cost,
              round(effective, 2) AS total_effective_cost, 'USD' AS currency, round({MOM_PCT}, 4) AS mom_change_pct,
              {', '.join(_maps(d) for d in SUMMARY_DIMENSIONS)}
            FROM totals_pair t LEFT JOIN mom USING (dataset_id)""",
        "totals_pair",
        "ranked_costs",
        "mom",
    ),
)
def spend_summary(spark, sf_dir):
    def listed(name):
        entries = F.transform(
            F.map_entries(name), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.2f", e["value"]))
        )
        return F.array_join(entries, ", ").alias(name)

    return spend.spend_summary(charges(spark, sf_dir, SPEND)).select(
        "dataset_id",
        "period_start",
        "period_end",
        *money("total_billed_cost", "total_effective_cost"),
        "currency",
        F.round("mom_change_pct", 4).alias("mom_change_pct"),
        *[listed(f"{d}_breakdown") for d in SUMMARY_DIMENSIONS],
    )


define(
    "usage",
    """SELECT dataset_id, coalesce(CAST(service AS VARCHAR), 'unknown') AS service,
         CAST(date_trunc('month', charge_period_start) AS DATE) AS month, sum(billed_cost) AS cost, sum(quantity) AS quantity
       FROM charges WHERE quantity IS NOT NULL AND quantity > 0 GROUP BY ALL""",
    "charges",
)


@query(
    "A10",
    sql("SELECT dataset_id, service, month, round(cost, 2) AS cost, round(quantity, 2) AS quantity FROM usage", "usage"),
)
def monthly_service_usage(spark, sf_dir):
    billing = charges(spark, sf_dir, ("billed_cost", "quantity", "service", "charge_period_start"))
    return opportunity.monthly_service_usage(billing).select(
        "dataset_id", "service", "month", *money("cost", "quantity")
    )


@query(
    "A11",
    sql(
        """SELECT dataset_id, 'account' AS entity_type, account AS entity_value FROM charges WHERE account IS NOT NULL GROUP BY ALL
           UNION ALL SELECT dataset_id, 'region', region FROM charges WHERE region IS NOT NULL GROUP BY ALL
           UNION ALL SELECT dataset_id, 'top_resource', resource FROM (
             SELECT dataset_id, resource, row_number() OVER (PARTITION BY dataset_id ORDER BY sum(billed_cost) DESC, resource) AS rn
             FROM charges GROUP BY dataset_id, resource) WHERE rn <= 50""",
        "charges",
    ),
)
def distinct_entities(spark, sf_dir):
    def of(kind, top=None):
        return panel.entities(charges(spark, sf_dir, ("billed_cost", kind)), kind, top)

    top = of("resource", 50).withColumn("entity_type", F.lit("top_resource"))
    return of("account").unionByName(of("region")).unionByName(top)


@query(
    "A12",
    sql(
        """SELECT dataset_id, min(charge_period_start) AS period_start, max(charge_period_start) AS period_end
           FROM charges GROUP BY 1""",
        "charges",
    ),
)
def date_range(spark, sf_dir):
    return panel.date_range(charges(spark, sf_dir, ("charge_period_start",)))
