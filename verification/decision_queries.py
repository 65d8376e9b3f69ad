"""Recommendations, savings, critic, decision, whole run."""

from __future__ import annotations

from pyspark.sql import functions as F

from costlens.operators import decision, opportunity, quality, scenario
from costlens.plans import decision_run
from costlens.plans.decision_run import stage_evidence, stage_summary

from . import opportunity_queries as opp
from . import quality_queries, source_queries  # noqa: F401  (SQL fragments)
from .inputs import define, settled, sql
from .panel_queries import r
from .registry import ORACLES, query
from .source_queries import everything


def _advised(spark, sf_dir):
    top = opportunity.ranked(opp.found(spark, sf_dir))
    return decision.recommend(top), top


_TITLE = "'Investigate ' || entity || ' (' || opportunity_type || ')'"


@query(
    "R07 T07 W12",
    sql(
        f"""SELECT dataset_id, {_TITLE} AS title, rank AS priority_rank, 'low' AS risk_level, 'pending' AS status,
              lines::BIGINT AS lines, 'investigate' AS action_type,
              'Investigate ' || entity || ': review current usage patterns, identify root cause of cost change, '
                || 'assess optimization options.' AS action, 2::BIGINT AS assumptions FROM advised""",
        "advised",
    ),
)
def recommendations(spark, sf_dir):
    advised, _ = _advised(spark, sf_dir)
    action = F.col("actions")[0]
    return advised.select(
        "dataset_id",
        "title",
        F.col("priority_rank").cast("bigint").alias("priority_rank"),
        "risk_level",
        "status",
        F.size("evidence").cast("bigint").alias("lines"),
        action["action_type"].alias("action_type"),
        action["description"].alias("action"),
        F.size(action["assumptions"]).cast("bigint").alias("assumptions"),
    )


_ESTIMATE = """dataset_id, entity, rank AS priority_rank, round(current_cost, 2) AS current_cost,
  round(current_cost - current_cost * (pct / 100), 2) AS projected_cost,
  round(current_cost * (pct / 100), 2) AS estimated_savings, round(pct, 4) AS estimated_savings_pct,
  round(confidence, 6) AS confidence, (lines + 1)::BIGINT AS assumptions"""


@query("J01 R12", sql(f"SELECT {_ESTIMATE} FROM estimates", "estimates"))
def implementation_savings(spark, sf_dir):
    advised, top = _advised(spark, sf_dir)
    return scenario.implementation_savings(advised, top).select(
        "dataset_id",
        "entity",
        F.col("priority_rank").cast("bigint").alias("priority_rank"),
        *r("current_cost projected_cost estimated_savings"),
        *r("estimated_savings_pct", 4),
        *r("confidence", 6),
        F.size("assumptions").cast("bigint").alias("assumptions"),
    )


@query(
    "J01",
    sql(
        """SELECT a.dataset_id, a.rank AS priority_rank, o.entity, o.opportunity_type, round(o.savings, 2) AS savings
           FROM advised a JOIN opportunity_rank o ON o.dataset_id = a.dataset_id AND o.rank = a.rank""",
        "advised",
        "opportunity_rank",
    ),
)
def recommendation_lookup(spark, sf_dir):
    """Each recommendation with the opportunity it came from."""
    advised, top = _advised(spark, sf_dir)
    facts = top.select("opportunity_id", "entity", "opportunity_type", "potential_savings_estimate")
    return advised.join(facts, "opportunity_id").select(
        "dataset_id",
        F.col("priority_rank").cast("bigint").alias("priority_rank"),
        "entity",
        "opportunity_type",
        F.round("potential_savings_estimate", 2).alias("savings"),
    )


@query(
    "A15",
    sql(
        """SELECT dataset_id, count(*) AS savings_count, round(sum(current_cost * (pct / 100)), 2) AS total_estimated_savings
           FROM estimates GROUP BY 1""",
        "estimates",
    ),
)
def savings_total(spark, sf_dir):
    advised, top = _advised(spark, sf_dir)
    return scenario.total_savings(scenario.implementation_savings(advised, top)).select(
        "dataset_id", "savings_count", *r("total_estimated_savings")
    )


@query(
    "R13",
    sql(
        """SELECT dataset_id, overall_status, overall_status <> 'FAIL' AS usable,
             CASE overall_status WHEN 'PASS' THEN 0.95::DOUBLE WHEN 'WARN' THEN 0.6::DOUBLE ELSE 0.1::DOUBLE END AS confidence,
             CASE WHEN overall_status <> 'FAIL' THEN total_rows ELSE 0 END AS rows_passed_on
           FROM quality""",
        "quality",
    ),
)
def quality_gate(spark, sf_dir):
    billing = everything(spark, sf_dir)
    gate = decision.quality_gate(quality.quality_report(billing))
    passed = decision.usable_only(billing, gate).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))
    return gate.join(passed, "dataset_id", "left").select(
        "dataset_id",
        "overall_status",
        "usable",
        "confidence",
        F.coalesce("n", F.lit(0).cast("bigint")).alias("rows_passed_on"),
    )


# A few recommendations are damaged on purpose, so that every kind of check fires.
define(
    "damaged",
    """SELECT *, rank % 4 <> 1 AS has_evidence, rank % 3 <> 2 AS has_assumptions, rank % 5 = 3 AS is_destructive FROM advised""",
    "advised",
)
define(
    "checked",
    f"""SELECT DISTINCT dataset_id, 1 AS stage, 0 AS rank, 'passed' AS outcome, 'Data quality gate: PASSED' AS message FROM damaged
        UNION ALL SELECT dataset_id, 2, rank, CASE WHEN has_evidence THEN 'passed' ELSE 'missing_evidence' END,
          CASE WHEN has_evidence THEN 'Evidence present for: ' || substring({_TITLE}, 1, 50)
            ELSE 'Recommendation ''' || {_TITLE} || ''' has no supporting evidence' END FROM damaged
        UNION ALL SELECT dataset_id, 3, rank, CASE WHEN has_assumptions THEN 'passed' ELSE 'missing_evidence' END,
          CASE WHEN has_assumptions THEN 'Assumptions disclosed for action: investigate' ELSE 'No assumptions for action: investigate' END
          FROM damaged
        UNION ALL SELECT dataset_id, 4, rank, CASE WHEN is_destructive THEN 'failed' ELSE 'passed' END,
          CASE WHEN is_destructive THEN 'Recommendation contains potentially destructive action: Shutdown ' || entity
            ELSE 'Safety check: no destructive action in ''investigate''' END FROM damaged
        UNION ALL SELECT DISTINCT dataset_id, 5, 0, 'passed', 'Savings clearly labelled as ESTIMATED (not realized)' FROM damaged""",
    "damaged",
)


def _damaged(spark, sf_dir):
    advised, top = _advised(spark, sf_dir)
    rank = F.col("priority_rank")
    action = F.col("actions")[0]
    worse = action.withField(
        "assumptions", F.when(rank % 3 != 2, action["assumptions"]).otherwise(F.array().cast("array<string>"))
    ).withField(
        "description",
        F.when(rank % 5 == 3, F.concat(F.lit("Shutdown "), F.col("entity"))).otherwise(action["description"]),
    )
    damaged = advised.join(top.select("opportunity_id", "entity"), "opportunity_id").select(
        "dataset_id",
        "recommendation_id",
        "opportunity_id",
        "title",
        "priority_rank",
        F.array(worse).alias("actions"),
        F.when(rank % 4 != 1, F.col("evidence")).otherwise(F.array().cast("array<string>")).alias("evidence"),
    )
    gate = damaged.select("dataset_id").distinct().withColumn("usable", F.lit(True))
    return decision.checks(gate, damaged)


@query(
    "R14",
    sql("SELECT dataset_id, stage, rank::BIGINT AS priority_rank, outcome, message FROM checked", "checked"),
)
def critic_checks(spark, sf_dir):
    return _damaged(spark, sf_dir).select(
        "dataset_id", "stage", F.col("priority_rank").cast("bigint").alias("priority_rank"), "outcome", "message"
    )


_VERDICT = """SELECT c.dataset_id, count(*) FILTER (WHERE outcome = 'passed') AS checks_passed,
    count(*) FILTER (WHERE outcome = 'failed') AS checks_failed,
    count(*) FILTER (WHERE outcome = 'missing_evidence') AS missing_evidence,
    list(message ORDER BY stage, rank) FILTER (WHERE outcome = 'passed') AS passed,
    list(message ORDER BY stage, rank) FILTER (WHERE outcome = 'failed') AS failed
  FROM {} c GROUP BY 1"""
define("verdict", _VERDICT.format("checked"), "checked")
_TRUST = "greatest(0.3::DOUBLE, 1 - checks_failed * 0.2::DOUBLE - missing_evidence * 0.1::DOUBLE)"


def _decision_columns(count: str) -> str:
    return f"""CASE WHEN checks_failed > 0 THEN 'REJECT' WHEN {count} > 0 THEN 'APPROVE' ELSE 'INVESTIGATE' END AS decision,
      round({_TRUST}, 3) AS confidence,
      CASE WHEN checks_failed > 0 THEN 'Critic rejected: ' || array_to_string(failed[1:3], '; ')
        WHEN {count} > 0 THEN {count} || ' recommendations passed critic validation with confidence ' || printf('%.2f', {_TRUST})
        ELSE 'No actionable recommendations found. Further investigation recommended.' END AS rationale,
      array_to_string(passed[1:5], ' | ') || CASE WHEN checks_failed > 0
        THEN ' | WARNINGS: ' || array_to_string(failed[1:2], '; ') ELSE '' END AS evidence_summary"""


def _decided(rows):
    return rows.select(
        "dataset_id",
        "checks_passed",
        "checks_failed",
        "missing_evidence",
        "recommendation_count",
        "decision",
        "confidence",
        "rationale",
        F.array_join("evidence_summary", " | ").alias("evidence_summary"),
    )


@query(
    "R15 R16",
    sql(
        f"""SELECT dataset_id, checks_passed, checks_failed, missing_evidence, n AS recommendation_count, {_decision_columns('n')}
            FROM verdict JOIN (SELECT dataset_id, count(*) AS n FROM damaged GROUP BY 1) USING (dataset_id)""",
        "verdict",
        "damaged",
    ),
)
def critic_decision(spark, sf_dir):
    return _decided(decision.decide(_damaged(spark, sf_dir)))


define(
    "run_checks",
    f"""SELECT dataset_id, 1 AS stage, 0 AS rank, 'passed' AS outcome, 'Data quality gate: PASSED' AS message
          FROM quality WHERE overall_status <> 'FAIL'
        UNION ALL SELECT dataset_id, 2, rank, 'passed', 'Evidence present for: ' || substring({_TITLE}, 1, 50) FROM advised
        UNION ALL SELECT dataset_id, 3, rank, 'passed', 'Assumptions disclosed for action: investigate' FROM advised
        UNION ALL SELECT dataset_id, 4, rank, 'passed', 'Safety check: no destructive action in ''investigate''' FROM advised
        UNION ALL SELECT dataset_id, 5, 0, 'passed', 'Savings clearly labelled as ESTIMATED (not realized)'
          FROM quality WHERE overall_status <> 'FAIL'""",
    "quality",
    "advised",
)
define("run_verdict", _VERDICT.format("run_checks"), "run_checks")
define("advised_count", "SELECT dataset_id, count(*) AS n FROM advised GROUP BY 1", "advised")
define(
    "saved",
    "SELECT dataset_id, count(*) AS savings_count, sum(current_cost * (pct / 100)) AS total_estimated_savings FROM estimates GROUP BY 1",
    "estimates",
)


@query(
    "R17",
    sql(
        f"""SELECT q.dataset_id, overall_status, CASE WHEN overall_status = 'FAIL' THEN 'failed' ELSE 'succeeded' END AS run_status,
              checks_passed, checks_failed, missing_evidence,
              CASE WHEN overall_status <> 'FAIL' THEN coalesce(n, 0) END AS recommendation_count,
              CASE WHEN overall_status <> 'FAIL' THEN savings_count END AS savings_count,
              CASE WHEN overall_status <> 'FAIL' THEN round(total_estimated_savings, 2) END AS total_estimated_savings,
              d.decision, d.confidence, d.rationale, d.evidence_summary
            FROM quality q LEFT JOIN run_verdict v USING (dataset_id) LEFT JOIN advised_count a USING (dataset_id)
            LEFT JOIN saved s USING (dataset_id)
            LEFT JOIN (SELECT dataset_id, {_decision_columns('coalesce(n, 0)')} FROM run_verdict
                       LEFT JOIN advised_count USING (dataset_id)) d USING (dataset_id)""",
        "quality",
        "run_verdict",
        "advised_count",
        "saved",
    ),
)
def decision_run_result(spark, sf_dir):
    """The whole run over three datasets, one of which fails the gate."""
    return _run_result(everything(spark, sf_dir))


def _run_result(billing):
    with decision_run(billing) as run:
        decisions = settled(run.decisions)
    return decisions.select(
        "dataset_id",
        "overall_status",
        "run_status",
        "checks_passed",
        "checks_failed",
        "missing_evidence",
        "recommendation_count",
        "savings_count",
        *r("total_estimated_savings"),
        "decision",
        "confidence",
        "rationale",
        F.array_join("evidence_summary", " | ").alias("evidence_summary"),
    )


@query("R17 R05", ORACLES["decision_run_result"])
def decision_run_without_quantity(spark, sf_dir):
    """The whole run on files that lack the optional quantity; its rule finds nothing in these tables either way."""
    return _run_result(everything(spark, sf_dir).drop("quantity"))


def _summary_sql() -> str:
    def rows(stage: int, name: str, source: str, confidence: str, metrics: dict[str, str]) -> str:
        return " UNION ALL ".join(
            f"SELECT dataset_id, {stage} AS stage_order, '{name}' AS stage, {confidence}::DOUBLE AS confidence, "
            f"'{metric}' AS metric, round(({value})::DOUBLE, 3) AS value FROM {source}"
            for metric, value in metrics.items()
        )

    usable = "(SELECT * FROM quality WHERE overall_status <> 'FAIL')"
    parts = [
        rows(
            1,
            "data_quality",
            "quality",
            "CASE overall_status WHEN 'PASS' THEN 0.95 WHEN 'WARN' THEN 0.6 ELSE 0.1 END",
            {
                "usable": "(overall_status <> 'FAIL')::INT",
                "total_rows": "total_rows",
                "valid_rows": "valid_rows",
                "duplicate_rows": "duplicate_rows",
                "issues": "issues",
                "warnings": "warnings",
            },
        ),
        rows(
            2,
            "cost_attribution",
            "(SELECT dataset_id, any_value(total_cost) AS total_cost, count(*) AS n FROM drivers GROUP BY 1) "
            "LEFT JOIN mom USING (dataset_id)",
            "0.9",
            {
                "total_cost": "total_cost",
                "driver_count": "n",
                "pop_change_pct": "CASE WHEN prior_cost > 0 THEN (current_cost - prior_cost) / prior_cost * 100 END",
            },
        ),
        rows(
            3,
            "anomaly_investigation",
            f"{usable} q LEFT JOIN anomaly_counts USING (dataset_id)",
            "CASE WHEN coalesce(critical_count, 0) + coalesce(high_count, 0) > 0 THEN 0.8 ELSE 0.9 END",
            {c: f"coalesce({c}, 0)" for c in ("total_anomalies", "critical_count", "high_count")},
        ),
        rows(
            4,
            "opportunity",
            f"{usable} q LEFT JOIN (SELECT dataset_id, count(*) AS n, sum(savings) AS s FROM opportunities GROUP BY 1) USING (dataset_id)",
            "0.75",
            {"total_opportunities": "coalesce(n, 0)", "estimated_savings": "coalesce(s, 0)"},
        ),
        rows(
            5,
            "optimization",
            f"{usable} q LEFT JOIN advised_count USING (dataset_id)",
            "0.75",
            {"recommendation_count": "coalesce(n, 0)"},
        ),
        rows(
            6,
            "savings",
            f"{usable} q LEFT JOIN saved USING (dataset_id)",
            "0.6",
            {
                "savings_count": "coalesce(savings_count, 0)",
                "total_estimated_savings": "coalesce(total_estimated_savings, 0)",
            },
        ),
        rows(
            7,
            "critic",
            "run_verdict",
            f"round({_TRUST}, 3)",
            {c: c for c in ("checks_passed", "checks_failed", "missing_evidence")},
        ),
    ]
    return " UNION ALL ".join(parts)


@query(
    "R18",
    sql(
        _summary_sql(),
        "quality",
        "drivers",
        "mom",
        "anomaly_counts",
        "opportunities",
        "advised_count",
        "saved",
        "run_verdict",
    ),
)
def run_stage_summary(spark, sf_dir):
    with decision_run(everything(spark, sf_dir)) as run:
        return settled(stage_summary(run).withColumn("value", F.round("value", 3)))


@query(
    "R18 R16",
    sql(
        """SELECT dataset_id, 'cost_attribution' AS stage, rank, dimension || ':' || value AS item, round(cost, 2) AS value
             FROM drivers WHERE rank <= 5
           UNION ALL SELECT dataset_id, 'anomaly_investigation', rank, entity_type || ':' || entity_value, round(deviation_pct, 2)
             FROM found_ranked WHERE rank <= 5 AND severity IN ('critical', 'high')
           UNION ALL SELECT dataset_id, 'opportunity', rank, entity, round(priority, 2) FROM opportunity_rank WHERE rank <= 5
           UNION ALL SELECT dataset_id, 'savings', rank, 'Implementing recommendation for ' || entity,
             round(current_cost * (pct / 100), 2) FROM estimates WHERE rank <= 3""",
        "drivers",
        "found_ranked",
        "opportunity_rank",
        "estimates",
    ),
)
def run_stage_evidence(spark, sf_dir):
    with decision_run(everything(spark, sf_dir)) as run:
        evidence = settled(stage_evidence(run))
    return evidence.select(
        "dataset_id", "stage", F.col("rank").cast("bigint").alias("rank"), "item", F.round("value", 2).alias("value")
    )
