"""The whole run: quality, drivers, anomalies, opportunities, savings, decision."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import renewed
from ..operators import anomaly, decision, opportunity, quality, scenario, spend
from ..operators.panel import daily_rollup
from ..session import drop_table, scratch_table


class DecisionRun:
    """Result tables of one run over all datasets of a canonical table.

    A table is built when it is first asked for.  The charges are read once for the
    quality gate and once for the daily rollup, and again for the quality report if it is asked for; all later stages work on the rollup.
    The tables that several stages share are written to the shared folder as they
    are reached, so each is computed once, a lost executor costs no earlier stage,
    and the plans of later stages stay short; ``close`` deletes them, and so does leaving
    a ``with`` block, also by an error.  All other tables are lazy.  Datasets that fail the quality gate stop there.
    """

    def __init__(
        self,
        billing: DataFrame,
        *,
        entity_type: str = "service",
        top_n: int = 10,
        driver_changes: bool = True,
        anomaly_limit: int | None = None,
        distinct: str = "exact",
    ) -> None:
        self.billing = billing
        self.entity_type = entity_type
        self.top_n = top_n
        self.driver_changes = driver_changes
        self.anomaly_limit = anomaly_limit
        self.distinct = distinct
        self._written: list[str] = []

    def _keep(self, table: DataFrame, name: str) -> DataFrame:
        path = scratch_table(table.sparkSession, name)
        table.write.parquet(path)
        self._written.append(path)
        return table.sparkSession.read.schema(table.schema).parquet(path)

    def __enter__(self) -> DecisionRun:
        return self

    def __exit__(self, *failure: object) -> None:
        self.close()

    def close(self) -> None:
        while self._written:
            drop_table(self.billing.sparkSession, self._written.pop())

    @cached_property
    def checked(self) -> DataFrame:
        """The quality report without distinct values, which decide nothing."""
        return self._keep(quality.quality_report(self.billing, "none"), "checked")

    @cached_property
    def quality(self) -> DataFrame:
        if self.distinct == "none":
            return self.checked
        return self._keep(quality.quality_report(self.billing, self.distinct), "quality")

    @cached_property
    def gate(self) -> DataFrame:
        return decision.quality_gate(self.checked)

    @cached_property
    def usable(self) -> DataFrame:
        """Daily rollup of the datasets that passed the gate."""
        dims = dict.fromkeys([*spend.SUMMARY_DIMENSIONS, self.entity_type])
        rollup = daily_rollup(self.billing, list(dims))
        return self._keep(decision.usable_only(rollup, self.gate), "rollup")

    @cached_property
    def drivers(self) -> DataFrame:
        found = spend.cost_drivers(self.usable, self.top_n, with_change=self.driver_changes)
        return self._keep(found, "drivers")

    @cached_property
    def attribution(self) -> DataFrame:
        return spend.attribution_report(self.usable, self.top_n, drivers=self.drivers)

    @cached_property
    def anomalies(self) -> DataFrame:
        return self._keep(anomaly.run_detection(self.usable, self.entity_type), "anomalies")

    @cached_property
    def anomaly_report(self) -> DataFrame:
        return anomaly.report(self.usable, self.anomalies)

    @cached_property
    def _opportunities(self) -> DataFrame:
        fed = self.anomalies
        if self.anomaly_limit is not None:
            fed = anomaly.ranked(fed, self.anomaly_limit)
        return opportunity.all_rules(self.usable, self.drivers, fed)

    @cached_property
    def opportunities(self) -> DataFrame:
        return self._keep(opportunity.ranked(self._opportunities), "opportunities")

    @cached_property
    def opportunity_totals(self) -> DataFrame:
        return opportunity.totals(self._opportunities)

    @cached_property
    def recommendations(self) -> DataFrame:
        return decision.recommend(self.opportunities, with_facts=True)

    @cached_property
    def savings(self) -> DataFrame:
        return scenario.savings_from_facts(self.recommendations)

    @cached_property
    def checks(self) -> DataFrame:
        return decision.checks(self.gate.where("usable"), self.recommendations)

    @cached_property
    def decisions(self) -> DataFrame:
        """One row per dataset; a dataset that failed the gate has no decision."""
        status = F.when(F.col("usable"), "succeeded").otherwise("failed")
        return (
            self.gate.select("dataset_id", "overall_status", status.alias("run_status"))
            .join(renewed(decision.decide(self.checks)), "dataset_id", "left")
            .join(renewed(scenario.total_savings(self.savings)), "dataset_id", "left")
        )


def decision_run(billing: DataFrame, **options) -> DecisionRun:
    """Quality, drivers, anomalies, opportunities, recommendations, savings, decision.

    ``driver_changes=False`` leaves the cost growth rule without input and
    ``anomaly_limit=100`` feeds the spike rule from the capped report.  The gate looks
    at no distinct counts; ``distinct="none"`` leaves them out of the quality report.
    """
    return DecisionRun(billing, **options)


# Confidence a stage reports.
STAGES = (
    "data_quality",
    "cost_attribution",
    "anomaly_investigation",
    "opportunity",
    "optimization",
    "savings",
    "critic",
)
STAGE_CONFIDENCE = {
    "cost_attribution": 0.9,
    "anomaly_investigation": 0.9,
    "opportunity": 0.75,
    "optimization": 0.75,
    "savings": 0.6,
}
ALARMED_CONFIDENCE = 0.8


def _long(table: DataFrame, stage: str, confidence: Column, **metrics: Column) -> DataFrame:
    values = F.array(
        *[F.struct(F.lit(n).alias("metric"), c.cast("double").alias("value")) for n, c in metrics.items()]
    )
    return table.select(
        "dataset_id",
        F.lit(STAGES.index(stage) + 1).alias("stage_order"),
        F.lit(stage).alias("stage"),
        confidence.cast("double").alias("confidence"),
        F.inline(values),
    )


def stage_summary(run: DecisionRun) -> DataFrame:
    """Figures each stage hands on, one row per dataset, stage and figure."""

    def flat(stage: str) -> Column:
        return F.lit(STAGE_CONFIDENCE[stage])

    col = F.col
    advised = run.recommendations.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))
    ready = run.gate.where("usable").select("dataset_id")
    alarm = F.when(
        col("critical_count") + col("high_count") > 0, ALARMED_CONFIDENCE
    ).otherwise(flat("anomaly_investigation"))
    zero = F.lit(0)
    parts = [
        _long(
            run.checked.join(renewed(run.gate.select("dataset_id", "usable", "confidence")), "dataset_id"),
            "data_quality",
            col("confidence"),
            usable=col("usable").cast("int"),
            total_rows=col("total_rows"),
            valid_rows=col("valid_rows"),
            duplicate_rows=col("duplicate_rows"),
            issues=F.size("issues"),
            warnings=F.size("warnings"),
        ),
        _long(
            run.attribution,
            "cost_attribution",
            flat("cost_attribution"),
            total_cost=col("total_cost"),
            driver_count=F.size("top_drivers"),
            pop_change_pct=col("period_over_period_change_pct"),
        ),
        _long(
            run.anomaly_report,
            "anomaly_investigation",
            alarm,
            total_anomalies=col("total_anomalies"),
            critical_count=col("critical_count"),
            high_count=col("high_count"),
        ),
        _long(
            ready.join(renewed(run.opportunity_totals), "dataset_id", "left"),
            "opportunity",
            flat("opportunity"),
            total_opportunities=F.coalesce(col("total_opportunities"), zero),
            estimated_savings=F.coalesce(col("total_potential_savings"), F.lit(0.0)),
        ),
        _long(
            ready.join(renewed(advised), "dataset_id", "left"),
            "optimization",
            flat("optimization"),
            recommendation_count=F.coalesce(col("n"), zero),
        ),
        _long(
            ready.join(renewed(scenario.total_savings(run.savings)), "dataset_id", "left"),
            "savings",
            flat("savings"),
            savings_count=F.coalesce(col("savings_count"), zero),
            total_estimated_savings=F.coalesce(col("total_estimated_savings"), F.lit(0.0)),
        ),
        _long(
            run.decisions.where(col("run_status") == "succeeded"),
            "critic",
            col("confidence"),
            checks_passed=col("checks_passed"),
            checks_failed=col("checks_failed"),
            missing_evidence=col("missing_evidence"),
        ),
    ]
    summary = parts[0]
    for part in parts[1:]:
        summary = summary.unionByName(part)
    return summary


def stage_evidence(run: DecisionRun) -> DataFrame:
    """The top items a stage looks at: 5 drivers, 5 anomalies, 5 opportunities, 3 estimates."""
    col = F.col
    drivers = run.drivers.where(col("rank") <= 5).select(
        "dataset_id",
        F.lit("cost_attribution").alias("stage"),
        "rank",
        F.concat("dimension", F.lit(":"), "value").alias("item"),
        col("cost").alias("value"),
    )
    # Critical and high rank first anyway, so the cut can follow the report order.
    anomalies = (
        anomaly.ranked(run.anomalies.where(col("severity").isin("critical", "high")), 5)
    ).select(
        "dataset_id",
        F.lit("anomaly_investigation").alias("stage"),
        "rank",
        F.concat("entity_type", F.lit(":"), "entity_value").alias("item"),
        col("deviation_pct").alias("value"),
    )
    opportunities = run.opportunities.where(col("rank") <= 5).select(
        "dataset_id",
        F.lit("opportunity").alias("stage"),
        "rank",
        col("entity").alias("item"),
        col("priority_score").alias("value"),
    )
    estimates = run.savings.where(col("priority_rank") <= 3).select(
        "dataset_id",
        F.lit("savings").alias("stage"),
        col("priority_rank").alias("rank"),
        col("scenario_description").alias("item"),
        col("estimated_savings").alias("value"),
    )
    return drivers.unionByName(anomalies).unionByName(opportunities).unionByName(estimates)
