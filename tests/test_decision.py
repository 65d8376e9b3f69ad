import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from costlens import sources
from costlens.operators import anomaly, budget, decision, opportunity, panel, scenario, spend
from costlens.operators.scenario import Scenario
from costlens.plans import decision_run
from costlens.plans.decision_run import stage_evidence, stage_summary


def test_run_covers_all_datasets_and_stops_the_bad_one(make_billing):
    good = make_billing(spike=50, dataset_id="good")
    bad = make_billing(10, dataset_id="bad").withColumn("billed_cost", F.lit(None).cast("double"))
    run = decision_run(good.unionByName(bad))
    rows = {r.dataset_id: r for r in run.decisions.collect()}
    assert (rows["bad"].run_status, rows["bad"].decision) == ("failed", None)
    assert (rows["good"].run_status, rows["good"].decision, rows["good"].confidence) == ("succeeded", "APPROVE", 1.0)
    assert rows["good"].recommendation_count == run.recommendations.count() == run.savings.count()
    assert {r.dataset_id for r in run.anomalies.select("dataset_id").distinct().collect()} == {"good"}
    summary = {(r.dataset_id, r.metric): r.value for r in stage_summary(run).collect()}
    assert summary[("bad", "usable")] == 0 and ("bad", "checks_passed") not in summary
    assert summary[("good", "total_anomalies")] >= 1
    assert stage_evidence(run).where("stage = 'savings'").count() <= 3
    joined = scenario.implementation_savings(run.recommendations, run.opportunities)
    columns = ["recommendation_id", "estimated_savings", "assumptions", "confidence"]
    assert sorted(joined.select(columns).collect()) == sorted(run.savings.select(columns).collect())
    run.close()


def test_same_ids_on_every_run(make_billing):
    ids = []
    for _ in range(2):
        run = decision_run(make_billing(spike=50))
        ids.append(sorted(r.recommendation_id for r in run.recommendations.collect()))
        run.close()
    assert ids[0] == ids[1] and ids[0]


def test_growth_rule_needs_driver_changes(make_billing):
    billing = make_billing()
    assert opportunity.cost_growth(spend.cost_drivers(billing)).count() == 0
    assert opportunity.cost_growth(spend.cost_drivers(billing, with_change=True), 0.1).count() > 0


def test_divergence_needs_two_months(make_billing):
    assert opportunity.quantity_growth(make_billing(20)).count() == 0
    grown = make_billing(59).withColumn(
        "billed_cost", F.col("billed_cost") * F.when(F.month("charge_period_start") == 2, 2.0).otherwise(1.0)
    )
    assert opportunity.quantity_growth(grown).count() == 3
    assert opportunity.quantity_growth(grown.withColumn("quantity", F.lit(0.0))).count() == 0


def advice(spark, rows):
    return spark.createDataFrame(
        rows,
        "dataset_id string, recommendation_id string, priority_rank int, title string, evidence array<string>, "
        "actions array<struct<action_type: string, description: string, assumptions: array<string>>>",
    )


@pytest.mark.parametrize(
    "evidence, action, note, decision_, confidence",
    [
        (["x"], ("investigate", "look", ["a"]), "ESTIMATED SAVINGS", "APPROVE", 1.0),
        ([], ("investigate", "look", []), "ESTIMATED SAVINGS", "APPROVE", 0.8),
        (["x"], ("scale", "Terminate it", ["a"]), "ESTIMATED SAVINGS", "REJECT", 0.8),
        (["x"], ("investigate", "look", ["a"]), "savings", "APPROVE", 1.0),
    ],
)
def test_critic(spark, evidence, action, note, decision_, confidence):
    gate = spark.createDataFrame([("d", True)], "dataset_id string, usable boolean")
    recs = advice(spark, [("d", "r1", 1, "t", evidence, [action])])
    got = decision.decide(decision.checks(gate, recs, note)).first()
    assert (got.decision, got.confidence) == (decision_, confidence)
    assert got.unsupported_claims == (0 if "ESTIMATED" in note else 1)


def test_critic_without_recommendations_and_failed_gate(spark):
    none = advice(spark, [])
    for usable, verdict in ((True, "INVESTIGATE"), (False, "REJECT")):
        gate = spark.createDataFrame([("d", usable)], "dataset_id string, usable boolean")
        assert decision.decide(decision.checks(gate, none)).first().decision == verdict


def test_scenarios(spark):
    items = spark.createDataFrame([("r", "service:x", 200.0)], "recommendation_id string, entity string, current_cost double")
    asked = [Scenario("usage_reduction"), Scenario("usage_reduction", 100), Scenario("price_change", 20, 90), Scenario("recommendation_implementation", 25)]
    got = scenario.simulate(items, asked).collect()
    assert [r.estimated_savings for r in got] == [20.0, None, -40.0, 50.0]
    assert [r.is_valid for r in got] == [True, False, True, True]
    assert got[2].estimated_savings_pct == -20 and got[2].time_horizon_days == 90
    assert all(r.assumptions[-1] == scenario.ESTIMATED for r in got)
    with pytest.raises(ValueError):
        Scenario("budget_reduction")


def test_budget_status(spark, make_billing):
    billing = make_billing(10, 1)  # 150 .. 154.5 a day
    rows = [(n, "service", "service_0", "monthly", "2024-01-01", "2024-01-05", amount, "USD") for n, amount in (("ok", 1000.0), ("risk", 900.0), ("over", 700.0))]
    rows.append(("unused", "service", "nobody", "monthly", "2024-01-01", "2024-01-05", 10.0, "USD"))
    budgets = spark.createDataFrame(rows, "name string, entity_type string, entity_value string, period_type string, period_start string, period_end string, budget_amount double, currency string").withColumns(
        {c: F.col(c).cast("date") for c in ("period_start", "period_end")}
    )
    variance = budget.budget_variance(billing, budgets, ("service",))
    got = {r.name: (r.actual_spend, r.status) for r in variance.collect()}
    assert got == {"ok": (755.0, "on_track"), "risk": (755.0, "at_risk"), "over": (755.0, "over_budget"), "unused": (0.0, "on_track")}
    cut = {r.name: r.required_savings for r in budget.budget_reduction(variance, 50).collect()}
    assert cut["ok"] == 255.0 and cut["unused"] == 0.0


MINIMAL = """BilledCost,ChargePeriodStart,ChargePeriodEnd,BillingCurrency,ProviderName,ServiceName
"""


def test_run_on_a_file_with_few_columns(spark, tmp_path):
    days = [f"2024-{1 + i // 28:02d}-{1 + i % 28:02d}" for i in range(50)]
    lines = [f"{100 + i + 900 * (i == 40)},{d}T00:00:00Z,{d}T23:59:59Z,USD,P,{s}" for i, d in enumerate(days) for s in ("a", "b")]
    (tmp_path / "few.csv").write_text(MINIMAL + "\n".join(lines) + "\n")
    billing = sources.to_canonical(sources.read_billing(spark, str(tmp_path / "few.csv")), dataset_id="few")
    assert not {"quantity", "account", "region", "effective_cost"} & set(billing.columns)
    with decision_run(billing) as run:
        row = run.decisions.first()
        assert (row.run_status, row.decision is not None) == ("succeeded", True)
        assert run.anomalies.count() > 0 and run.opportunities.where("opportunity_type = 'quantity_growth'").count() == 0
    with decision_run(billing.drop("service", "quantity")) as run:
        assert run.decisions.first().run_status == "succeeded" and run.anomalies.count() == 0


def test_run_closes_on_an_error(make_billing):
    with pytest.raises(RuntimeError), decision_run(make_billing(spike=50)) as run:
        path = run.quality.inputFiles()[0]
        raise RuntimeError
    assert not os.path.exists(path.removeprefix("file://").removeprefix("file:"))


def test_report_of_a_run_counts_distinct_values(make_billing):
    with decision_run(make_billing()) as run:
        fields = {f.field_name: f.unique_count for f in run.quality.first().field_metrics}
    assert fields["service"] == 3 and fields["resource"] == 3


def test_scenarios_take_the_callers_view(spark):
    items = spark.createDataFrame([("d", "r", "service:x", 200.0)], "dataset_id string, recommendation_id string, entity string, current_cost double")
    own, usual = scenario.simulate(
        items, [Scenario("price_change", 5, assumptions=("Rates hold",), confidence=0.9), Scenario("price_change", 5)]
    ).orderBy("confidence", ascending=False).collect()
    assert (own.confidence, own.assumptions) == (0.9, ["Rates hold", scenario.ESTIMATED])
    assert usual.confidence == 0.4 and len(usual.assumptions) == 4
    with pytest.raises(ValueError):
        Scenario("price_change", confidence=2.0)


def test_budgets_count_their_own_currency(spark, make_billing):
    euros = make_billing(10).withColumn("currency", F.lit("EUR"))
    billing = make_billing(10).unionByName(euros)
    day = dt.date(2024, 1, 1)
    rows = [(c or "any", "total", "all", "m", day, dt.date(2024, 1, 31), 1000.0, c) for c in ("USD", "EUR", "CHF", None)]
    got = {r.name: r for r in budget.budget_variance(billing, spark.createDataFrame(rows, budget.BUDGETS), ("total",)).collect()}
    assert got["USD"].actual_spend == got["EUR"].actual_spend == got["any"].actual_spend / 2 > 0
    assert (got["CHF"].actual_spend, got["CHF"].dataset_id) == (0.0, None)
    plan = budget.budget_variance(billing, spark.createDataFrame(rows, budget.BUDGETS), ("total",))._jdf.queryExecution().toString()
    assert "LeftOuter" in plan and "Inner" in plan


def test_dimension_rollup_grows_with_values_not_with_combinations(spark):
    days, n = [dt.datetime(2024, 1, 1) + dt.timedelta(days=i) for i in range(60)], 6
    rows = [
        ("d", day, f"p{a}", f"a{b}" if b else None, f"s{c}" if c else None, None, (1.0 + a + 2 * b + 3 * c) * (9 if i == 50 and c == 1 else 1 + i // 31), float(c))
        for i, day in enumerate(days) for a in range(n) for b in range(n) for c in range(n)
    ]
    names = "dataset_id string, charge_period_start timestamp_ntz, provider string, account string, service string, region string, billed_cost double, quantity double"
    billing = spark.createDataFrame(rows, names)
    rollup = panel.dimension_rollup(billing)
    assert rollup.count() <= len(days) * 2 * (3 * n + 2)

    def told(found):
        return sorted((r.opportunity_type, r.entity, round(r.potential_savings_estimate, 6), r.description) for r in found.collect())

    whole = told(opportunity.find(billing, anomaly.run_detection(billing)))
    assert whole and told(opportunity.find_rolled(rollup)) == whole


def test_values_with_the_same_charges_tie(spark):
    """The total of the same days is the same to the last digit for each dimension, so the order of dimensions decides."""
    rows = [("d", dt.datetime(2024, 1 + i % 3, 1 + i % 28), None, f"a{i % 5}", "s", None, 0.1 + i / 7, 1.0) for i in range(400)]
    names = "dataset_id string, charge_period_start timestamp_ntz, provider string, account string, service string, region string, billed_cost double, quantity double"
    rollup = panel.dimension_rollup(spark.createDataFrame(rows, names).coalesce(1))
    costs = spend.rolled_cost_by_dimension(rollup, by_month=True)
    top = spend.drivers_of(costs, with_change=True).where("rank <= 3").orderBy("rank").collect()
    assert len({r.cost for r in top}) == 1 and [r.dimension for r in top] == ["provider", "service", "region"]
