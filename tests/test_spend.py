import pytest

from costlens.operators import filters, opportunity, panel, spend


def test_period_end_is_midnight_unless_inclusive(spark):
    rows = spark.sql(
        "SELECT 'd' AS dataset_id, CAST(t AS timestamp_ntz) AS charge_period_start FROM VALUES "
        "('2024-01-01 00:00:00'), ('2024-01-02 00:00:00'), ('2024-01-02 10:00:00'), ('2024-01-03 00:00:00'), (NULL) AS t(t)"
    )
    assert filters.in_period(rows, "2024-01-01", "2024-01-02").count() == 2
    assert filters.in_period(rows, "2024-01-01", "2024-01-02", end_inclusive=True).count() == 3
    assert filters.in_period(rows, start="2024-01-02").count() == 3
    assert filters.in_period(rows, end="2024-01-01").count() == 1


def test_breakdown_checks_its_dimension(make_billing):
    billing = make_billing(5)
    with pytest.raises(ValueError):
        spend.resource_breakdown(billing, "pricing_category")
    assert spend.resource_breakdown(billing, "sku").count() == 0
    assert spend.resource_breakdown(billing, "service", limit=2).count() == 2


def test_unknown_merges_with_missing(spark, make_billing):
    from pyspark.sql import functions as F

    billing = make_billing(4, 3).withColumn(
        "region", F.when(F.col("service") == "service_0", F.lit("unknown")).when(F.col("service") == "service_1", F.col("region"))
    )
    got = {r.value: r.cost for r in spend.cost_by_dimension(billing, ["region"]).collect()}
    assert set(got) == {"unknown", "us-east-1"} and got["unknown"] == pytest.approx(2 * got["us-east-1"] + 200)


def test_summary_and_attribution(make_billing):
    billing = make_billing()
    total = sum(r.billed_cost for r in billing.collect())
    summary = spend.spend_summary(billing).first()
    assert summary.total_billed_cost == pytest.approx(total)
    assert summary.currency == "USD" and len(summary.service_breakdown) == 3
    assert max(summary.service_breakdown, key=summary.service_breakdown.get) == "service_0"
    report = spend.attribution_report(billing).first()
    assert [d.dimension for d in report.top_drivers[:3]] == ["provider", "account", "region"]
    assert report.concentration_score > 3  # pooled dimensions overlap
    index = {r.dimension: r.hhi for r in spend.hhi_by_dimension(billing).collect()}
    assert index["provider"] == pytest.approx(1.0) and 0.33 < index["service"] < 0.4


def test_month_change_skips_gaps_and_needs_a_positive_base(spark):
    def change(values):
        rows = spark.createDataFrame(values, "dataset_id string, m string, billed_cost double").selectExpr(
            "dataset_id", "CAST(m AS timestamp_ntz) AS charge_period_start", "billed_cost"
        )
        return {r.dataset_id: r.change_pct for r in spend.month_over_month(rows).collect()}

    got = change([("a", "2024-01-05", 10.0), ("a", "2024-04-01", 15.0), ("b", "2024-01-01", 5.0), ("c", "2024-01-01", 0.0), ("c", "2024-02-01", 5.0)])
    assert got == {"a": 50.0, "b": None, "c": None}


def test_rollup_serves_the_same_results(make_billing):
    billing = make_billing(spike=40)
    rolled = panel.daily_rollup(billing)
    assert sorted(spend.cost_drivers(billing, with_change=True).collect()) == sorted(
        spend.cost_drivers(rolled, with_change=True).collect()
    )
    assert sorted(panel.daily_series(billing).collect()) == sorted(panel.daily_series(rolled).collect())
    assert sorted(opportunity.monthly_service_usage(billing).collect()) == sorted(
        opportunity.monthly_service_usage(rolled).collect()
    )


def test_densify_only_on_request(make_panel):
    from pyspark.sql import functions as F

    gappy = make_panel({"a": range(1, 11)}).where(F.dayofmonth("day") % 3 != 0)
    assert gappy.count() == 7 and panel.densify(gappy).count() == 10


def test_plans_push_down_and_avoid_cross_joins(spark, make_billing, tmp_path):
    make_billing().write.parquet(str(tmp_path / "b"))
    billing = spark.read.parquet(str(tmp_path / "b"))
    plan = spend.spend_trend(filters.in_period(billing, "2024-01-10"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(charge_period_start" in plan
    assert "ReadSchema: struct<billed_cost:double,effective_cost:double,charge_period_start:timestamp_ntz,dataset_id" in plan or "provider" not in plan
    for frame in (spend.spend_summary(billing), spend.cost_drivers(billing, with_change=True)):
        text = frame._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text and "NestedLoop" not in text
