import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from costlens.functions import scores
from costlens.operators import anomaly


def spiked(n, base, at=None, value=None):
    costs = [float(base)] * n
    if at is not None:
        costs[at] = float(value)
    return costs


def test_robust_finds_spike_with_zero_mad(make_panel):
    got = anomaly.robust_zscore(make_panel({"a": spiked(30, 100, 15, 800)})).collect()
    assert [(str(r.day), round(r.z_score, 3), r.severity) for r in got] == [("2024-01-16", 5.477, "critical")]


def test_rolling_finds_spike(make_panel):
    got = anomaly.rolling_zscore(make_panel({"a": spiked(30, 100, 20, 600)})).collect()
    assert [(str(r.day), round(r.z_score, 3)) for r in got] == [("2024-01-21", 3.474)]
    assert anomaly.rolling_zscore(make_panel({"a": spiked(14, 100, 9, 600)})).count() == 0


def test_flat_series_is_clean(make_panel):
    flat = make_panel({"a": spiked(30, 100), "b": spiked(2000, 0.1)})
    for found in (anomaly.rolling_zscore(flat), anomaly.robust_zscore(flat), anomaly.ewma_zscore(flat), anomaly.detect(flat)):
        assert found.count() == 0


def test_ewma_threshold(make_panel):
    rows = make_panel({"a": spiked(40, 200, 30, 1000)})
    assert anomaly.ewma_zscore(rows).count() == 0
    got = anomaly.ewma_zscore(rows, threshold=1.5).where("day = '2024-01-31'").first()
    assert round(got.z_score, 3) == 2.818


def test_ewm_equals_pandas_over_blocks_and_gaps(make_panel):
    rng = np.random.default_rng(3)
    long = rng.gamma(2, 100, 3500)
    holes = [None if i in (0, 5, 6, 7, 60) else float(v) for i, v in enumerate(rng.gamma(2, 50, 80))]
    series = {"long": list(long), "holes": holes, "line": [1000 + 5 * i for i in range(200)]}
    got = anomaly.with_ewma(make_panel(series, partitions=3)).orderBy("day").toPandas()
    for name, costs in series.items():
        x = pd.Series(costs, dtype=float)
        mean = x.ewm(span=14).mean()
        spread = (x - mean).ewm(span=14).std().replace(0, np.nan).fillna(x.std())
        ours = got[got.entity_value == name].reset_index(drop=True)
        known = x.notna()
        np.testing.assert_allclose(ours.ewma[known], mean[known], rtol=1e-10)
        np.testing.assert_allclose(ours.ewma_std[known], spread[known], rtol=1e-7)


def test_single_pass_equals_separate_detectors(make_panel):
    rng = np.random.default_rng(5)
    series = {f"s{i}": list(rng.gamma(0.3, 100, 60)) for i in range(6)} | {"short": [1, 2, 900, 1, 2, 3]}
    rows = make_panel(series)
    columns = ["id", "day", "method", "severity", "supporting_evidence"]
    one = sorted(anomaly.detect(rows).select(columns).collect())
    long_enough = rows.where("entity_value <> 'short'")
    two = anomaly.combine(anomaly.robust_zscore(long_enough), anomaly.ewma_zscore(long_enough))
    assert one == sorted(two.select(columns).collect()) and one


def test_order_and_partitions_do_not_matter(make_panel):
    rng = np.random.default_rng(6)
    rows = make_panel({f"s{i}": list(rng.gamma(0.3, 100, 90)) for i in range(4)})
    base = sorted(r.id for r in anomaly.detect(rows).collect())
    shuffled = rows.orderBy(F.rand(1)).repartition(7)
    assert base == sorted(r.id for r in anomaly.detect(shuffled).collect())


def test_detection_uses_one_exchange_per_panel(make_panel):
    plan = anomaly.with_ewma(anomaly.with_robust(make_panel({"a": [1, 2, 3]})))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize(
    "deviation, label",
    [(24.9, "low"), (25, "medium"), (-49, "medium"), (50, "high"), (99.9, "high"), (-100, "critical")],
)
def test_severity_edges(spark, deviation, label):
    assert spark.range(1).select(scores.severity(F.lit(float(deviation)))).first()[0] == label


def test_residual_converter_skips_zero_expectation(make_panel):
    rows = make_panel({"a": [10.0] * 30 + [500.0] + [10.0] * 9}).withColumn(
        "guess", F.when(F.dayofmonth("day") == 3, 0.0).otherwise(10.0)
    )
    got = anomaly.residual_anomalies(rows, "guess", "seasonal").collect()
    assert [(str(r.day), r.method, len(r.supporting_evidence)) for r in got] == [("2024-01-31", "seasonal", 5)]


def test_report_counts_before_the_cap(make_billing):
    billing = make_billing(spike=40)
    found = anomaly.run_detection(billing, "no_such_column")
    assert anomaly.ranked(found, 1).count() == 1
    report = anomaly.report(billing, found).first()
    assert report.total_anomalies == found.count() >= 1 and report.critical_count >= 1
