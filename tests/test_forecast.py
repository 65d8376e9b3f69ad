import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from costlens.functions import smoothing, trees
from costlens.operators import forecast, replay


def wave(n):
    return [1000 + 5 * i + 50 * math.sin(2 * math.pi * i / 7) for i in range(n)]


def test_naive_repeats_the_last_value(make_panel):
    got = forecast.naive(make_panel({"a": wave(30)}), 7).orderBy("step").collect()
    assert len(got) == 7 and {r.yhat for r in got} == {wave(30)[-1]}
    assert str(got[0].day) == "2024-01-31"


def test_metric_values(spark):
    rows = spark.createDataFrame(
        [("d", "t", "e", "m", a, a + 5.0) for a in (100.0, 110.0, 120.0, 130.0)],
        "dataset_id string, entity_type string, entity_value string, method string, actual double, predicted double",
    )
    got = forecast.metrics(rows).first()
    assert (got.mae, got.rmse, got.bias, round(got.wape, 6)) == (5.0, 5.0, 5.0, round(20 / 460, 6))
    empty = forecast.metrics(rows.withColumn("actual", F.lit(0.0))).first()
    assert math.isinf(empty.wape)


def test_holdouts_match_the_definition(make_panel):
    costs = wave(23)
    rows = make_panel({"a": costs, "tiny": [1, 2, 3, 4]})
    naive = forecast.naive_holdout(rows).orderBy("day").collect()
    assert [r.actual for r in naive] == costs[18:] and {r.predicted for r in naive} == {costs[17]}
    average = forecast.moving_average_holdout(rows).orderBy("day").collect()
    np.testing.assert_allclose([r.predicted for r in average], [np.mean(costs[i - 7 : i]) for i in range(18, 23)])


def test_fit_recovers_trend_and_week(make_panel):
    got = forecast.holt_winters(make_panel({"a": wave(80)}), 14)
    ahead = [r.yhat for r in forecast.smoothing_forecast(got).orderBy("step").collect()]
    np.testing.assert_allclose(ahead, wave(94)[80:], rtol=1e-6)
    assert forecast.metrics(forecast.smoothing_holdout(got)).first().mae < 1e-3


def squared_error(y, params, season):
    """Least squared error over all initial states, step by step."""
    rows, parts = len(params), smoothing._parts(season)
    scale = np.abs(y).max()
    wide = np.repeat(y[None] / scale, rows, 0)
    products, _ = smoothing._pass(wide, np.full(rows, len(y)), params, np.zeros((rows, parts)), season, False)
    return smoothing._initial(products, parts)[1] * scale**2


def test_fit_is_close_to_a_random_search():
    rng = np.random.default_rng(2)
    for season, n in ((False, 15), (True, 22), (True, 60), (True, 300)):
        y = 100 + np.cumsum(rng.normal(0, 5, n)) + rng.normal(0, 5, n)
        tries = smoothing._admissible(rng.uniform(0, 1, (4000, 3)) * [1, 1, season])
        assert smoothing.fit(y, season)[3] <= squared_error(y, tries, season).min() * 1.001


def test_fit_is_no_worse_than_shrinking_grids():
    rng = np.random.default_rng(8)
    series = [np.abs(100 + np.cumsum(rng.normal(0, 5, n)) + rng.normal(0, 5, n)) for n in rng.integers(21, 60, 25)]
    for season in (True, False):
        found = smoothing.fit_many(series, season)[3]
        for y, error in zip(series, found):
            best, least = None, np.inf
            for reach in (None, 0.1, 0.05, 0.02, 0.01, 0.005):
                if reach is None:
                    axes = [(0.02, 0.1, 0.3, 0.6, 0.9), (0.0, 0.02, 0.1), (0.0, 0.1, 0.3)]
                else:
                    axes = [np.clip(best[i] + np.array([-reach, 0, reach]), 1e-4, 0.9999) for i in range(3)]
                axes[2] = axes[2] if season else (0.0,)
                grid = smoothing._admissible(np.stack(np.meshgrid(*axes), -1).reshape(-1, 3))
                errors = squared_error(y, grid, season)
                if errors.min() < least:
                    least, best = errors.min(), grid[errors.argmin()]
            assert error <= least * 1.0005


def test_derivatives_are_those_of_the_error():
    rng = np.random.default_rng(9)
    y = rng.uniform(1, 2, (1, 40))
    params, initial = np.array([[0.4, 0.1, 0.2]]), rng.normal(0, 1, (1, 9))

    def error(p):
        return smoothing._pass(y, np.array([40]), p, initial, True, True)[0]

    exact = 2 * error(params)[0, -3:, 0]
    for i in range(3):
        move = np.zeros((1, 3))
        move[0, i] = 1e-6
        assert exact[i] == pytest.approx((error(params + move)[0, 0, 0] - error(params - move)[0, 0, 0]) / 2e-6, rel=1e-4)


def test_states_on_the_way_are_those_of_shorter_series():
    rng = np.random.default_rng(10)
    series = [rng.uniform(50, 100, n) for n in (12, 40, 95)]
    stops = [[(10, False), (12, False)], [(14, False), (27, True), (40, True)], [(95, True), (30, True)]]
    weights = np.array([0.3, 0.1, 0.2])
    for fixed in (weights, None):
        found = smoothing.states_at(series, stops, fixed)
        cut = [[smoothing.states_at([y[:k]], [[(k, season)]], fixed)[0][0] for k, season in own] for y, own in zip(series, stops)]
        for ours, theirs in zip(found, cut):
            for (params, state), (other, alone) in zip(ours, theirs):
                np.testing.assert_allclose(params, other, atol=1e-6)
                np.testing.assert_allclose(state, alone, rtol=1e-6, atol=1e-6)


def test_forecast_is_never_negative(make_panel):
    got = forecast.holt_winters(make_panel({"a": [100 - 5 * i for i in range(20)]}), 10)
    assert min(r.yhat for r in forecast.smoothing_forecast(got).collect()) == 0.0


def test_chain_by_length(make_panel):
    rows = make_panel({"smooth": wave(30), "average": wave(8), "naive": wave(5), "short": wave(4)})
    chosen = {r.entity_value: r.method for r in forecast.chosen_methods(rows).collect()}
    assert chosen == {"smooth": "exp_smoothing", "average": "moving_average", "naive": "naive", "short": "skipped"}
    points = forecast.forecast_panel(rows, 3).collect()
    assert sorted((r.entity_value, r.method) for r in points) == sorted(
        (e, m) for e, m in chosen.items() if m != "skipped" for _ in range(3)
    )
    assert [r.entity_value for r in forecast.skipped(rows).collect()] == ["short"]


def test_the_future_changes_nothing_before_it(make_panel):
    base, cut = wave(60), 45
    changed = base[:cut] + [9e6] * (60 - cut)
    early = F.col("day") < F.date_add(F.lit("2024-01-01").cast("date"), cut)
    one, two = (forecast.features(make_panel({"a": s})).where(early).orderBy("day").collect() for s in (base, changed))
    assert one == two and one
    origin = ["2024-02-10"]
    kept = [
        sorted(forecast.moving_average(replay.replay(make_panel({"a": s}), origin).drop("origin"), 5).collect())
        for s in (base, changed)
    ]
    assert kept[0] == kept[1]


def test_gate_prefers_the_simpler_method_on_a_tie(spark):
    rows = spark.createDataFrame(
        [("d", "t", "e", "exp_smoothing", 0.1), ("d", "t", "e", "naive", 0.1), ("d", "t", "f", "naive", 0.2), ("d", "t", "f", "moving_average", 0.1)],
        "dataset_id string, entity_type string, entity_value string, method string, wape double",
    )
    assert {r.entity_value: r.method for r in forecast.best_method(rows).collect()} == {"e": "naive", "f": "moving_average"}
    gate = forecast.passes_gate(rows.where("method <> 'naive'"), rows.where("method = 'naive'"))
    assert {r.entity_value: r.passed for r in gate.collect()} == {"e": False, "f": True}


@pytest.fixture()
def boosted(make_panel):
    rows = make_panel({"a": wave(90), "b": [2 * v for v in wave(90)]})
    parts = forecast.modelled_rows(rows)
    return rows, parts, forecast.fit_boosted(parts, max_iter=8)


def test_boosted_recursion_uses_the_training_features(boosted):
    rows, parts, model = boosted
    points = forecast.boosted_forecast(model, rows, 3)
    got = {(r.entity_value, r.step): r.yhat for r in points.collect()}
    assert len(got) == 6 and min(got.values()) > 0
    # Every step must equal the model on the features of its day, the steps before it being history.
    grown = rows
    for step in (1, 2, 3):
        last = grown.groupBy("dataset_id", "entity_type", "entity_value").agg(F.date_add(F.max("day"), 1).alias("day"))
        wider = grown.unionByName(last.withColumn("cost", F.lit(0.0)))
        after = forecast.features(wider).join(last, ["dataset_id", "entity_type", "entity_value", "day"], "left_semi")
        scored = model.transform(forecast._vectors(after)).select("dataset_id", "entity_type", "entity_value", "day", F.col("predicted").alias("cost"))
        for r in scored.collect():
            assert got[(r.entity_value, step)] == pytest.approx(r.cost, rel=1e-9)
        grown = grown.unionByName(scored)


def test_compiled_trees_predict_what_the_model_predicts(boosted):
    rows, parts, model = boosted
    given = trees.compiled(model)
    assert len(given) == 8 and trees.compiled(given) is given
    for part in ("train", "val", "test"):
        one, two = (
            {(r.entity_value, r.day): r.predicted for r in forecast.boosted_holdout(m, parts, part).collect()} for m in (model, given)
        )
        assert one and one.keys() == two.keys()
        for key, value in one.items():
            assert two[key] == pytest.approx(value, rel=1e-9)


def test_one_stage_rolls_the_horizon(boosted):
    rows, _, model = boosted
    plans = [forecast.boosted_forecast(model, rows, h)._jdf.queryExecution().executedPlan().toString() for h in (2, 30)]
    assert plans[0].count("Exchange") == plans[1].count("Exchange") and "Python" not in plans[1]


def test_odd_ensembles(spark, make_panel):
    rows = make_panel({"a": wave(40), "short": wave(28)})
    nothing = forecast.boosted_forecast(trees.Ensemble(()), rows, 2).collect()
    assert [(r.entity_value, r.yhat) for r in nothing] == [("a", 0.0)] * 2
    leaves = trees.Ensemble(((1.0, 5.0), (0.5, -2.0)))
    assert {r.yhat for r in forecast.boosted_forecast(leaves, rows, 2).collect()} == {4.0}
    assert {r.yhat for r in forecast.boosted_forecast(trees.Ensemble(((1.0, -3.0),)), rows, 2).collect()} == {0.0}

    class Categories:
        toDebugString = "Model\n  Tree 0 (weight 1.0):\n    If (feature 0 in {0.0})\n     Predict: 1.0\n"

    with pytest.raises(ValueError, match="split on a number"):
        trees.compiled(Categories())


def test_gated_series_use_the_boosted_forecast(boosted):
    rows, parts, model = boosted
    gate = forecast.passes_gate(
        forecast.metrics(forecast.boosted_holdout(model, parts)), forecast.metrics(forecast.gate_baseline(parts))
    ).withColumn("passed", F.col("entity_value") == "b")
    extra = forecast.boosted_forecast(model, rows, 2)
    got = {(r.entity_value, r.method) for r in forecast.forecast_panel(rows, 2, boosted=(gate, extra)).collect()}
    assert got == {("a", "exp_smoothing"), ("b", "boosted_trees")}
    used = {r.entity_value: r.features for r in forecast.metadata(rows, 2, gate).collect()}
    assert used["a"] is None and used["b"] == list(forecast.FEATURES)


def test_unknown_days_do_not_count(make_panel):
    gaps = [10.0, None, 11.0, None, 12.0, None, 13.0, None, 14.0, 15.0, 16.0, 17.0]
    rows = make_panel({"gaps": gaps, "last": [1.0, 2.0, 3.0, 4.0, 5.0, None], "none": [None] * 12})
    methods = {r.entity_value: (r.n, r.method) for r in forecast.chosen_methods(rows).collect()}
    assert methods == {"gaps": (8, "moving_average"), "last": (5, "naive"), "none": (0, "skipped")}
    points = forecast.forecast_panel(rows, 3).collect()
    assert {r.entity_value for r in points} == {"gaps", "last"} and len(points) == 6
    assert {r.yhat for r in points if r.entity_value == "last"} == {5.0}
    assert [r.entity_value for r in forecast.skipped(rows).collect()] == ["none"]


def test_failed_fit_falls_to_the_average(make_panel):
    huge = [float("inf") if i == 3 else 10.0 for i in range(30)]
    got = forecast.holt_winters(make_panel({"bad": huge, "good": wave(40)}), 5).collect()
    assert {r.entity_value: r.method for r in got} == {"bad": "moving_average", "good": "exp_smoothing"}
    assert {r.yhat for r in got if r.entity_value == "bad" and r.kind == "forecast"} == {10.0}


def test_batches_do_not_change_the_fit(make_panel):
    rng = np.random.default_rng(5)
    rows = make_panel({f"s{i}": (wave(20 + 7 * i) + rng.normal(0, 3, 20 + 7 * i)).clip(0).tolist() for i in range(6)})
    key = ["entity_value", "kind", "step"]
    one, many = (forecast.holt_winters(rows, 7, batch=b).toPandas().sort_values(key).reset_index(drop=True) for b in (1, 64))
    assert (one[key] == many[key]).all().all() and np.allclose(one.yhat, many.yhat, rtol=1e-6, atol=1e-6)


def test_one_call_gives_points_metrics_and_bounds(make_panel):
    rng = np.random.default_rng(6)
    rows = make_panel({"long": (wave(120) + rng.normal(0, 1, 120)).tolist(), "week": [5.0] * 8, "short": [1.0, 2.0, 3.0, 4.0, 6.0], "none": [1.0]})
    got = {r.entity_value: r for r in forecast.forecast_result(rows, 14, use_boosted=True, max_iter=5).collect()}
    assert set(got) == {"long", "week", "short"}
    assert got["week"].method == "moving_average" and got["short"].method == "naive"
    assert all(len(r.points) == 14 and [p.step for p in r.points] == list(range(1, 15)) for r in got.values())
    assert (got["short"].mae, got["short"].baseline_mae, got["short"].holdout_rows) == (2.0, 2.0, 1)
    plain = forecast.forecast_result(rows, 14).where("entity_value = 'long'").first()
    assert plain.method == "exp_smoothing" and plain.wape < plain.baseline_wape
    held = forecast.metrics(forecast.smoothing_holdout(forecast.holt_winters(rows.where("entity_value = 'long'"), 14))).first()
    assert (plain.mae, plain.rmse, plain.bias) == pytest.approx((held.mae, held.rmse, held.bias))


def test_boosted_bounds_are_those_of_its_rows(make_panel):
    rng = np.random.default_rng(7)
    rows = make_panel({"a": (wave(120) + rng.normal(0, 1, 120)).tolist(), "b": wave(20)})
    chain = forecast.boosted_chain(rows, 3, max_iter=3)
    passed = forecast.Boosted(chain.gate.withColumn("passed", F.lit(True)), forecast.boosted_forecast(forecast.fit_boosted(forecast.modelled_rows(rows), max_iter=3), rows, 3), chain.holdout, chain.baseline, chain.bounds, chain.trees)
    row = forecast.forecast_result(rows, 3, boosted=passed).where("entity_value = 'a'").first()
    parts = forecast.modelled_rows(rows).groupBy("split").agg(F.min("day").alias("a"), F.max("day").alias("b")).collect()
    bounds = {p.split: (p.a, p.b) for p in parts}
    assert row.method == "boosted_trees" and row.n_trees == 3 and len(row.points) == 3
    assert (row.training_start, row.training_end) == bounds["train"] and (row.validation_start, row.validation_end) == bounds["val"]
    assert row.holdout_rows == forecast.modelled_rows(rows).where("split = 'val'").count()


GIVEN = trees.Ensemble(((1.0, (0, 1200.0, (4, 1100.0, 1000.0, 1150.0), 1300.0)), (0.5, (6, 30.0, -20.0, 15.0))))
ORIGINS = ["2024-01-04", "2024-01-15", "2024-02-20"]


def points_of(panel, **options):
    found = replay.backtest_points(panel, ORIGINS, 5, **options).collect()
    return {(r.entity_value, str(r.origin), r.method, r.step): (str(r.day), r.yhat) for r in found}


@pytest.mark.parametrize("fitted", [False, True])
def test_later_days_change_no_backtest(make_panel, fitted):
    rng = np.random.default_rng(11)
    base = (np.array(wave(70)) + rng.normal(0, 20, 70)).tolist()
    options = {"max_iter": 3} if fitted else {"params": (0.2, 0.05, 0.1), "model": GIVEN}
    cut = 51  # the last origin
    one, two = (points_of(make_panel({"a": s}), **options) for s in (base, base[:cut] + [9e6] * 19))
    assert one == two and {m for _, _, m, _ in one} == set(forecast.COMPLEXITY)
    # what the panel of an origin alone gives
    for origin, n in zip(ORIGINS, (4, 15, 51)):
        alone = make_panel({"a": base[:n]})
        found = {m: {} for m in forecast.COMPLEXITY}
        found["naive"] = {r.step: r.yhat for r in forecast.naive(alone, 5).collect()}
        found["moving_average"] = {r.step: r.yhat for r in forecast.moving_average(alone, 5).collect()}
        found["exp_smoothing"] = {
            r.step: r.yhat for r in forecast.smoothing_forecast(forecast.holt_winters(alone, 5, options.get("params"))).collect()
        }
        if n > 28:
            model = GIVEN if not fitted else forecast.fit_boosted(forecast.modelled_rows(alone), max_iter=3)
            found["boosted_trees"] = {r.step: r.yhat for r in forecast.boosted_forecast(model, alone, 5).collect()}
        for method, steps in found.items():
            ours = {s: v for (_, o, m, s), (_, v) in one.items() if (o, m) == (origin, method)}
            assert ours == pytest.approx(steps, rel=1e-6)


def test_backtest_scores_and_gaps(make_panel):
    days = [100.0 + i for i in range(20)] + [None, None] + [200.0] * 10
    rows = make_panel({"gap": days, "late": [None] * 25 + [5.0] * 7, "x@y": [7.0] * 32})
    found = {(r.entity_value, r.origin, r.method): r for r in replay.backtest(rows, ["2024-01-22"], 5, methods=("naive", "exp_smoothing"), params=(0.2, 0.0, 0.0)).collect()}
    # nothing is known of "late" by then, and the two unknown days aren't scored
    assert set(found) == {(e, "2024-01-22", m) for e in ("gap", "x@y") for m in ("naive", "exp_smoothing")}
    gap = found["gap", "2024-01-22", "naive"]
    assert (gap.scored_days, gap.mae) == (3, 81.0)
    assert found["x@y", "2024-01-22", "naive"].wape == 0.0
    with pytest.raises(ValueError):
        replay.backtest(rows, ["2024-01-22"], methods=("magic",))
    with pytest.raises(ValueError):
        replay.backtest(rows, [])
    assert replay.backtest_points(make_panel({"a": [1.0, 2.0]}), ["2024-01-02"], methods=("boosted_trees",)).collect() == []


def test_fit_works_for_all_series_and_starts_together(monkeypatch):
    """What depends on weights and days alone is worked out once, not once for each series; series of any length go together."""
    rng = np.random.default_rng(8)
    series = [rng.gamma(2.0, 50.0, n) for n in (39, 21, 34, 25, 39, 30, 28, 24, 31, 32)]
    factored = []
    pinv = np.linalg.pinv
    monkeypatch.setattr(np.linalg, "pinv", lambda a, *more, **named: factored.append(len(a)) or pinv(a, *more, **named))
    smoothing.fit_many(series * 10, True)
    assert sum(factored) <= len(smoothing._starts(True)) * len({len(s) for s in series})
    monkeypatch.undo()
    together = smoothing.fit_many(series, True)
    for i, values in enumerate(series):
        for one, many in zip(smoothing.fit(values, True), together):
            np.testing.assert_allclose(many[i], one, rtol=1e-7, atol=1e-7)


def test_forecast_of_short_series_fits_each_once(make_panel, monkeypatch):
    fitted = []
    states_at = smoothing.states_at
    monkeypatch.setattr(smoothing, "states_at", lambda series, stops, fixed=None: fitted.extend(stops) or states_at(series, stops, fixed))
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(30)]
    costs = np.random.default_rng(4).gamma(2.0, 50.0, 30)
    held = [(("d", "service", "a"), days, costs)]
    both = [row for row in forecast._smoothed(held, 5, None, True) if row[4] == "forecast"]
    alone = forecast._smoothed(held, 5, None, False)
    assert [len(own) for own in fitted] == [2, 1]
    assert [row[:7] for row in alone] == [row[:7] for row in both]
    assert [row[8] for row in alone] == pytest.approx([row[8] for row in both])
    points = forecast.forecast_panel(make_panel({"a": costs.tolist()}), 5).orderBy("step").collect()
    assert [r.yhat for r in points] == pytest.approx([row[8] for row in alone])


def test_fit_is_spread_over_all_partitions(spark, make_panel):
    """Also where a key is a literal, as in a panel of one entity type."""
    panel = make_panel({f"e{i}": wave(20) for i in range(6)}).withColumn("entity_type", F.lit("resource"))
    fitted = forecast.holt_winters(panel, 3)
    assert fitted.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert fitted.where("kind = 'forecast'").count() == 18
