"""Forecasts over the daily panel, with strictly temporal hold-outs.

Every method returns its forecast as ``(series keys, method, step, day, yhat)`` and
its hold-out rows as ``(series keys, method, day, actual, predicted)``.
"""

from __future__ import annotations

import bisect
import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series as S
from ..functions import smoothing, trees
from ..session import shared_folder
from .filters import for_entity
from .panel import TOTAL, TOTAL_VALUE, daily_series, with_length

# The fit travels with the task, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(smoothing)

NAIVE, AVERAGE, SMOOTHING, BOOSTED = "naive", "moving_average", "exp_smoothing", "boosted_trees"

# Horizon, window, lengths at which a method becomes available, split shares.
HORIZON = 30
AVERAGE_WINDOW = 7
MIN_ROWS = 5
SMOOTHING_MIN_ROWS = 10
BOOSTED_MIN_ROWS, BOOSTED_MIN_CLEAN = 28, 10
HOLDOUT_SHARE, TRAIN_SHARE = 0.8, 0.6

# Model versions and seed.
SEED = 42
VERSIONS = {
    NAIVE: "naive-v1",
    AVERAGE: "ma-7d-v1",
    SMOOTHING: "holtwinters-v1",
    BOOSTED: "gbt-panel-v1",
}
#: Simpler methods first; the simpler one wins a tie.
COMPLEXITY = (NAIVE, AVERAGE, SMOOTHING, BOOSTED)

# Model features.
LAGS = (1, 7, 14, 28)
FEATURES = (
    "lag_1",
    "lag_7",
    "lag_14",
    "lag_28",
    "rolling_mean_7",
    "rolling_mean_14",
    "rolling_std_7",
    "day_of_week",
    "day_of_month",
    "week_of_year",
    "month",
    "growth_7d",
    "growth_28d",
)
HISTORY = 29  # rows the widest feature looks back

_KEYS = list(S.SERIES)

Model = GBTRegressionModel | trees.Ensemble


# --- metrics ---------------------------------------------------------------


def metrics(holdout: DataFrame) -> DataFrame:
    """MAE, RMSE, WAPE and bias (mean of predicted minus actual) per series and method.

    WAPE is infinite where the actual values sum to 0.
    """
    error = F.col("predicted") - F.col("actual")
    size = F.sum(F.abs("actual"))
    return holdout.groupBy(*_KEYS, "method").agg(
        F.count(F.lit(1)).alias("holdout_rows"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.when(size > 0, F.sum(F.abs(error)) / size)
        .otherwise(F.lit(float("inf")))
        .alias("wape"),
        F.avg(error).alias("bias"),
    )


def _steps(last: DataFrame, method: str, horizon: int) -> DataFrame:
    """Repeat one value per series over the horizon."""
    return last.select(
        *_KEYS, F.lit(method).alias("method"), "last_day", "yhat", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")
    ).select(*_KEYS, "method", "step", F.date_add("last_day", F.col("step")).alias("day"), "yhat")


def _indexed(panel: DataFrame) -> DataFrame:
    return panel.withColumns(
        {
            "position": F.row_number().over(S.by_day()) - 1,
            "n": F.count(F.lit(1)).over(S.whole()),
        }
    )


# --- naive and moving average ----------------------------------------------


def naive(panel: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """The last known value, repeated."""
    last = _known(panel).groupBy(*_KEYS).agg(
        F.max("day").alias("last_day"), F.max_by("cost", "day").alias("yhat")
    )
    return _steps(last, NAIVE, horizon)


def naive_holdout(panel: DataFrame) -> DataFrame:
    """The last fifth of a series against the value before it; needs five rows."""
    split = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("n") * HOLDOUT_SHARE))
    cut = _indexed(panel).withColumn("split", split).where(F.col("n") >= MIN_ROWS)
    before = F.max(F.when(F.col("position") == F.col("split") - 1, F.col("cost"))).over(S.whole())
    return (
        cut.withColumn("predicted", before)
        .where(F.col("position") >= F.col("split"))
        .select(*_KEYS, F.lit(NAIVE).alias("method"), "day", F.col("cost").alias("actual"), "predicted")
    )


def moving_average(
    panel: DataFrame, horizon: int = HORIZON, window: int = AVERAGE_WINDOW
) -> DataFrame:
    """Mean of the last rows, repeated; a series shorter than the window is left out."""
    newest = S.by_day().rowsBetween(1 - window, 0)
    last = (
        _indexed(panel)
        .withColumn("yhat", F.avg("cost").over(newest))
        .where((F.col("position") == F.col("n") - 1) & (F.col("n") >= window))
        .withColumn("last_day", F.col("day"))
    )
    return _steps(last, AVERAGE, horizon)


def moving_average_holdout(panel: DataFrame, window: int = AVERAGE_WINDOW) -> DataFrame:
    """Each row of the last fifth against the mean of the rows before it."""
    split = F.greatest(F.lit(window).cast("bigint"), F.floor(F.col("n") * HOLDOUT_SHARE))
    earlier = S.by_day().rowsBetween(-window, -1)
    return (
        _indexed(panel)
        .withColumn("predicted", F.avg("cost").over(earlier))
        .where((F.col("n") >= window + 2) & (F.col("position") >= split))
        .select(*_KEYS, F.lit(AVERAGE).alias("method"), "day", F.col("cost").alias("actual"), "predicted")
    )


# --- exponential smoothing -------------------------------------------------


_SMOOTHING_SCHEMA = (
    "dataset_id string, entity_type string, entity_value string, method string, "
    "kind string, step int, day date, actual double, yhat double, alpha double, beta double, gamma double"
)


_ORIGIN_SCHEMA = "dataset_id string, entity_type string, entity_value string, origin date, step int, day date, yhat double"


#: Series that a task fits together.
FIT_BATCH = 512


def _known(panel: DataFrame) -> DataFrame:
    """Days whose cost is known; a day on which no charge could be read has none."""
    return panel.where(F.col("cost").isNotNull())


def _smoothed(series: list[tuple], horizon: int, fixed: np.ndarray | None, holdout: bool) -> list[tuple]:
    """Forecast and, if asked for, hold-out rows of ``(keys, days, values)``, all series fitted together.

    A series whose fit fails is forecast by the mean of its last days; a fit of its first days that fails is one of all days that does.
    """
    splits = [smoothing.training_rows(len(y)) for _, _, y in series]
    if not holdout:
        splits = [(len(y), season) for (_, _, y), (_, season) in zip(series, splits)]
    found = smoothing.states_at(
        [y for _, _, y in series],
        [((split, season), (len(y), season))[not holdout :] for (_, _, y), (split, season) in zip(series, splits)],
        fixed,
    )
    out = []
    for (keys, days, y), (split, season), states in zip(series, splits, found):
        (held_params, held_ends), (params, ends) = states[0], states[-1]
        fitted = bool(np.isfinite(held_ends).all() and np.isfinite(ends).all())
        if fitted:
            method = SMOOTHING
            ahead = smoothing.project(held_ends, split, len(y) - split, season)
            future = smoothing.project(ends, len(y), horizon, season)
        else:
            method, held_params, params = AVERAGE, [None] * 3, [None] * 3
            before = np.concatenate([[0.0], np.cumsum(y)])
            at = np.arange(split, len(y))
            low = np.maximum(at - AVERAGE_WINDOW, 0)
            ahead = (before[at] - before[low]) / (at - low)
            future = np.full(horizon, y[-AVERAGE_WINDOW:].mean())
        out += [(*keys, method, "holdout", i + 1, days[split + i], float(y[split + i]), float(v), *held_params) for i, v in enumerate(ahead)]
        out += [
            (*keys, method, "forecast", i + 1, days[-1] + dt.timedelta(days=i + 1), None, max(float(v), 0.0), *params)
            for i, v in enumerate(future)
        ]
    return out


def _smoothed_at(series: list[tuple], horizon: int, fixed: np.ndarray | None, origins: Sequence[dt.date]) -> list[tuple]:
    """Forecast rows from each origin, made of the days up to it; a fit that fails gives none."""
    known = [[bisect.bisect_right(days, origin) for origin in origins] for _, days, _ in series]
    long_enough = [[(i, n) for i, n in enumerate(own) if n >= SMOOTHING_MIN_ROWS] for own in known]
    stops = [[(n, smoothing.training_rows(n)[1]) for _, n in own] for own in long_enough]
    found = smoothing.states_at([y for _, _, y in series], stops, fixed)
    out = []
    for (keys, days, _), own, pairs, states in zip(series, long_enough, stops, found):
        for (i, _), (n, season), (_, ends) in zip(own, pairs, states):
            if np.isfinite(ends).all():
                for step, value in enumerate(smoothing.project(ends, n, horizon, season), 1):
                    out.append((*keys, origins[i], step, days[n - 1] + dt.timedelta(days=step), max(float(value), 0.0)))
    return out


def _by_series(panel: DataFrame, batch: int, make, schema: str) -> DataFrame:
    """``make`` of lists of ``(keys, days, values)``, ``batch`` series at a time.

    Series are spread over the cluster by key and sorted.  Fitting costs time, not space: they keep all
    partitions, where adaptive execution would pack such small data into one or two tasks.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def batches(rows):
        held: list[tuple] = []
        at, days, values = None, [], []

        def made() -> pd.DataFrame:
            return pd.DataFrame(make(held), columns=names)

        for part in rows:
            for *keys, day, cost in part.itertuples(index=False, name=None):
                if tuple(keys) != at:
                    if days:
                        held.append((at, days, np.array(values, float)))
                    if len(held) >= batch:
                        yield made()
                        held.clear()
                    at, days, values = tuple(keys), [], []
                days.append(day)
                values.append(cost)
        if days:
            held.append((at, days, np.array(values, float)))
        if held:
            yield made()

    tasks = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long_enough = (
        with_length(_known(panel))
        .where(F.col("n") >= SMOOTHING_MIN_ROWS)
        .select(*_KEYS, "day", "cost")
        .repartition(tasks, *_KEYS)  # last: the count of a key that is a literal asks for another partitioning, which may be packed
        .sortWithinPartitions(*_KEYS, "day")
    )
    return long_enough.mapInPandas(batches, schema)


def holt_winters(
    panel: DataFrame, horizon: int = HORIZON, params: Sequence[float] | None = None, batch: int = FIT_BATCH, holdout: bool = True
) -> DataFrame:
    """Additive trend with a weekly additive pattern, fitted per series.

    One row per hold-out day (``kind = holdout``, fitted on the first 80 %) and per
    forecast day (``kind = forecast``, fitted on everything, never below 0).  The weekly
    pattern needs 21 training rows.  Series under ten rows are left out; days without a known
    cost do not count.  ``params`` (alpha, beta, gamma) skips the fit and starts from the first weeks.

    Without ``holdout`` there are no hold-out rows, and no fit for them: half of the work.  A task fits ``batch`` series at a
    time, so it holds that many lifetimes of days at once.
    """
    fixed = None if params is None else np.asarray(params, float)
    return _by_series(panel, batch, lambda held: _smoothed(held, horizon, fixed, holdout), _SMOOTHING_SCHEMA)


def smoothing_from(
    panel: DataFrame,
    origins: Sequence[str],
    horizon: int = HORIZON,
    params: Sequence[float] | None = None,
    batch: int = FIT_BATCH,
) -> DataFrame:
    """``(series keys, origin, step, day, yhat)``: smoothing as it would have been made at each origin day.

    Steps count from the last known day up to the origin; a series with fewer than ten known days by then has none.
    For given ``params`` a series is run once and its state kept at every origin; otherwise the weights of
    an origin are fitted on the days up to it.
    """
    fixed = None if params is None else np.asarray(params, float)
    days = [dt.date.fromisoformat(origin) for origin in origins]
    return _by_series(panel, batch, lambda held: _smoothed_at(held, horizon, fixed, days), _ORIGIN_SCHEMA)


def smoothing_holdout(fitted: DataFrame) -> DataFrame:
    return fitted.where(F.col("kind") == "holdout").select(
        *_KEYS, "method", "day", "actual", F.col("yhat").alias("predicted")
    )


def smoothing_forecast(fitted: DataFrame) -> DataFrame:
    return fitted.where(F.col("kind") == "forecast").select(*_KEYS, "method", "step", "day", "yhat")


# --- boosted trees ---------------------------------------------------------


def features(panel: DataFrame, *, keep_incomplete: bool = False) -> DataFrame:
    """Lags, lagged rolling statistics, growth and calendar parts of each row.

    Every feature but the calendar ones looks only at earlier rows.
    """
    w = S.by_day()
    lagged = {f"lag_{k}": F.lag("cost", k).over(w) for k in LAGS}
    growth = {
        f"growth_{k}d": F.lag("cost", 1).over(w) / F.nullif(F.lag("cost", 1 + k).over(w), F.lit(0.0)) - 1
        for k in (7, 28)
    }
    built = panel.withColumns(
        {
            **lagged,
            "rolling_mean_7": S.rolling(F.avg, "cost", -7, -1, 7),
            "rolling_mean_14": S.rolling(F.avg, "cost", -14, -1, 14),
            "rolling_std_7": S.rolling(F.stddev_samp, "cost", -7, -1, 7),
            **growth,
            **_calendar(F.col("day")),
        }
    )
    return built if keep_incomplete else built.na.drop(subset=["cost", *FEATURES])


def _calendar(day):
    return {
        "day_of_week": F.weekday(day),
        "day_of_month": F.dayofmonth(day),
        "week_of_year": F.weekofyear(day),
        "month": F.month(day),
    }


def temporal_split(feature_rows: DataFrame) -> DataFrame:
    """Mark the rows of each series train, val or test, 60/20/20 in time order.

    ``n_clean`` tells whether a series has enough complete rows to be modelled.
    """
    w = S.by_day()
    counted = feature_rows.withColumns(
        {
            "position": F.row_number().over(w) - 1,
            "n_clean": F.count(F.lit(1)).over(S.whole()),
        }
    )
    train_end = F.floor(F.col("n_clean") * TRAIN_SHARE)
    val_end = F.floor(F.col("n_clean") * HOLDOUT_SHARE)
    return counted.withColumn(
        "split",
        F.when(F.col("position") < train_end, "train").when(F.col("position") < val_end, "val").otherwise("test"),
    )


def modelled_rows(panel: DataFrame) -> DataFrame:
    """Feature rows of the series long enough for a model, with their split."""
    long_enough = with_length(panel).where(F.col("n") >= BOOSTED_MIN_ROWS)
    return temporal_split(features(long_enough)).where(F.col("n_clean") >= BOOSTED_MIN_CLEAN)


def _vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


def fit_boosted(
    split_rows: DataFrame, *, max_iter: int = 200, step_size: float = 0.05, max_depth: int = 4
) -> GBTRegressionModel:
    """One model over all series, trained on the training part of each.

    Trees grow on the distributed rows; only split statistics reach the driver.
    """
    shared_folder(split_rows.sparkSession)
    learner = GBTRegressor(
        labelCol="cost",
        featuresCol="features",
        predictionCol="predicted",
        maxIter=max_iter,
        stepSize=step_size,
        maxDepth=max_depth,
        seed=SEED,
        checkpointInterval=10,
    )
    return learner.fit(_vectors(split_rows.where(F.col("split") == "train")))


def boosted_holdout(model: Model, split_rows: DataFrame, part: str = "val") -> DataFrame:
    """Rows of one part against the model's prediction from their features."""
    rows = split_rows.where(F.col("split") == part)
    if isinstance(model, trees.Ensemble):
        listed = F.array(*[F.col(name).cast("double") for name in FEATURES])
        scored = rows.withColumn("_features", listed).withColumn(
            "predicted", F.expr(f"transform(array(_features), f -> {model.sql('f')})[0]")
        )
    else:
        scored = model.transform(_vectors(rows))
    return scored.select(
        *_KEYS, F.lit(BOOSTED).alias("method"), "day", F.col("cost").alias("actual"), "predicted"
    )


def gate_baseline(split_rows: DataFrame) -> DataFrame:
    """Validation rows against the last training value of their series."""
    at = Window.partitionBy(*_KEYS)
    last = F.max_by(
        F.when(F.col("split") == "train", F.col("cost")),
        F.when(F.col("split") == "train", F.col("day")),
    ).over(at)
    return (
        split_rows.withColumn("predicted", last)
        .where(F.col("split") == "val")
        .select(*_KEYS, F.lit(NAIVE).alias("method"), "day", F.col("cost").alias("actual"), "predicted")
    )


def passes_gate(model_metrics: DataFrame, baseline_metrics: DataFrame) -> DataFrame:
    """Series whose model beats the baseline WAPE on the same rows."""
    base = baseline_metrics.select(*_KEYS, F.col("wape").alias("baseline_wape"))
    return model_metrics.join(base, _KEYS).withColumn("passed", F.col("wape") < F.col("baseline_wape"))


def best_method(all_metrics: DataFrame) -> DataFrame:
    """The method with the lowest WAPE per series; the simpler one wins a tie."""
    order = F.array_position(F.array(*[F.lit(m) for m in COMPLEXITY]), F.col("method"))
    return all_metrics.groupBy(*_KEYS).agg(
        F.min(F.struct("wape", order.alias("_order"), "method")).alias("_best")
    ).select(*_KEYS, F.col("_best.method").alias("method"), F.col("_best.wape").alias("wape"))


def boosted_forecast(model: Model, panel: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Step-by-step forecast that feeds each prediction back as history.

    A series travels as one row holding its last 29 values.  The trees are compiled to one
    expression, and the steps are a fold over that row: one stage, whatever the horizon.
    """
    recent = _indexed(_known(panel)).where(
        (F.col("n") >= BOOSTED_MIN_ROWS + 1) & (F.col("position") >= F.col("n") - HISTORY)
    )
    state = recent.groupBy(*_KEYS).agg(
        F.max("day").alias("last_day"),
        F.transform(F.array_sort(F.collect_list(F.struct("day", "cost"))), lambda x: x["cost"]).alias("history"),
    )
    return rolled_forward(model, state, horizon).select(*_KEYS, F.lit(BOOSTED).alias("method"), "step", "day", "yhat")


def rolled_forward(model: Model, state: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Rows of ``state`` (``last_day``, ``history`` of 29 costs, others) once for each step, with ``step, day, yhat``."""
    others = [c for c in state.columns if c != "history"]
    outputs = F.slice(F.expr(_folded(trees.compiled(model), horizon)), HISTORY + 1, horizon)
    return state.select(*others, F.posexplode(outputs).alias("pos", "yhat")).select(
        *others, (F.col("pos") + 1).alias("step"), F.date_add("last_day", F.col("pos") + 1).alias("day"), "yhat"
    )


def _folded(ensemble: trees.Ensemble, horizon: int) -> str:
    """``history`` with the predictions of ``horizon`` steps behind it, each made from all values before it."""
    found = _next_features("past", "date_add(last_day, step)")
    listed = ", ".join(f"CAST({found[name]} AS DOUBLE)" for name in FEATURES)
    return (
        f"aggregate(sequence(1, {int(horizon)}), history, (past, step) -> "
        f"concat(past, transform(array(array({listed})), f -> greatest({ensemble.sql('f')}, 0D))))"
    )


def _next_features(past: str, day: str) -> dict[str, str]:
    """Features of the row after an array of costs, as in ``features``; unknown growth is 0."""

    def back(k: int) -> str:
        return f"element_at({past}, -{k})"

    def mean(k: int) -> str:
        return f"(aggregate(slice({past}, -{k}, {k}), 0D, (a, x) -> a + x) / {k})"

    squares = f"aggregate(slice({past}, -7, 7), 0D, (a, x) -> a + (x - centre) * (x - centre))"
    return {
        **{f"lag_{k}": back(k) for k in LAGS},
        "rolling_mean_7": mean(7),
        "rolling_mean_14": mean(14),
        "rolling_std_7": f"transform(array({mean(7)}), centre -> sqrt({squares} / 6))[0]",
        **{f"growth_{k}d": f"coalesce({back(1)} / nullif({back(1 + k)}, 0D) - 1, 0D)" for k in (7, 28)},
        "day_of_week": f"weekday({day})",
        "day_of_month": f"dayofmonth({day})",
        "week_of_year": f"weekofyear({day})",
        "month": f"month({day})",
    }


# --- choosing a method -----------------------------------------------------


def available_method(n, passed=None):
    """Method by series length: smoothing, else moving average, else naive.

    ``passed`` marks series whose boosted model beat the baseline.
    """
    chain = (
        F.when(n >= SMOOTHING_MIN_ROWS, SMOOTHING).when(n >= AVERAGE_WINDOW, AVERAGE).when(n >= MIN_ROWS, NAIVE)
    )
    return chain if passed is None else F.when(passed, BOOSTED).otherwise(chain)


def chosen_methods(panel: DataFrame, gate: DataFrame | None = None) -> DataFrame:
    """Length and method per series; a series under five rows is ``skipped``.

    Days without a known cost do not count.
    """
    sized = panel.groupBy(*_KEYS).agg(
        F.count("cost").alias("n"),
        F.min(F.when(F.col("cost").isNotNull(), F.col("day"))).alias("first_day"),
        F.max(F.when(F.col("cost").isNotNull(), F.col("day"))).alias("last_day"),
    )
    passed = None
    if gate is not None:
        sized = sized.join(gate.select(*_KEYS, "passed"), _KEYS, "left")
        passed = F.coalesce("passed", F.lit(False))
    method = available_method(F.col("n"), passed)
    return sized.select(
        *_KEYS, "n", "first_day", "last_day", F.coalesce(method, F.lit("skipped")).alias("method")
    )


def _rows(table: DataFrame, kind: str) -> DataFrame:
    """Hold-out or forecast rows in one shape."""
    if kind == "forecast":
        table = table.withColumn("actual", F.lit(None).cast("double"))
    else:
        order = Window.partitionBy(*_KEYS, "method").orderBy("day")
        table = table.withColumn("step", F.row_number().over(order)).withColumnRenamed("predicted", "yhat")
    return table.select(
        *_KEYS, "method", F.lit(kind).alias("kind"), F.col("step").cast("int").alias("step"), "day",
        F.col("actual").cast("double").alias("actual"), F.col("yhat").cast("double").alias("yhat"),
    )


def _tagged(panel: DataFrame, gate: DataFrame | None) -> DataFrame:
    """The known days of each series with the method the series gets."""
    tagged, passed = with_length(_known(panel), "_n"), None
    if gate is not None:
        tagged = tagged.join(gate.select(*_KEYS, "passed"), _KEYS, "left")
        passed = F.coalesce("passed", F.lit(False))
    return tagged.withColumn("_method", available_method(F.col("_n"), passed))


def forecast_rows(
    panel: DataFrame,
    horizon: int = HORIZON,
    *,
    params: Sequence[float] | None = None,
    boosted: Boosted | None = None,
) -> DataFrame:
    """Hold-out and forecast rows (``kind``) of every series by the best method it can have.

    Each series is computed by one method only, and each fit gives both kinds of rows.
    """
    tagged = _tagged(panel, boosted.gate if boosted else None)

    def of(method: str) -> DataFrame:
        return tagged.where(F.col("_method") == method).select(*_KEYS, "day", "cost")

    rows = holt_winters(of(SMOOTHING), horizon, params).select(*_KEYS, "method", "kind", "step", "day", "actual", "yhat")
    for method, ahead, held in ((NAIVE, naive, naive_holdout), (AVERAGE, moving_average, moving_average_holdout)):
        rows = rows.unionByName(_rows(ahead(of(method), horizon), "forecast")).unionByName(_rows(held(of(method)), "holdout"))
    if boosted is not None:
        passed = boosted.gate.where("passed").select(*_KEYS)
        for table, kind in ((boosted.points, "forecast"), (boosted.holdout, "holdout")):
            rows = rows.unionByName(_rows(table.join(passed, _KEYS, "left_semi"), kind))
    return rows


@dataclass(frozen=True)
class Boosted:
    """A fitted boosted model: its gate, forecast, validation rows, baseline rows, and the days it saw."""

    gate: DataFrame
    points: DataFrame
    holdout: DataFrame
    baseline: DataFrame
    bounds: DataFrame
    trees: int


def boosted_chain(
    panel: DataFrame, horizon: int = HORIZON, *, model: Model | None = None, **tree_options
) -> Boosted | None:
    """Fit the boosted model (unless given), gate it, and forecast the series that pass; None if no series is long enough."""
    known = _known(panel)
    parts = modelled_rows(known)
    if parts.where(F.col("split") == "train").isEmpty():
        return None
    if model is None:
        model = fit_boosted(parts, **tree_options)
    holdout, baseline = boosted_holdout(model, parts), gate_baseline(parts)
    gate = passes_gate(metrics(holdout), metrics(baseline))
    passed = known.join(gate.where("passed").select(*_KEYS), _KEYS, "left_semi")
    return Boosted(
        gate, boosted_forecast(model, passed, horizon), holdout, baseline, split_bounds(parts), len(trees.compiled(model))
    )


def split_bounds(split_rows: DataFrame) -> DataFrame:
    """First and last day of the training and validation rows of each series."""

    def day(part: str, pick):
        return pick(F.when(F.col("split") == part, F.col("day")))

    return split_rows.groupBy(*_KEYS).agg(
        day("train", F.min).alias("training_start"),
        day("train", F.max).alias("training_end"),
        day("val", F.min).alias("validation_start"),
        day("val", F.max).alias("validation_end"),
    )


def forecast_result(
    panel: DataFrame,
    horizon: int = HORIZON,
    *,
    params: Sequence[float] | None = None,
    use_boosted: bool = False,
    boosted: Boosted | None = None,
    **tree_options,
) -> DataFrame:
    """One row per series: method, points, hold-out metrics, naive baseline, and what it was trained on.

    The chain is boosted trees where they beat the naive forecast (if ``use_boosted``, or given as
    ``boosted``), else smoothing, moving average, naive, by length; a failed smoothing fit falls to the average.
    Series too short for any are left out; ``skipped`` lists them.
    """
    if use_boosted and boosted is None:
        boosted = boosted_chain(panel, horizon, **tree_options)
    held, error = F.col("kind") == "holdout", F.col("yhat") - F.col("actual")
    size = F.sum(F.when(held, F.abs("actual")))
    point = F.when(~held, F.struct("step", "day", "yhat"))
    found = forecast_rows(panel, horizon, params=params, boosted=boosted).groupBy(*_KEYS, "method").agg(
        F.array_sort(F.collect_list(point)).alias("points"),
        F.count_if(held).alias("holdout_rows"),
        F.avg(F.when(held, F.abs(error))).alias("mae"),
        F.sqrt(F.avg(F.when(held, error * error))).alias("rmse"),
        F.when(size > 0, F.sum(F.when(held, F.abs(error))) / size)
        .when(F.count_if(held) > 0, F.lit(float("inf")))
        .alias("wape"),
        F.avg(F.when(held, error)).alias("bias"),
    )
    names = ("mae", "rmse", "wape", "bias")
    base = metrics(naive_holdout(_known(panel))).select(*_KEYS, *[F.col(n).alias(f"baseline_{n}") for n in names])
    if boosted is not None:
        # a model is measured against the naive forecast of its own validation rows
        own = metrics(boosted.baseline).select(*_KEYS, *[F.col(n).alias(f"own_{n}") for n in names])
        base = base.join(own, _KEYS, "left").join(boosted.gate.select(*_KEYS, "passed"), _KEYS, "left").select(
            *_KEYS, *[F.when(F.col("passed"), F.col(f"own_{n}")).otherwise(F.col(f"baseline_{n}")).alias(f"baseline_{n}") for n in names]
        )
    about = metadata(panel, horizon, boosted.gate if boosted else None, boosted).drop("method", "model_version")
    version = F.create_map(*[F.lit(x) for pair in VERSIONS.items() for x in pair])[F.col("method")]
    return found.join(base, _KEYS, "left").join(about, _KEYS, "left").withColumn("model_version", version)


def forecast_panel(
    panel: DataFrame,
    horizon: int = HORIZON,
    *,
    params: Sequence[float] | None = None,
    boosted: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Forecast of every series by the best method its length allows.

    ``boosted`` is (gate from ``passes_gate``, forecast from ``boosted_forecast``).
    Each series is computed by one method only.
    """
    gate, extra = boosted if boosted else (None, None)
    tagged = _tagged(panel, gate)

    def of(method: str) -> DataFrame:
        return tagged.where(F.col("_method") == method).select(*_KEYS, "day", "cost")

    points = naive(of(NAIVE), horizon).unionByName(moving_average(of(AVERAGE), horizon))
    points = points.unionByName(smoothing_forecast(holt_winters(of(SMOOTHING), horizon, params, holdout=False)))
    if extra is not None:
        points = points.unionByName(extra.join(gate.where("passed"), _KEYS, "left_semi"))
    return points


def forecast_entity(
    billing: DataFrame, entity_type: str, entity_value: str, horizon: int = HORIZON
) -> DataFrame:
    """Forecast of one entity of each dataset; only its charges are read."""
    return forecast_panel(daily_series(for_entity(billing, entity_type, entity_value), (entity_type,)), horizon)


def forecast_total(billing: DataFrame, horizon: int = HORIZON) -> DataFrame:
    return forecast_entity(billing, TOTAL, TOTAL_VALUE, horizon)


def entity_result(
    billing: DataFrame, entity_type: str, entity_value: str, horizon: int = HORIZON, **options
) -> DataFrame:
    """``forecast_result`` of one entity of each dataset; ``total`` and ``all`` for the whole dataset."""
    return forecast_result(daily_series(for_entity(billing, entity_type, entity_value), (entity_type,)), horizon, **options)


def skipped(panel: DataFrame) -> DataFrame:
    """Series too short to forecast."""
    return chosen_methods(panel).where(F.col("method") == "skipped").drop("method")


def metadata(
    panel: DataFrame, horizon: int = HORIZON, gate: DataFrame | None = None, boosted: Boosted | None = None
) -> DataFrame:
    """Training period, model version, features and seed of each series' forecast.

    A boosted model is trained on part of a series: ``boosted`` gives the bounds of its training and
    validation rows and the number of trees.
    """
    chosen = chosen_methods(panel, gate).where(F.col("method") != "skipped")
    method = F.col("method")
    nothing = F.lit(None).cast("date")
    first, last, validation = F.col("first_day"), F.col("last_day"), (nothing, nothing)
    if boosted is not None:
        chosen = chosen.join(boosted.bounds, _KEYS, "left")
        by_trees = method == BOOSTED
        first = F.when(by_trees, F.col("training_start")).otherwise(first)
        last = F.when(by_trees, F.col("training_end")).otherwise(last)
        validation = tuple(F.when(by_trees, F.col(f"validation_{x}")) for x in ("start", "end"))
    version = F.lit(None).cast("string")
    for name, label in VERSIONS.items():
        version = F.when(method == name, label).otherwise(version)
    return chosen.select(
        *_KEYS,
        "method",
        version.alias("model_version"),
        F.lit(horizon).alias("forecast_horizon_days"),
        first.alias("training_start"),
        last.alias("training_end"),
        validation[0].alias("validation_start"),
        validation[1].alias("validation_end"),
        F.when(method == AVERAGE, AVERAGE_WINDOW).alias("window"),
        F.when(method == BOOSTED, F.array(*[F.lit(f) for f in FEATURES])).alias("features"),
        F.when(method == BOOSTED, SEED).alias("random_seed"),
        F.when(method == BOOSTED, F.lit(boosted.trees if boosted else None).cast("int")).alias("n_trees"),
    )
