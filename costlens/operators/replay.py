"""Extension: historical replay, rolling-origin backtests, detector evaluation."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import series as S
from ..functions import trees
from . import forecast

_KEYS = list(S.SERIES)


def as_of(billing: DataFrame, instant: str) -> DataFrame:
    """Only the charges known at an instant; run any operator on the result."""
    return billing.where(F.col("charge_period_start") <= F.lit(instant).cast("timestamp_ntz"))


def replay(panel: DataFrame, origins: Sequence[str]) -> DataFrame:
    """The panel as it stood at each origin day.

    Every origin becomes a dataset of its own, ``<dataset>@<origin>``, so panel operators
    run on all origins at once without knowing about them.
    """
    days = F.array(*[F.lit(o).cast("date") for o in origins])
    known = F.filter(days, lambda origin: origin >= F.col("day"))
    return panel.withColumn("origin", F.explode(known)).withColumn(
        "dataset_id", F.concat("dataset_id", F.lit("@"), F.col("origin").cast("string"))
    )


def standing_at(panel: DataFrame, origins: Sequence[str]) -> DataFrame:
    """One row per series and origin: what the known days up to the origin say, ``n, last_day, last, average, history``.

    ``average`` covers the last seven days and ``history`` the last 29, oldest first.  A row of the
    panel serves the origins between its day and the next one, so nothing is copied for each origin before that is known.
    """
    order = S.by_day()
    days = F.array(*[F.lit(o).cast("date") for o in origins])
    following = F.lead("day").over(order)
    seen = forecast._known(panel).select(
        *_KEYS,
        "day",
        F.row_number().over(order).alias("n"),
        F.col("day").alias("last_day"),
        F.col("cost").alias("last"),
        F.avg("cost").over(order.rowsBetween(1 - forecast.AVERAGE_WINDOW, 0)).alias("average"),
        F.collect_list("cost").over(order.rowsBetween(1 - forecast.HISTORY, 0)).alias("history"),
        following.alias("following"),
    )
    serves = F.filter(days, lambda o: (o >= F.col("day")) & (F.col("following").isNull() | (o < F.col("following"))))
    return seen.withColumn("origin", F.explode(serves)).drop("day", "following")


def backtest_points(
    panel: DataFrame,
    origins: Sequence[str],
    horizon: int = forecast.HORIZON,
    *,
    methods: Sequence[str] = forecast.COMPLEXITY,
    params: Sequence[float] | None = None,
    model: forecast.Model | None = None,
    **tree_options,
) -> DataFrame:
    """``(series keys, origin, method, step, day, yhat)``: what each method would have said on each origin day.

    Only days up to an origin enter its forecast, its smoothing weights and its trees.  ``params`` gives the smoothing
    weights and ``model`` the trees; otherwise one boosted model is trained for each origin, on the training rows
    among the days before it.  A method that a series is too short for by then gives no rows.
    """
    unknown = set(methods) - set(forecast.COMPLEXITY)
    if unknown or not methods or not origins:
        raise ValueError(f"unknown methods {sorted(unknown)}" if unknown else "no methods or no origins")
    columns = [*_KEYS, "origin", "method", "step", "day", "yhat"]
    # a series' last row before an origin is where every method but smoothing starts
    state = standing_at(panel, origins)
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon)))
    parts = []
    for method, value, least in ((forecast.NAIVE, "last", 1), (forecast.AVERAGE, "average", forecast.AVERAGE_WINDOW)):
        if method in methods:
            level = state.where(F.col("n") >= least).select(*_KEYS, "origin", "last_day", F.col(value).alias("yhat"), steps.alias("step"))
            parts.append(level.withColumns({"method": F.lit(method), "day": F.date_add("last_day", F.col("step"))}))
    if forecast.SMOOTHING in methods:
        parts.append(forecast.smoothing_from(panel, origins, horizon, params).withColumn("method", F.lit(forecast.SMOOTHING)))
    if forecast.BOOSTED in methods:
        ready = state.where(F.col("n") >= forecast.BOOSTED_MIN_ROWS + 1)
        for some, trained in _models(panel, origins, model, tree_options):
            parts.append(
                forecast.rolled_forward(trained, ready.where(F.col("origin").isin(some)), horizon).withColumn("method", F.lit(forecast.BOOSTED))
            )
    if not parts:  # no origin has anything to train on
        return forecast.rolled_forward(trees.Ensemble(()), state.limit(0), 1).withColumn("method", F.lit(forecast.BOOSTED)).select(*columns)
    points = parts[0].select(*columns)
    for part in parts[1:]:
        points = points.unionByName(part.select(*columns))
    return points


def _models(panel: DataFrame, origins: Sequence[str], model: forecast.Model | None, tree_options: dict):
    """The trees to use at some origins: the given ones at all, or a model for each with something to learn from."""
    days = [dt.date.fromisoformat(o) for o in origins]
    if model is not None:
        yield days, model
        return
    for day in days:
        rows = forecast.modelled_rows(forecast._known(panel).where(F.col("day") <= F.lit(day)))
        if not rows.where(F.col("split") == "train").isEmpty():
            yield [day], forecast.fit_boosted(rows, **tree_options)


def backtest(panel: DataFrame, origins: Sequence[str], horizon: int = forecast.HORIZON, **options) -> DataFrame:
    """Errors of each method over the days after each origin; options as for ``backtest_points``.

    A forecast day without charges has no actual value and is not scored.
    """
    actual = forecast._known(panel).select(*_KEYS, "day", F.col("cost").alias("actual"))
    scored = backtest_points(panel, origins, horizon, **options).join(actual, [*_KEYS, "day"])
    error = F.col("yhat") - F.col("actual")
    return scored.groupBy(*_KEYS, F.col("origin").cast("string").alias("origin"), "method").agg(
        F.count(F.lit(1)).alias("scored_days"),
        F.avg(F.abs(error)).alias("mae"),
        (F.sum(F.abs(error)) / F.nullif(F.sum(F.abs("actual")), F.lit(0.0))).alias("wape"),
        F.avg(error).alias("bias"),
    )


def evaluate_detections(detections: DataFrame, labels: DataFrame, tolerance: int = 0) -> DataFrame:
    """Precision, recall and mean delay in days against labelled spikes.

    A spike is found by a detection of its series on its day or up to ``tolerance``
    days later.  Labels are spread over those days, so both sides meet by equality.
    """
    spread = labels.select(
        *_KEYS,
        F.col("day").alias("label_day"),
        F.explode(F.sequence(F.lit(0), F.lit(tolerance))).alias("delay"),
    ).withColumn("day", F.date_add("label_day", F.col("delay")))
    found = detections.select(*_KEYS, "day").distinct()
    by_label = (
        spread.join(found.withColumn("hit", F.lit(1)), [*_KEYS, "day"], "left")
        .groupBy(*_KEYS, "label_day")
        .agg(F.min(F.when(F.col("hit") == 1, F.col("delay"))).alias("delay"))
        .groupBy("dataset_id")
        .agg(
            F.count(F.lit(1)).alias("labelled"),
            F.count("delay").alias("found_labels"),
            F.avg("delay").alias("mean_delay_days"),
        )
    )
    covered = spread.select(*_KEYS, "day", F.lit(1).alias("hit")).distinct()
    by_detection = (
        found.join(covered, [*_KEYS, "day"], "left")
        .groupBy("dataset_id")
        .agg(F.count(F.lit(1)).alias("detected"), F.count("hit").alias("true_detections"))
    )
    return by_label.join(by_detection, "dataset_id", "full").withColumns(
        {
            "precision": F.col("true_detections") / F.col("detected"),
            "recall": F.col("found_labels") / F.col("labelled"),
        }
    )
