"""Window helpers for daily series in long form.

"Previous k" always means the k previous rows: missing days are not filled.
All helpers share one partitioning, so stacking them costs one exchange.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What identifies a series in a panel.
SERIES = ("dataset_id", "entity_type", "entity_value")

#: Residuals below this share of the value are rounding noise and count as 0.
NOISE = 1e-12


def by_day(keys: Sequence[str] = SERIES, order: str = "day"):
    return Window.partitionBy(*keys).orderBy(order)


def whole(keys: Sequence[str] = SERIES):
    return Window.partitionBy(*keys)


def rolling(
    func, value: str, first: int, last: int, need: int, keys: Sequence[str] = SERIES
) -> Column:
    """``func`` over rows first..last; NULL until ``need`` values are in the frame."""
    frame = by_day(keys).rowsBetween(first, last)
    return F.when(F.count(value).over(frame) >= need, func(value).over(frame))


def _decayed_sums(
    df: DataFrame, terms: dict[str, tuple[Column, float]], keys: Sequence[str], row: str
) -> DataFrame:
    """Add ``out[t] = term[t] + decay * out[t-1]`` for every ``out: (term, decay)``.

    Written as a running sum of ``term * decay**-i`` scaled back by
    ``decay**i``, so one pass over sorted rows is enough.  Rows are numbered in
    blocks short enough that the scale stays below 1e100; older blocks reach
    a row only through the end value of the block before it.
    """
    block = max(1, int(100 * math.log(10) / -math.log(min(d for _, d in terms.values()))))
    position = (F.col(row) - 1) % block
    blocked = df.withColumns({"_block": F.floor((F.col(row) - 1) / block), "_i": position})
    in_block = (
        Window.partitionBy(*keys, "_block").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    )
    earlier = (
        Window.partitionBy(*keys).orderBy("_block", "_i").rowsBetween(Window.unboundedPreceding, -1)
    )
    local = blocked.withColumns(
        {
            f"_{out}": F.coalesce(
                F.sum(term * F.pow(F.lit(1 / decay), F.col("_i"))).over(in_block)
                * F.pow(F.lit(decay), F.col("_i")),
                F.lit(0.0),
            )
            for out, (term, decay) in terms.items()
        }
    )
    block_end = F.col("_i") == block - 1
    carried = local.withColumns(
        {
            f"_{out}_end": F.last(F.when(block_end, F.col(f"_{out}")), ignorenulls=True).over(earlier)
            for out in terms
        }
    )
    return carried.withColumns(
        {
            out: F.col(f"_{out}")
            + F.coalesce(F.col(f"_{out}_end") * F.pow(F.lit(decay), F.col("_i") + 1), F.lit(0.0))
            for out, (_, decay) in terms.items()
        }
    ).drop("_i", "_block", *[f"_{n}" for n in terms], *[f"_{n}_end" for n in terms])


def with_ewm_mean(
    df: DataFrame, value: str, out: str, span: float, keys: Sequence[str] = SERIES, order: str = "day"
) -> DataFrame:
    """Exponentially weighted mean with adjusted weights ``(1 - 2/(span+1))**age``.

    Values are taken relative to the first one of the series, which keeps a
    flat series exactly flat.
    """
    decay = 1 - 2 / (span + 1)
    w = by_day(keys, order)
    based = df.withColumns(
        {
            "_rn": F.row_number().over(w),
            "_base": F.first(value, ignorenulls=True).over(
                w.rowsBetween(Window.unboundedPreceding, 0)
            ),
        }
    )
    offset = F.col(value) - F.col("_base")
    one = F.when(F.col(value).isNotNull(), F.lit(1.0))
    summed = _decayed_sums(based, {"_num": (offset, decay), "_den": (one, decay)}, keys, "_rn")
    return summed.withColumn(
        out, F.when(F.col("_den") > 0, F.col("_base") + F.col("_num") / F.col("_den"))
    ).drop("_rn", "_base", "_num", "_den")


def with_ewm_std(
    df: DataFrame, value: str, out: str, span: float, keys: Sequence[str] = SERIES, order: str = "day"
) -> DataFrame:
    """Bias-corrected exponentially weighted standard deviation, NULL until two values.

    The weighted sum of squares follows ``S[t] = decay * S[t-1] + d[t]**2 * (W[t]-1) / W[t]``
    with ``d`` the distance from the previous weighted mean and ``W`` the weight sum,
    so nothing is subtracted and a constant series gives exactly 0.
    """
    decay = 1 - 2 / (span + 1)
    w = by_day(keys, order)
    known = F.col(value).isNotNull()
    one = F.when(known, F.lit(1.0))
    weights = _decayed_sums(
        df.withColumn("_rn", F.row_number().over(w)),
        {"_num": (F.col(value), decay), "_w": (one, decay), "_w2": (one, decay * decay)},
        keys,
        "_rn",
    )
    mean = F.when(F.col("_w") > 0, F.col("_num") / F.col("_w"))
    spread = weights.withColumns(
        {
            "_prior": F.lag(mean).over(w),
            "_seen": F.count(value).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    distance = F.col(value) - F.col("_prior")
    term = F.when(known, distance * distance * (F.col("_w") - 1) / F.col("_w"))
    total = _decayed_sums(spread, {"_s": (term, decay)}, keys, "_rn")
    square = F.col("_w") * F.col("_w")
    variance = F.col("_s") / F.col("_w") * square / (square - F.col("_w2"))
    return total.withColumn(out, F.when(F.col("_seen") > 1, F.sqrt(variance))).drop(
        "_rn", "_num", "_w", "_w2", "_prior", "_seen", "_s"
    )


def with_median_mad(
    df: DataFrame, value: str, median: str, mad: str, keys: Sequence[str] = SERIES
) -> DataFrame:
    """Exact median of each series and median distance from it."""
    return df.withColumn(median, F.median(value).over(whole(keys))).withColumn(
        mad, F.median(F.abs(F.col(value) - F.col(median))).over(whole(keys))
    )
