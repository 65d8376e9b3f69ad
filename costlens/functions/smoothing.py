"""Additive Holt-Winters on a batch of series, for use inside a task.

Spark has no built-in for fitting a recursion, so this is the one place where
series become NumPy arrays.  A series has at most one value per calendar day.
All series of a batch go through the days together; nothing is kept for each day.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np

PERIOD = 7

# Share of a series to train on, least training rows, rows a weekly pattern needs.
TRAIN_SHARE, MIN_TRAIN, SEASON_MIN_TRAIN = 0.8, 7, 21

#: Days whose errors are multiplied together.
_BLOCK = 32


def training_rows(n: int) -> tuple[int, bool]:
    """Rows to train on, and whether they carry a weekly pattern."""
    split = max(MIN_TRAIN, int(n * TRAIN_SHARE))
    return split, split >= SEASON_MIN_TRAIN


def _parts(season: bool) -> int:
    return 2 + (PERIOD if season else 0)


def _running(lengths: np.ndarray, days: int) -> list[int]:
    """Rows that have a value on each day; the longest come first."""
    return np.searchsorted(-lengths, -np.arange(days), "left").tolist()


def _pass(
    y: np.ndarray, lengths: np.ndarray, params: np.ndarray, initial: np.ndarray, season: bool, sensitive: bool
) -> tuple[np.ndarray, np.ndarray]:
    """One-step errors and their derivatives, summed up as products, and the final states.

    ``y`` (rows, days), ``params`` (rows, 3), ``initial`` (rows, parts).  Column 0 is the error from the given
    initial state, the next ones its response to a unit change of each part of that state, and with ``sensitive`` the last ones
    its derivatives by the three weights.  The longest rows come first; one that has ended stands still.
    """
    rows, parts = initial.shape
    alpha, beta, gamma = np.ascontiguousarray(params.T)
    columns = 1 + parts + (3 if sensitive else 0)
    # rows lie side by side: each step works on whole rows of numbers
    state = np.zeros((parts, columns, rows))
    state[:, 0] = initial.T
    for part in range(parts):
        state[part, 1 + part] = 1.0
    products = np.zeros((rows, columns, columns))
    errors, spare = np.zeros((_BLOCK, columns, rows)), np.zeros((columns, rows))
    longest = int(lengths[0])
    on = _running(lengths, longest)
    values = np.ascontiguousarray(y.T)
    for t in range(longest):
        at, n = t % _BLOCK, on[t]
        level, trend, seasonal = state[0, :, :n], state[1, :, :n], state[2 + t % PERIOD, :, :n] if season else None
        error, moved = errors[at, :, :n], spare[:, :n]
        errors[at, :, n:] = 0.0
        np.add(level, trend, out=error)
        if season:
            error += seasonal
        error *= -1.0  # NumPy's negation in place goes wrong on a single strided column
        error[0] += values[t, :n]
        level += trend
        level += np.multiply(alpha[:n], error, out=moved)
        trend += np.multiply(beta[:n], error, out=moved)
        if season:
            seasonal += np.multiply(gamma[:n], error, out=moved)
        if sensitive:
            level[-3] += error[0]
            trend[-2] += error[0]
            if season:
                seasonal[-1] += error[0]
        if at == _BLOCK - 1 or t == longest - 1:
            n = on[t - at]
            block = np.ascontiguousarray(errors[: at + 1, :, :n].transpose(2, 0, 1))
            products[:n] += block.transpose(0, 2, 1) @ block
    return products, state.transpose(0, 2, 1)


def _responses(starts: np.ndarray, season: bool, days: int) -> np.ndarray:
    """Response of each day's error to a unit change of each part of the initial state, ``(starts, parts, days)``; no series has a part in it."""
    parts = _parts(season)
    alpha, beta, gamma = starts.T
    state = np.zeros((parts, parts, len(starts)))
    for part in range(parts):
        state[part, part] = 1.0
    out = np.zeros((days, parts, len(starts)))
    for t in range(days):
        error = -(state[0] + state[1])
        if season:
            error -= state[2 + t % PERIOD]
        out[t] = error
        state[0] += state[1] + alpha * error
        state[1] += beta * error
        if season:
            state[2 + t % PERIOD] += gamma * error
    return np.ascontiguousarray(out.transpose(2, 1, 0))


@functools.lru_cache(maxsize=256)
def _start_inverse(season: bool, days: int) -> tuple[np.ndarray, np.ndarray]:
    """Products of the responses of all starts over so many days, and their inverses."""
    response = _responses(_starts(season), season, days)
    products = response @ response.transpose(0, 2, 1)
    return products, np.linalg.pinv(products, rcond=1e-11, hermitian=True)


def _from_starts(y: np.ndarray, lengths: np.ndarray, season: bool) -> tuple[np.ndarray, np.ndarray]:
    """Best change of an initial state of zeros, and its error, of each series with the weights of each start.

    The responses to the initial state depend on weights and days alone: they are shared by all series.
    """
    starts, parts, count = _starts(season), _parts(season), len(y)
    alpha, beta, gamma = (x[:, None] for x in starts.T)
    longest = int(lengths[0])
    response = _responses(starts, season, longest)
    state = np.zeros((parts, len(starts), count))
    errors = np.zeros((_BLOCK, len(starts), count))
    pull, error = np.zeros((len(starts), parts, count)), np.zeros((len(starts), count))
    values = np.ascontiguousarray(y.T)
    on = _running(lengths, longest)
    for t in range(longest):
        at, n = t % _BLOCK, on[t]
        level, trend, seasonal = state[0, :, :n], state[1, :, :n], state[2 + t % PERIOD, :, :n] if season else None
        now = errors[at, :, :n]
        errors[at, :, n:] = 0.0
        np.subtract(values[t, :n], level, out=now)
        now -= trend
        if season:
            now -= seasonal
        level += trend
        level += alpha * now
        trend += beta * now
        if season:
            seasonal += gamma * now
        if at == _BLOCK - 1 or t == longest - 1:
            block = errors[: at + 1]
            pull += response[:, :, t - at : t + 1] @ block.transpose(1, 0, 2)
            error += (block * block).sum(0)
    good = np.isfinite(error) & np.isfinite(pull).all(1)
    change = np.zeros((len(starts), parts, count))
    for days in np.unique(lengths):
        some = lengths == days
        products, inverse = _start_inverse(season, int(days))
        right = np.where(good[:, None, some], pull[:, :, some], 0.0)
        found = -(inverse @ right)
        change[:, :, some] = found
        error[:, some] += (found * (2 * right + products @ found)).sum(1)
    error = np.where(good, np.maximum(error, 0.0), np.inf)
    return change.transpose(2, 0, 1).reshape(-1, parts), error.T


#: Of the largest diagonal element, what a pivot must reach; other rows are solved by their eigenvalues.
_LEAST_PIVOT = 1e-8


def _solved(products: np.ndarray, parts: int, columns: Sequence[int]) -> np.ndarray:
    """Initial states that come nearest to some columns of the errors, ``(rows, parts, columns)``.

    The level and the weekly parts can trade a constant: that one direction is filled in, which gives the
    smallest solution, and the rest is factored for all rows at once.
    """
    right = np.ascontiguousarray(products[:, 1 : 1 + parts, list(columns)].transpose(1, 2, 0))
    matrix = np.ascontiguousarray(products[:, 1 : 1 + parts, 1 : 1 + parts].transpose(1, 2, 0))
    if parts > 2:
        free = np.array([1.0, 0.0] + [-1.0] * PERIOD)
        matrix += (free[:, None] * free)[:, :, None] * matrix[0, 0]
    largest = matrix[range(parts), range(parts)].max(0)
    solid = largest > 0
    for j in range(parts):
        for k in range(j):
            matrix[j:, j] -= matrix[j:, k] * matrix[j, k]
        solid &= matrix[j, j] > _LEAST_PIVOT * largest
        matrix[j:, j] /= np.sqrt(np.where(solid, matrix[j, j], 1.0))
    # rows that are not solid are thrown away
    with np.errstate(all="ignore"):
        for j in range(parts):
            for k in range(j):
                right[j] -= matrix[j, k] * right[k]
            right[j] /= matrix[j, j]
        for j in range(parts - 1, -1, -1):
            for k in range(j + 1, parts):
                right[j] -= matrix[k, j] * right[k]
            right[j] /= matrix[j, j]
    out = right.transpose(2, 0, 1).copy()
    if not solid.all():
        rest = products[~solid]
        inverse = np.linalg.pinv(rest[:, 1 : 1 + parts, 1 : 1 + parts], rcond=1e-11, hermitian=True)
        out[~solid] = inverse @ rest[:, 1 : 1 + parts, list(columns)]
    return out


def _least_error(products: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Squared error after a change of the initial state."""
    whole = np.concatenate([np.ones((len(change), 1)), change], 1)
    some = products[:, : whole.shape[1], : whole.shape[1]]
    return np.maximum((whole[:, None, :] @ some @ whole[:, :, None])[:, 0, 0], 0.0)


def _initial(products: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Change of the initial state that gives the least squared error, and that error.

    The level and the weekly parts can trade a constant, so the smallest change is taken.
    """
    change = -_solved(products, parts, (0,))[:, :, 0]
    return change, _least_error(products, change)


def _admissible(params: np.ndarray) -> np.ndarray:
    """Trend weight at most the level weight, seasonal weight at most the rest."""
    alpha, beta, gamma = params.T
    return np.stack([alpha, np.minimum(beta, alpha), np.minimum(gamma, 1 - alpha)], 1)


# Where the search starts, (alpha, beta, gamma).
START_LEVEL = (0.02, 0.1, 0.3, 0.6, 0.9)
START_TREND = (0.0, 0.02, 0.1)
START_SEASON = (0.0, 0.1, 0.3)
#: Starts that are followed, and steps at most.
FOLLOWED, STEPS = 3, 25
#: The search of a row ends when a step gains less than this share.
GAIN = 1e-6
#: Ends of the three shares that are searched: the level weight, the trend weight's share of it, and the seasonal weight's share of the rest.
LEAST_SHARE, MOST_SHARE = np.array([1e-4, 0.0, 0.0]), 0.9999


def _weights(share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights inside the admissible region from shares, and their derivatives."""
    alpha = share[:, 0]
    params = np.stack([alpha, alpha * share[:, 1], (1 - alpha) * share[:, 2]], 1)
    turn = np.zeros((len(share), 3, 3))
    turn[:, 0, 0] = 1.0
    turn[:, 1, 0] = share[:, 1]
    turn[:, 1, 1] = alpha
    turn[:, 2, 0] = -share[:, 2]
    turn[:, 2, 2] = 1 - alpha
    return params, turn


def _shares(params: np.ndarray) -> np.ndarray:
    alpha, beta, gamma = params.T
    return np.stack([alpha, beta / alpha, gamma / (1 - alpha)], 1).clip(LEAST_SHARE, MOST_SHARE)


def _bounded_step(normal: np.ndarray, pull: np.ndarray, damping: np.ndarray, share: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Damped step that stays in the box: a share that meets its end stops there, and the others are solved for anew."""
    size = np.maximum(np.einsum("nii->ni", normal), 1e-12 * (1 + np.abs(normal).max(axis=(1, 2)))[:, None])
    damped = normal + np.eye(3) * (size * damping[:, None])[:, None, :]
    low, high = LEAST_SHARE - share, MOST_SHARE - share
    fixed = np.broadcast_to(~used, share.shape) | ((low >= 0) & (pull > 0)) | ((high <= 0) & (pull < 0))
    step = np.zeros_like(share)
    for _ in range(3):
        open_ = (~fixed).astype(float)
        right = -(pull + np.einsum("nij,nj->ni", damped, step * (1 - open_))) * open_
        matrix = damped * open_[:, :, None] * open_[:, None, :] + np.eye(3) * (1 - open_)[:, None, :]
        step = np.where(fixed, step, np.linalg.solve(matrix, right[:, :, None])[:, :, 0])
        over = (step < low) | (step > high)
        step = step.clip(np.minimum(low, 0), np.maximum(high, 0))
        if not (over & ~fixed).any():
            break
        fixed = fixed | over
    return step


def _starts(season: bool) -> np.ndarray:
    grid = np.stack(np.meshgrid(START_LEVEL, START_TREND, START_SEASON if season else (0.0,)), -1).reshape(-1, 3)
    return np.unique(_admissible(grid), axis=0)


def fit_many(series: list[np.ndarray], season: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Least-squares parameters, initial states, final states and errors of several series.

    For given weights the best initial state is a linear least squares problem.  The weights are found by damped
    Gauss-Newton steps from the best points of a coarse grid: the derivatives of the errors by weights and initial state
    run through the days beside the state, for all series at once.  A series without a finite error has NaN everywhere.
    """
    parts, count = _parts(season), len(series)
    order = sorted(range(count), key=lambda i: -len(series[i]))
    series = [series[i] for i in order]
    lengths = np.array([len(s) for s in series])
    scale = np.array([np.abs(s).max() for s in series])
    scale[scale == 0] = 1.0
    y = np.zeros((count, lengths.max()))
    for row, s, by in zip(y, series, scale):
        row[: len(s)] = s / by

    starts = _starts(season)
    n = len(starts)
    change, error = _from_starts(y, lengths, season)
    first = error.argsort(1, kind="stable")[:, :FOLLOWED]
    k = first.shape[1]
    flat = (first + np.arange(count)[:, None] * n).ravel()

    rows = np.repeat(np.arange(count), k)
    free, initial = _shares(starts[first.ravel()]), change[flat]
    used = np.array([True, True, season])
    best = np.full(count * k, np.inf)
    kept = free.copy()
    kept_initial = np.zeros((count * k, parts))
    ends = np.full((count * k, parts), np.nan)
    normal = np.zeros((count * k, 3, 3))
    pull = np.zeros((count * k, 3))
    damping = np.full(count * k, 1e-3)
    stale, again = np.zeros(count * k, bool), np.zeros(count * k, bool)
    active = np.flatnonzero(np.isfinite(error.ravel()[flat]))
    for _ in range(STEPS):
        if not len(active):
            break
        params, turn = _weights(free[active])
        if not season:
            params[:, 2] = 0.0
        products, final = _pass(y[rows[active]], lengths[rows[active]], params, initial[active], season, True)
        good = np.isfinite(products).all(axis=(1, 2))
        products = _finite(products)
        solution = _solved(products, parts, (0, -3, -2, -1))
        change = -solution[:, :, 0]
        now = np.where(good, _least_error(products, change), np.inf)
        better = now < best[active]
        gain = np.where(np.isfinite(best[active]), best[active] - now, np.inf)
        # a step from derivatives of another initial state may fail for that reason: take them anew before giving up
        anew = again[active]
        small = better & (gain <= GAIN * now) & ~stale[active]
        at = active[better]
        best[at], kept[at] = now[better], free[at]
        kept_initial[at] = initial[at] + change[better]
        stale[at] = True
        ends[at] = (final[:, better, 0] + np.einsum("prc,rc->pr", final[:, better, 1 : 1 + parts], change[better])).T
        # derivatives by the weights, freed of what the initial state explains
        better |= anew
        at = active[better]
        some, explained = products[better], solution[better][:, :, 1:]
        inner = some[:, -3:, -3:] - some[:, 1 : 1 + parts, -3:].transpose(0, 2, 1) @ explained
        outer = some[:, -3:, 0] - (explained.transpose(0, 2, 1) @ some[:, 1 : 1 + parts, :1])[:, :, 0]
        by = turn[better]
        normal[at] = by.transpose(0, 2, 1) @ inner @ by
        pull[at] = (by.transpose(0, 2, 1) @ outer[:, :, None])[:, :, 0]
        stale[active[anew]] = False
        damping[active] = np.where(anew, damping[active], np.where(better, damping[active] * 0.2, damping[active] * 8)).clip(1e-9, 1e9)
        again[active] = (~better | (gain <= GAIN * now)) & stale[active]
        stop = small | (~better & ~again[active] & (damping[active] > 1e4))
        active = active[~stop]
        if not len(active):
            break
        step = _bounded_step(normal[active], pull[active], damping[active], kept[active], used)
        step[again[active]] = 0.0
        free[active] = kept[active] + step
        initial[active] = kept_initial[active]

    chosen = best.reshape(count, k).argmin(1) + np.arange(count) * k
    params, _ = _weights(kept[chosen])
    if not season:
        params[:, 2] = 0.0
    least = best[chosen]
    failed = ~np.isfinite(least)
    params[failed] = np.nan
    out = kept_initial[chosen]
    out[failed] = np.nan
    least = np.where(failed, np.nan, least)
    place = np.argsort(order)
    return params[place], (out * scale[:, None])[place], (ends[chosen] * scale[:, None])[place], (least * scale * scale)[place]


def _finite(products: np.ndarray) -> np.ndarray:
    good = np.isfinite(products).all(axis=(1, 2))
    return np.where(good[:, None, None], products, 0.0)


def fit(y: np.ndarray, season: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The same for one series."""
    params, initial, ends, error = fit_many([y], season)
    return params[0], initial[0], ends[0], float(error[0])


def heuristic_state(y: np.ndarray, season: bool) -> np.ndarray:
    """Level, trend (and weekly pattern) read off the first two weeks."""
    first, second = y[:PERIOD].mean(), y[PERIOD : 2 * PERIOD].mean()
    if not season:
        return np.array([y[0], y[1] - y[0]])
    return np.concatenate([[first, (second - first) / PERIOD], y[:PERIOD] - first])


def run_many(
    series: Sequence[np.ndarray], initial: np.ndarray, params: np.ndarray, season: bool, stops: Sequence[Sequence[int]]
) -> list[list[np.ndarray]]:
    """States of each series after each of its ``stops`` values, from one run over its days.

    What comes after a stop has no part in its state.
    """
    alpha, beta, gamma = params
    wanted: dict[int, list[int]] = {}
    for row, own in enumerate(stops):
        for stop in own:
            wanted.setdefault(stop, []).append(row)
    found: list[dict[int, np.ndarray]] = [{} for _ in series]
    longest = max(wanted, default=0)
    y = np.zeros((len(series), longest))
    for row, s in zip(y, series):
        row[: min(len(s), longest)] = s[:longest]
    state = np.array(initial, float).T.copy()
    for t in range(longest + 1):
        for row in wanted.get(t, ()):
            found[row][t] = state[:, row].copy()
        if t == longest:
            break
        error = y[:, t] - state[0] - state[1]
        if season:
            error -= state[2 + t % PERIOD]
        state[0] += state[1] + alpha * error
        state[1] += beta * error
        if season:
            state[2 + t % PERIOD] += gamma * error
    return [[found[row][stop] for stop in own] for row, own in enumerate(stops)]


def states_at(
    series: Sequence[np.ndarray], stops: Sequence[Sequence[tuple[int, bool]]], fixed: np.ndarray | None = None
) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """Weights and state after the first ``stop`` values of each series, for its pairs (stop, weekly pattern).

    Weights are fitted on those values alone.  With ``fixed`` ones a series is run once for each start it has, and its
    state is kept at every stop.
    """
    out: list[list] = [[None] * len(own) for own in stops]
    for season in (True, False):
        asked = [(i, j, stop) for i, own in enumerate(stops) for j, (stop, weekly) in enumerate(own) if weekly == season]
        if not asked:
            continue
        if fixed is None:
            params, _, ends, _ = fit_many([series[i][:stop] for i, _, stop in asked], season)
            for (i, j, _), p, e in zip(asked, params, ends):
                out[i][j] = p, e
            continue
        used = fixed if season else np.array([fixed[0], fixed[1], 0.0])
        runs: dict[tuple, list[tuple[int, int]]] = {}
        for i, j, stop in asked:
            runs.setdefault((i, tuple(heuristic_state(series[i][:stop], season))), []).append((j, stop))
        ends = run_many(
            [series[i] for i, _ in runs], np.array([start for _, start in runs]), used, season, [[s for _, s in own] for own in runs.values()]
        )
        for ((i, _), own), states in zip(runs.items(), ends):
            for (j, _), state in zip(own, states):
                out[i][j] = used, state
    return out


def project(ends: np.ndarray, rows: int, horizon: int, season: bool) -> np.ndarray:
    """Values of the ``horizon`` steps after ``rows`` smoothed ones."""
    steps = np.arange(1, horizon + 1)
    values = ends[0] + ends[1] * steps
    if season:
        values = values + ends[2:][(rows + steps - 1) % PERIOD]
    return values
