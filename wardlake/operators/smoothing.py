"""Additive exponential smoothing fitted by least squares: smoothing parameters and start states.

For given smoothing parameters the one-step forecasts are linear in the start states (level, trend, seasons), so these
are solved for exactly: the recursion runs once from zero and once per state from a unit state. What is left is a
search over two or three parameters in a box, done for many points at once: a grid, then from its best points projected
Newton steps on differences, beside plain moves along the axes, until neither helps.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

LOW, HIGH = 0.0, 1.0
GRID = np.linspace(0.05, 0.95, 7)
STARTS = 2
MAX_STEPS = 40
DIFFERENCE = 1e-3
SMALLEST_MOVE = 1e-4
# Gains below this share of the error end the search.
LEAST_GAIN = 1e-10


@dataclass(frozen=True)
class Fit:
    """Parameters (alpha, beta[, gamma]), the last states, the one-step forecasts and their squared error."""

    params: np.ndarray
    level: float
    trend: float
    season: np.ndarray
    fitted: np.ndarray
    sse: float


def _responses(y: np.ndarray, params: np.ndarray, season: int) -> tuple[np.ndarray, ...]:
    """The recursion from zero states over ``y`` (first column) and from every unit state over zeros, per parameter row.

    Returns one-step forecasts (rows, columns, months) and the last level, trend and seasons.
    """
    n, states = len(params), 2 + season
    alpha, beta = params[:, :1], params[:, 1:2]
    level, trend = np.zeros((n, 1 + states)), np.zeros((n, 1 + states))
    level[:, 1], trend[:, 2] = 1.0, 1.0
    seasons = np.zeros((season, n, 1 + states))
    for slot in range(season):
        seasons[slot, :, 3 + slot] = 1.0
    forecasts = np.empty((len(y), n, 1 + states))
    value = np.zeros(1 + states)
    for t, value[0] in enumerate(y):
        expected = level + trend
        if season:
            slot = t % season
            held = seasons[slot]
            forecasts[t] = expected + held
            moved = alpha * (value - held) + (1 - alpha) * expected
            gamma = params[:, 2:3]
            seasons[slot] = gamma * (value - expected) + (1 - gamma) * held
        else:
            forecasts[t] = expected
            moved = alpha * value + (1 - alpha) * expected
        trend = beta * (moved - level) + (1 - beta) * trend
        level = moved
    return forecasts.transpose(1, 2, 0), level, trend, seasons.transpose(1, 0, 2)


def _solved(y: np.ndarray, params: np.ndarray, season: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Per parameter row the least squared error, the weights (1, start states) that reach it, and the responses."""
    responses = _responses(y, params, season)
    forecasts = responses[0]
    rest = y - forecasts[:, 0]
    states = np.einsum("nst,nt->ns", np.linalg.pinv(forecasts[:, 1:].transpose(0, 2, 1), rcond=1e-10), rest)
    error = rest - np.einsum("ns,nst->nt", states, forecasts[:, 1:])
    return (error * error).sum(axis=1), np.concatenate([np.ones((len(params), 1)), states], axis=1), responses


def _newton_moves(f: Callable[[np.ndarray], np.ndarray], at: np.ndarray) -> np.ndarray:
    """Candidate points from a quadratic through differences around ``at``, several dampings and lengths."""
    k = len(at)
    middle = np.clip(at, LOW + DIFFERENCE, HIGH - DIFFERENCE)
    unit = np.eye(k) * DIFFERENCE
    pairs = [(i, j) for i in range(k) for j in range(i)]
    points = [middle, *(middle + u for u in unit), *(middle - u for u in unit)]
    points += [middle + s * unit[i] + t * unit[j] for i, j in pairs for s in (1, -1) for t in (1, -1)]
    values = f(np.array(points))
    up, down = values[1 : 1 + k], values[1 + k : 1 + 2 * k]
    slope = (up - down) / (2 * DIFFERENCE)
    bend = np.diag((up - 2 * values[0] + down) / DIFFERENCE**2)
    for p, (i, j) in enumerate(pairs):
        a, b, c, d = values[1 + 2 * k + 4 * p : 5 + 2 * k + 4 * p]
        bend[i, j] = bend[j, i] = (a - b - c + d) / (4 * DIFFERENCE**2)
    # a parameter at its bound that would leave the box stays
    free = ~(((at <= LOW) & (slope > 0)) | ((at >= HIGH) & (slope < 0)))
    moves = []
    size = max(abs(np.diag(bend)).max(), 1e-300)
    for damping in (0.0, 1e-3, 1e-1, 1.0, 10.0):
        step = np.zeros(k)
        if free.any():
            part = bend[np.ix_(free, free)] + damping * size * np.eye(int(free.sum()))
            step[free] = -np.linalg.lstsq(part, slope[free], rcond=None)[0]
        moves += [at + length * step for length in (1.0, 0.5, 0.1)]
    return np.array(moves)


def bounded_minimum(f: Callable[[np.ndarray], np.ndarray], k: int) -> np.ndarray:
    """Point of the box [0, 1]^k with the least value of ``f``, which takes many points (rows) at once."""
    grid = np.stack(np.meshgrid(*[GRID] * k, indexing="ij"), axis=-1).reshape(-1, k)
    values = f(grid)
    found = []
    for start in np.argsort(values, kind="stable")[:STARTS]:
        at, value, reach = grid[start], values[start], 0.08
        for _ in range(MAX_STEPS):
            around = np.concatenate([at + reach * np.eye(k), at - reach * np.eye(k)])
            points = np.clip(np.concatenate([_newton_moves(f, at), around]), LOW, HIGH)
            tried = f(points)
            best = int(np.argmin(tried))
            if value - tried[best] > LEAST_GAIN * value:
                at, value = points[best], tried[best]
            elif reach < SMALLEST_MOVE:
                break
            else:
                reach *= 0.25
        found.append((value, tuple(at)))
    return np.array(min(found)[1])


def fit(y: np.ndarray, season: int = 0) -> Fit:
    """Additive trend, and additive seasons of length ``season`` if given, of least squared one-step error."""
    y = np.asarray(y, dtype=float)
    params = bounded_minimum(lambda points: _solved(y, points, season)[0], 3 if season else 2)
    sse, weights, (forecasts, level, trend, seasons) = _solved(y, params[None, :], season)
    w = weights[0]
    return Fit(params, float(level[0] @ w), float(trend[0] @ w), seasons[0] @ w, forecasts[0].T @ w, float(sse[0]))
