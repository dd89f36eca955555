"""Exact Gaussian likelihood of (p,d,q)x(1,0,1,s) models by a Kalman filter, for many series and parameters side by side.

The ARMA part stands in companion form, its first state being the process itself, and starts from its stationary spread.
A differenced order carries the level of the day before as one more state. That level has no prior: the filter starts
behind a series' first known day, which settles it (the diffuse likelihood). A missing day skips the update, so nothing is
filled in. The variance is concentrated out.

Arrays end in a lane axis; a lane is one series under one set of parameters. Once the spread of all lanes stands still and
no day is missing, only the states move on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

STILL = 1e-11
CHECK_EVERY = 16


@dataclass(frozen=True)
class Lanes:
    """ARMA weights by lag, (lag, lane), and how many times the series are differenced (0 or 1)."""

    ar: np.ndarray
    ma: np.ndarray
    d: int

    @property
    def size(self) -> int:
        return max(len(self.ar), len(self.ma) + 1)

    def companion(self) -> tuple[np.ndarray, np.ndarray]:
        """(state, lane) weights of the first state on the next states, and of the shock on the states."""
        lanes = self.ar.shape[1]
        phi, loads = np.zeros((self.size, lanes)), np.zeros((self.size, lanes))
        phi[: len(self.ar)] = self.ar
        loads[0] = 1.0
        loads[1 : len(self.ma) + 1] = self.ma
        return phi, loads


def moved(x: np.ndarray, phi: np.ndarray, d: int) -> np.ndarray:
    """The states one day on, without a shock; axis 0 holds the states."""
    weights = phi.reshape(len(phi), *[1] * (x.ndim - 2), phi.shape[1])
    out = np.empty_like(x)
    out[d:] = weights * x[d]
    out[d:-1] += x[d + 1 :]
    if d:
        out[0] = x[0] + x[1]
    return out


def stationary_spread(phi: np.ndarray, loads: np.ndarray, doublings: int = 40) -> np.ndarray:
    """(state, state, lane): covariance that the companion form keeps, by doubling; not finite where there is none."""
    size, lanes = phi.shape
    step = np.zeros((lanes, size, size))
    step[:, :, 0] = phi.T
    step[:, np.arange(size - 1), np.arange(1, size)] = 1.0
    spread = loads.T[:, :, None] * loads.T[:, None, :]
    with np.errstate(over="ignore", invalid="ignore"):
        for _ in range(doublings):
            grown = step @ spread @ step.transpose(0, 2, 1)
            spread = spread + grown
            step = step @ step
            more, whole = (np.abs(m).max(axis=(1, 2)) for m in (grown, spread))
            if not (more > 1e-13 * whole)[np.isfinite(whole)].any():
                break
    return np.moveaxis(spread, 0, -1)


@dataclass(frozen=True)
class Filtered:
    """Innovations and their spread (day, lane; 0 and 1 where a day is unknown), and the states expected on the day after the last."""

    errors: np.ndarray
    spread: np.ndarray
    known: np.ndarray
    state: np.ndarray

    def counted(self, first: int = 1) -> np.ndarray:
        return self.known & (np.arange(len(self.known)) >= first)[:, None]

    def log_likelihood(self, first: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Per lane: log-likelihood of the days from `first` on at the best variance, and that variance."""
        own = self.counted(first)
        n = np.maximum(own.sum(axis=0), 1)
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            variance = np.maximum((self.errors**2 / self.spread * own).sum(axis=0) / n, 1e-300)
            value = -0.5 * (n * (np.log(2 * np.pi * variance) + 1) + (np.log(self.spread) * own).sum(axis=0))
        return np.where(np.isfinite(value), value, -np.inf), variance

    def residuals(self, first: int = 1) -> np.ndarray:
        """Values whose sum of squares falls as the log-likelihood rises: scaled innovations times their mean spread."""
        own = self.counted(first)
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            mean_log = (np.log(self.spread) * own).sum(axis=0) / np.maximum(own.sum(axis=0), 1)
            return self.errors / np.sqrt(self.spread) * np.exp(mean_log / 2) * own


def kalman(y: np.ndarray, lengths: np.ndarray, lanes: Lanes) -> Filtered:
    """Filter `y` (day, lane; NaN where unknown). Every lane starts with a known day and ends after `lengths` days.

    A lane whose ARMA part is not stationary has no likelihood (minus infinity).
    """
    phi, loads = lanes.companion()
    d, size = lanes.d, lanes.size
    days, count = y.shape
    start = stationary_spread(phi, loads)
    barred = ~np.isfinite(start).all(axis=(0, 1)) | (start[0, 0] <= 0)
    start[:, :, barred], phi[:, barred], loads[1:, barred] = np.eye(size)[:, :, None], 0.0, 0.0
    spread = np.zeros((size + d, size + d, count))
    spread[d:, d:] = start
    shock = np.zeros_like(spread)
    shock[d:, d:] = loads[:, None] * loads[None]
    state = np.zeros((size + d, count))
    known = ~np.isnan(y)
    values = np.nan_to_num(y)
    inside = np.arange(days)[:, None] < lengths
    errors, spreads = np.zeros(y.shape), np.ones(y.shape)
    at_end = np.zeros_like(state)
    if d:
        state[0] = values[0]
        at_end[:, lengths == 1] = state[:, lengths == 1]
    still = False
    whole = known | ~inside
    all_known = whole.all(axis=1)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        for t in range(d, days):
            if not still or not all_known[t]:
                row = spread[0] + spread[1] if d else spread[0]
                total = row[0] + row[1] if d else row[0]
                gain = row / total
            seen = known[t]
            error = values[t] - (state[0] + state[1] if d else state[0])
            errors[t] = np.where(seen, error, 0.0)
            spreads[t] = np.where(seen, total, 1.0)
            state = moved(state + gain * errors[t], phi, d)
            if not still or not all_known[t]:
                after = spread - gain[:, None] * row[None] * whole[t]
                after = moved(moved(after, phi, d).swapaxes(0, 1), phi, d) + shock
                if t % CHECK_EVERY == 0 or still:
                    change, level = (np.abs(m).max(axis=(0, 1)) for m in (after - spread, after))
                    still = bool(all_known[t] and (change <= STILL * np.maximum(1.0, level)).all())
                spread = after
            ending = lengths == t + 1
            if ending.any():
                at_end[:, ending] = state[:, ending]
    spreads[:, barred] = np.nan
    return Filtered(errors, spreads, known, at_end)


def forecast_paths(states: np.ndarray, phi: np.ndarray, d: int, steps: int) -> np.ndarray:
    """(step, lane): expected values of the coming days, all lanes together."""
    out = np.empty((steps, states.shape[1]))
    for h in range(steps):
        out[h] = states[0] + states[1] if d else states[0]
        states = moved(states, phi, d)
    return out
