"""Helpers on one series (numpy): gap filling, splines, zero-phase high-pass."""

import numpy as np

from ..operators.clean import clip_series


def runs_of(missing: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.r_[0, missing.astype(int), 0]))
    return [(int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2])]


def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline with not-a-knot ends."""
    n = len(x)
    if n < 4:
        return np.interp(at, x, y)
    h, slope = np.diff(x), np.diff(y) / np.diff(x)
    a, rhs = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        rhs[i] = 6 * (slope[i] - slope[i - 1])
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    m = np.linalg.solve(a, rhs)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    d = at - x[k]
    return y[k] + d * (slope[k] - h[k] * (2 * m[k] + m[k + 1]) / 6) + d**2 * m[k] / 2 + d**3 * (m[k + 1] - m[k]) / (6 * h[k])


def fill_gaps(t: np.ndarray, flux: np.ndarray, tol: float, sigma: float, search: int, factor: float = 2.0, knots: int = 100) -> np.ndarray:
    """Clips, then fills inner gaps other than the longest, over the sample index: a line if shorter than tol, a spline
    if longer; one of exactly tol stays.

    The spline is kept unless its deviation is above the local one or its median outside [local / factor, local *
    factor], local values being means of those of `search` samples on either side (unknown where a side has none, which
    keeps it); else a line. Samples over `knots` known ones away have no bearing on a cubic spline's value (each damps
    them by 0.27), so the spline goes through that many on either side.
    """
    out = np.where(clip_series(flux, sigma), flux, np.nan)
    known = np.flatnonzero(~np.isnan(out))
    if len(known) < 2 or len(t) < 2:
        return out
    step = np.diff(t)
    step = step[step > 0].min() if (step > 0).any() else 0.0
    inner = [(a, n) for a, n in runs_of(np.isnan(out)) if a > 0 and a + n < len(t)]
    if inner:
        inner.remove(max(inner, key=lambda r: (r[1], -r[0])))
    base = out.copy()
    for a, n in inner:
        gap = np.arange(a, a + n)
        linear = np.interp(gap, known, base[known])
        if n * step < tol:
            out[gap] = linear
        elif n * step > tol:
            sides = [x[~np.isnan(x)] for x in (base[max(0, a - search) : a], base[a + n : a + n + search])]
            spread, middle = (np.mean([f(x) if len(x) else np.nan for x in sides]) for f in (np.std, np.median))
            at = np.searchsorted(known, a)
            near = known[max(0, at - knots) : at + knots]
            curve = spline(near.astype(float), base[near], gap.astype(float))
            odd = np.std(curve) > spread or np.median(curve) > factor * middle or np.median(curve) < middle / factor
            out[gap] = linear if odd else curve
    return out


def butterworth_high(order: int, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of a digital high-pass (bilinear design); cutoff as a fraction of Nyquist."""
    warped = 4 * np.tan(np.pi * cutoff / 2)
    low = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    poles = warped / low
    z_poles = (4 + poles) / (4 - poles)
    b, a = np.real(np.poly(np.ones(order))), np.real(np.poly(z_poles))
    nyquist = (-1.0) ** np.arange(order, -1, -1)
    return b * abs(np.sum(a * nyquist) / np.sum(b * nyquist)), a


def _filter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray, block: int = 128) -> np.ndarray:
    """A recursive filter from a state on: blocks of samples at once, only the state goes from block to block."""
    order = len(state)
    move = np.zeros((order, order))
    move[:, 0], move[:-1, 1:] = -a[1:], np.eye(order - 1)
    gain = b[1:] - a[1:] * b[0]
    powers = [np.eye(order)]
    for _ in range(block):
        powers.append(move @ powers[-1])
    pulse = np.r_[b[0], [(p @ gain)[0] for p in powers[: block - 1]]]
    lag = np.arange(block)[:, None] - np.arange(block)[None, :]
    response = np.where(lag >= 0, pulse[np.maximum(lag, 0)], 0.0)
    seen = np.array([p[0] for p in powers[:block]])
    enter = np.array([powers[block - 1 - j] @ gain for j in range(block)])
    blocks = np.r_[x, np.zeros(-len(x) % block)].reshape(-1, block)
    brought, states = blocks @ enter, np.empty((len(blocks), order))
    for k in range(len(blocks)):
        states[k] = state
        state = powers[block] @ state + brought[k]
    return (blocks @ response.T + states @ seen.T).ravel()[: len(x)]


def high_pass(x: np.ndarray, cutoff: float, order: int) -> np.ndarray:
    """Forward and backward filtering with odd edges of 3 * (order + 1) samples."""
    b, a = butterworth_high(order, cutoff)
    pad = 3 * (order + 1)
    if len(x) <= pad:
        return np.full(len(x), np.nan)
    wide = np.r_[2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]
    companion = np.zeros((order, order))
    companion[:, 0], companion[:-1, 1:] = -a[1:], np.eye(order - 1)
    steady = np.linalg.solve(np.eye(order) - companion, b[1:] - a[1:] * b[0])
    there = _filter(b, a, wide, steady * wide[0])[::-1]
    return _filter(b, a, there, steady * there[0])[::-1][pad:-pad]


def high_passed_rms(x: np.ndarray, cutoff: float, order: int) -> float:
    y = high_pass(x, cutoff, order)
    return float(np.sqrt(np.mean(y * y))) if len(y) else np.nan
