"""Lomb-Scargle periodograms of one series (numpy), in bounded memory."""

from functools import lru_cache

import numpy as np

OMEGA = np.linspace(0.6, 62.8, 5000)
#: The axis that areas are taken over: an even one from 0.1 to 10 days, not the period of each frequency.
PERIODS = np.linspace(0.1, 10, 5000)
FAST_OMEGA = np.linspace(62.8, 6283.2, 20)
SLICES = (slice(457, 5000), slice(121, 457), slice(0, 121))
#: Numbers in a matrix of waves.
CELLS = 2_000_000
#: Grid points that a sample is spread to, how fast the spreading falls off, and grid points a frequency: errors of 1e-12.
SPREAD, FALL, FINER = 14, 2.3 * 14, 2
#: Frequencies that are not worth a grid.
FEW = 64


@lru_cache(maxsize=16)
def _unspread(m: int) -> tuple[int, np.ndarray]:
    """Grid points for m frequencies, and what undoes the spreading of each (of -m // 2 on, by Gauss-Legendre sums)."""
    points = 1 << int(np.ceil(np.log2(FINER * m + 2 * SPREAD)))
    z, weight = np.polynomial.legendre.leggauss(8 * SPREAD)
    half = SPREAD * np.pi / points
    k = np.arange(m) - m // 2
    wave = np.cos(np.outer(k * half, z))
    return points, 2 * np.pi / points / (half * (wave @ (weight * np.exp(FALL * (np.sqrt(1 - z * z) - 1)))))


def _even_sums(t: np.ndarray, start: float, step: float, m: int, weights: list[np.ndarray]) -> list[np.ndarray]:
    """Of each weight w the sums of w * exp(i * omega * t) at omega = start + step * (0 .. m - 1).

    Samples are spread to an even grid of phases step * t, which one transform turns into all frequencies: the work is
    len(t) * SPREAD + m * log(m), where the sums themselves take len(t) * m (Dutt and Rokhlin 1993; Barnett 2019)."""
    points, undo = _unspread(m)
    place = np.mod(step * t, 2 * np.pi) * (points / (2 * np.pi))
    first = np.ceil(place - SPREAD / 2).astype(np.int64)
    at = first[:, None] + np.arange(SPREAD)
    z = (at - place[:, None]) / (SPREAD / 2)
    kernel = np.exp(FALL * (np.sqrt(np.maximum(1 - z * z, 0)) - 1))
    at = (at % points).ravel()
    middle = np.exp(1j * ((start + step * (m // 2)) * t))
    out = []
    for w in weights:
        c = w * middle
        grid = np.bincount(at, (c.real[:, None] * kernel).ravel(), points) + 1j * np.bincount(at, (c.imag[:, None] * kernel).ravel(), points)
        modes = np.fft.ifft(grid) * points
        out.append(np.r_[modes[points - m // 2 :], modes[: m - m // 2]] * undo)
    return out


def wave_sums(t: np.ndarray, omega: np.ndarray, *weights: np.ndarray) -> list[np.ndarray]:
    """Of each weight w the sums over times of w * exp(i * omega * t), and last the sums of exp(2 * i * omega * t).

    Even grids of more than FEW frequencies go through a transform; others are summed wave by wave, in blocks."""
    m, one = len(omega), np.ones(len(t))
    if m > FEW and np.allclose(np.diff(omega), omega[1] - omega[0], rtol=1e-9, atol=0):
        step = (omega[-1] - omega[0]) / (m - 1)
        return _even_sums(t, omega[0], step, m, list(weights)) + _even_sums(t, 2 * omega[0], 2 * step, m, [one])
    out: list[list] = [[] for _ in range(len(weights) + 1)]
    rows = max(1, CELLS // max(1, len(t)))
    for k in range(0, m, rows):
        waves = np.exp(1j * np.outer(omega[k : k + rows], t))
        for total, w in zip(out, weights):
            total.append(waves @ w)
        out[-1].append((waves * waves) @ one)
    return [np.concatenate(x) if x else np.zeros(0, complex) for x in out]


def classic(t: np.ndarray, y: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """Power at angular frequencies, no mean removed, divided by the sum of squares (Scargle 1982)."""
    first, double = wave_sums(t, omega, y)
    yc, ys, cc, ss, cs = first.real, first.imag, (len(t) + double.real) / 2, (len(t) - double.real) / 2, double.imag / 2
    turn = np.arctan2(2 * cs, cc - ss) / 2  # omega * tau: sums are turned instead of the waves
    a, b = np.cos(turn), np.sin(turn)
    yc, ys = yc * a + ys * b, ys * a - yc * b
    cc, ss = cc * a * a + 2 * cs * a * b + ss * b * b, ss * a * a - 2 * cs * a * b + cc * b * b
    with np.errstate(divide="ignore", invalid="ignore"):
        return (yc**2 / cc + ys**2 / ss) / float(y @ y)


def floating_mean(t: np.ndarray, y: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """Share of the variance that a sine with a free mean explains, at each angular frequency."""
    y, n = y - y.mean(), len(t)
    first, plain, double = wave_sums(t, omega, y, np.ones(n))
    c, s = plain.real, plain.imag
    yc, ys, cc, ss, cs = first.real, first.imag, (n + double.real) / 2 - c * c / n, (n - double.real) / 2 - s * s / n, double.imag / 2 - c * s / n
    with np.errstate(divide="ignore", invalid="ignore"):
        return (ss * yc**2 + cc * ys**2 - 2 * cs * yc * ys) / ((cc * ss - cs * cs) * float(y @ y))


def largest_peak(power: np.ndarray, omega: np.ndarray) -> tuple[float, float]:
    """(power, period) at the largest strict local maximum; NaN if there is none."""
    inner = np.flatnonzero((power[1:-1] > power[:-2]) & (power[1:-1] > power[2:])) + 1
    if not len(inner):
        return np.nan, np.nan
    k = inner[np.argmax(power[inner])]
    return float(power[k]), float(2 * np.pi / omega[k])


def spectral_features(t: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Peak power, its logarithm, period, three trapezoid areas of the spectrum, and the fast peak's period."""
    if len(t) < 3 or not (y @ y) > 0:
        return (np.nan,) * 7
    power = classic(t, y, OMEGA)
    peak, period = largest_peak(power, OMEGA)
    areas = [float(np.trapezoid(power[s], PERIODS[s])) for s in SLICES]
    _, fast = largest_peak(classic(t, y, FAST_OMEGA), FAST_OMEGA)
    return peak, float(np.log(abs(peak))) if peak else np.nan, period, *areas, fast
