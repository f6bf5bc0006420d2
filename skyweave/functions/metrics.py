"""Distances between feature vectors, by name as in the clustering and novelty steps.

A metric works on prepared rows, on which the triangle inequality holds where `triangle` says so; what users see is
`shown`. Cosine and correlation distance are half the squared Euclidean distance of rows scaled (and centred) to length
1; a row of no direction (zero, or constant) stays zero, half a unit from all others. Bray-Curtis knows no triangle
inequality: all pairs must be looked at.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column

ALIASES = {"l2": "euclidean", "l1": "cityblock", "manhattan": "cityblock", "infinity": "chebyshev"}
SQUARED = {"sqeuclidean": 1.0, "cosine": 0.5, "correlation": 0.5}
#: Numbers of a part of a tile that goes through all dimensions before the next: it should stay in the cache.
CACHED = 16_384
#: The same in single precision, and what a rounding there is off by, twice over.
CACHED_SINGLE, SINGLE = 32_768, 2.0**-23
#: Distances that are this many times as large as they may be off in single precision, in the mean, are told apart by it.
TOLD = 50
NAMES = ("euclidean", "cityblock", "chebyshev", "minkowski", "canberra", "braycurtis", *SQUARED)


@dataclass(frozen=True)
class Metric:
    name: str
    p: float = 2.0

    @property
    def triangle(self) -> bool:
        return self.name != "braycurtis"

    @property
    def euclidean(self) -> bool:
        """By a matrix product, which loses digits near zero."""
        return self.name == "euclidean" or self.name in SQUARED

    def prepared(self, x: np.ndarray) -> np.ndarray:
        if self.name == "correlation":
            x = x - x.mean(1, keepdims=True)
        if self.name in ("cosine", "correlation"):
            length = np.sqrt((x * x).sum(1, keepdims=True))
            x = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
        return x

    def tile(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """All distances of two sets of prepared rows."""
        return self._tile(x, y)[0]

    def _tile(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
        """All distances in the precision of the rows, and the least number that one was divided by."""
        if self.euclidean:
            d = (-2 * x) @ y.T
            d += np.einsum("ik,ik->i", x, x)[:, None]
            d += np.einsum("jk,jk->j", y, y)[None, :]
            return np.sqrt(np.maximum(d, 0, out=d), out=d), 1.0
        out, rows, columns = np.empty((len(x), len(y)), x.dtype), x.T[:, :, None], np.ascontiguousarray(y.T)[:, None, :]
        cached, least = CACHED if x.dtype == float else CACHED_SINGLE, [np.inf]
        wide = max(1, min(len(y), cached))
        high = max(1, cached // wide)
        for i in range(0, len(x), high):
            for j in range(0, len(y), wide):
                out[i : i + high, j : j + wide] = self._between(rows[:, i : i + high], columns[:, :, j : j + wide], least)
        return out, float(min(least))

    def quick(self, x: np.ndarray, y: np.ndarray, memo: dict) -> tuple[np.ndarray, float | None]:
        """All distances of two sets of prepared rows in single precision and how far one may be off; as `tile` has them
        (and None) where that would tell too few pairs apart, for this tile and those after it that have the memo."""
        slack = None if memo.get("double") or not x.size or not y.size else self._single_slack(x, y)
        if slack is not None:
            d, least = self._tile(x.astype(np.float32), y.astype(np.float32))
            if self.name == "braycurtis":  # both sums may be off by the slack
                slack = slack * (1 + float(d.max())) / (least - slack) if least > 4 * slack else np.inf
            if TOLD * slack <= d[:: max(1, len(d) // 8)].mean(dtype=float):
                return d, slack
        memo["double"] = True
        return self.tile(x, y), None

    def _single_slack(self, x: np.ndarray, y: np.ndarray) -> float | None:
        """How far distances in single precision may be off, if their steps stay within its range; of Bray-Curtis its sums."""
        k, top = x.shape[1], max(float(np.abs(x).max()), float(np.abs(y).max()))
        if not 1e-3 < top < 1e6 or self.name == "minkowski" and self.p > 4:
            return None
        if self.euclidean:
            return float(np.sqrt(SINGLE * (k + 8)) * sum(np.sqrt(np.einsum("ik,ik->i", z, z).max()) for z in (x, y)))
        if self.name == "chebyshev":
            return 8 * SINGLE * top
        if self.name == "minkowski":
            return SINGLE * (k + 4 * self.p + 4) * k ** (1 / self.p) * 2 * top
        if self.name == "canberra":
            tiny = any(((z != 0) & (np.abs(z) < 1e-30)).any() for z in (x, y))
            return None if tiny else SINGLE * k * (k + 4)
        return float(SINGLE * (k + 4) * sum(np.abs(z).sum(1).max() for z in (x, y)))

    def pairs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distances of the rows of x to those of y at the same place, from differences."""
        if self.euclidean:
            return np.sqrt(((x - y) ** 2).sum(1))
        return self._between(x.T, y.T)

    def _between(self, a: np.ndarray, b: np.ndarray, least: list | None = None) -> np.ndarray:
        """Distances along the first axis of what is broadcast together, dimension by dimension; what they are divided by
        at the least is added to a list."""
        shape, kind = np.broadcast_shapes(a.shape[1:], b.shape[1:]), a.dtype
        total, d, more = np.zeros(shape, kind), np.empty(shape, kind), np.empty(shape, kind)
        other, smallest = np.zeros(shape, kind) if self.name == "braycurtis" else total, np.nextafter(kind.type(0), kind.type(1))
        for one, two in zip(a, b):
            np.abs(np.subtract(one, two, out=d), out=d)
            if self.name == "chebyshev":
                np.maximum(total, d, out=total)
                continue
            if self.name == "minkowski":
                self._raised(d, more)
            elif self.name == "canberra":  # the least number above 0 stands for 0: 0 / 0 counts as 0
                np.divide(d, np.maximum(np.add(np.abs(one), np.abs(two), out=more), smallest, out=more), out=d)
            elif self.name == "braycurtis":
                other += np.abs(np.add(one, two, out=more), out=more)
            total += d
        if self.name == "minkowski":
            return total ** (1 / self.p)
        if self.name != "braycurtis":
            return total
        if least is not None:
            least.append(other.min(initial=np.inf))
        return np.divide(total, other, out=np.zeros(shape, kind), where=other > 0)

    def _raised(self, d: np.ndarray, more: np.ndarray) -> None:
        """d to the power p, in place; halves of an even p by squares, as powers are slow."""
        p = self.p
        while p > 1 and p % 2 == 0:
            np.multiply(d, d, out=d)
            p /= 2
        if p == 3:
            np.multiply(np.multiply(d, d, out=more), d, out=d)
        elif p != 1:
            np.power(d, p, out=d)

    def shown(self, d):
        """What users see of a distance of prepared rows; of a number or a column."""
        return d * d * SQUARED[self.name] if self.name in SQUARED else d

    def inner(self, shown: float) -> float:
        """The distance of prepared rows that users see as this one."""
        return float(np.sqrt(shown / SQUARED[self.name])) if self.name in SQUARED else float(shown)


def metric_of(name: str = "minkowski", p: float = 2.0) -> Metric:
    """Minkowski's with p 1 and 2 are the city block and Euclid's distance; p counts for `minkowski` alone."""
    name = ALIASES.get(name, name)
    if name not in NAMES:
        raise ValueError(f"no such metric: {name}")
    if name == "minkowski":
        if p < 1:
            raise ValueError("Minkowski's p is 1 at least")
        name = {1.0: "cityblock", 2.0: "euclidean", float("inf"): "chebyshev"}.get(float(p), name)
    return Metric(name, float(p))
