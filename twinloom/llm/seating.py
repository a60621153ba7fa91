"""Numbers of tables of many dishes at once, sampled by Gibbs from their exact distribution given all others.

How the customers of a dish sit shows in predictions by the number of its tables alone, so the sizes of the tables are
summed out: t tables of c customers weigh S(c, t), a generalised Stirling number of the discount, times the chances of t
new tables. A dish is drawn anew as a whole, whatever its number of customers.
"""

from __future__ import annotations

import math

import numpy as np

#: Dishes with up to so many customers are drawn from all their weights, others by MOVES Metropolis steps a sweep.
EXACT = 128
MOVES = 4
#: Terms of the sums for Stirling numbers of many customers.
TERMS = 80
#: Cells of weights at once.
_CELLS = 1 << 20


def discount_of(ones: int, twos: int) -> float:
    """The usual estimate of a Pitman-Yor discount from how many dishes have one and two customers."""
    return float(np.clip(ones / (ones + 2 * twos) if ones else 0.5, 0.05, 0.95))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithms of the gamma function of positive numbers, to about 1e-10."""
    x = np.asarray(x, np.float64)
    low = np.zeros(x.shape)
    while (small := x < 8).any():
        low = np.where(small, low + np.log(x), low)
        x = np.where(small, x + 1, x)
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - low


class Stirling:
    """Logarithms of S(c, t): c customers at t tables, each table of n customers weighing (1 - d)(2 - d)...(n - 1 - d)."""

    def __init__(self, discount: float):
        self.d = discount
        self.table = np.full((EXACT + 1, EXACT + 1), -np.inf)
        self.table[1, 1] = 0.0
        for c in range(1, EXACT):
            t = np.arange(1, c + 2)
            with np.errstate(divide="ignore"):
                self.table[c + 1, 1 : c + 2] = np.logaddexp(self.table[c, : c + 1], np.log(np.maximum(c - discount * t, 0)) + self.table[c, 1 : c + 2])

    def _series(self, c: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The alternating sum for S(c, t) as far as TERMS terms, and where it is trusted: where its terms end, and cancel little."""
        d = self.d
        total, sizes, last = np.zeros(len(c)), np.zeros(len(c)), np.zeros(len(c))
        top, ways = log_gamma(c - d), np.zeros(len(c))
        for j in range(1, TERMS + 1):
            with np.errstate(divide="ignore"):
                ways = ways + np.log(np.maximum(t - j + 1, 0) / j)
            if (j * d).is_integer():
                continue
            last = np.exp(np.minimum(ways + log_gamma(c - j * d) - top, 300.0)) / abs(math.gamma(-j * d))
            sizes = sizes + last
            total = total + last * (-1) ** j * math.copysign(1, math.gamma(-j * d))
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.log(total) + top - t * math.log(d) - log_gamma(t + 1), (total > 1e-9 * sizes) & (last < 1e-5 * total)

    def _saddle(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The coefficient of x ** c in c! / t! f(x) ** t, f(x) = (1 - (1 - x) ** d) / d, by its saddle point; c > t."""
        d = self.d
        c, t = np.asarray(c, np.float64), np.asarray(t, np.float64)
        ratio = np.log(c / t)
        # v = log(1 - x), where x f'(x) / f(x) = c / t; the difference falls in v
        low, high = -(ratio + 5) / (1 - d), np.full(c.shape, -1e-12)
        for _ in range(60):
            v = (low + high) / 2
            above = np.log(d) + np.log(-np.expm1(v)) + (d - 1) * v - np.log(-np.expm1(d * v)) > ratio
            low, high = np.where(above, v, low), np.where(above, high, v)
        x, q = -np.expm1(v), c / t
        bend = np.maximum(q * (1 + (1 - d) * x * np.exp(-v) - q), 1e-300)
        free = c - t  # a saddle point has Stirling's formula for the factorial of this, which is off by about 1 / (12 free)
        over = log_gamma(free + 1) - (free + 0.5) * np.log(free) + free - 0.5 * np.log(2 * np.pi)
        return -over + log_gamma(c + 1) - log_gamma(t + 1) + t * (np.log(-np.expm1(d * v)) - np.log(d)) - c * np.log(x) - 0.5 * np.log(2 * np.pi * t * bend)

    def of_many(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """For c > EXACT: the sum where it can be had, as for few tables beside c ** d, and else the saddle point's, which is good there."""
        c, t = np.asarray(c, np.float64), np.asarray(t, np.float64)
        found, good = self._series(c, t)
        rest = np.flatnonzero(~good)
        found[rest] = self._saddle(c[rest], np.minimum(t, c - 1)[rest])
        return np.where(t >= c, 0.0, found)


class Seating:
    """``tables`` of dishes with ``customers``; ``tables`` may come from an earlier seating, which is carried on."""

    def __init__(self, customers: np.ndarray, discount: float, rng: np.random.Generator, tables: np.ndarray | None = None):
        self.customers, self.discount, self.rng = np.asarray(customers, np.int64), discount, rng
        self.tables = np.minimum(self.customers, 1) if tables is None else np.asarray(tables, np.int64).copy()
        self.fresh = tables is None
        self.stirling = Stirling(discount)
        c = self.customers
        width = np.where((c > 1) & (c <= EXACT), 1 << np.ceil(np.log2(np.maximum(c, 2))).astype(int), 0)
        self.few = [(w, np.flatnonzero(width == w)) for w in np.unique(width[width > 0]).tolist()]
        self.many = np.flatnonzero(c > EXACT)

    def sweep(self, first: np.ndarray, step: np.ndarray) -> None:
        """Draws each dish anew; beside k tables of its own, a new table weighs ``first + k * step``."""
        for w, rows in self.few:
            for lo in range(0, len(rows), max(1, _CELLS // w)):
                at = rows[lo : lo + max(1, _CELLS // w)]
                weight = np.log(first[at, None] + step[at, None] * np.arange(w)).cumsum(axis=1) + self.stirling.table[self.customers[at], 1 : w + 1]
                share = np.exp(weight - weight.max(axis=1, keepdims=True)).cumsum(axis=1)
                x = self.rng.random(len(at)) * share[:, -1]
                self.tables[at] = np.minimum(1 + (share <= x[:, None]).sum(axis=1), self.customers[at])
        if len(self.many):
            self._move_many(first[self.many], step[self.many])

    def _move_many(self, first: np.ndarray, step: np.ndarray) -> None:
        c, rng = self.customers[self.many], self.rng
        if self.fresh:
            self.tables[self.many], self.fresh = self._expected(c, first, step), False
        t = self.tables[self.many]
        grows = step > 0
        ahead = first / np.where(grows, step, 1)

        def weight(t: np.ndarray) -> np.ndarray:
            chance = np.where(grows, t * np.log(np.where(grows, step, 1)) + log_gamma(ahead + t), t * np.log(first))
            return self.stirling.of_many(c, t) + chance

        now = weight(t)
        for move in range(MOVES):
            # steps of about the spread, which is below the root of the number of tables, and small ones in turn
            reach = np.where(move % 2, 1, 1 + np.floor(np.sqrt(c.astype(np.float64) ** self.discount))).astype(np.int64)
            to = t + rng.integers(1, reach + 1) * rng.choice([-1, 1], len(t))
            fits = (to >= 1) & (to <= c)
            then = weight(np.where(fits, to, t))
            go = fits & (np.log(rng.random(len(t))) < then - now)
            t, now = np.where(go, to, t), np.where(go, then, now)
        self.tables[self.many] = t

    def _expected(self, c: np.ndarray, first: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Where steps begin: tables that come up when customers come in by tenths of who is there."""
        t, i = np.ones(len(c)), 1
        while (more := c > i).any():
            k = np.where(more, np.minimum(max(1, i // 10), c - i), 0)
            m = first + step * t
            t += k * m / (i + k / 2 - self.discount * t + m)
            i += max(1, i // 10)
        return np.clip(np.round(t), 1, c).astype(np.int64)
