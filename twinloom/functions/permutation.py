"""Keyed bijections of row numbers, as column expressions and in SQL.

A Feistel network over two halves, modulo a and b, permutes the numbers below
a * b, of which there are few more than n; a number that lands at n or above is
sent on until it lands below. How often that can be needed is found beforehand
from the fewer than sqrt(n) + 1 numbers above n.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRIME = 2**31 - 1
HALF_ROUNDS = 6


def round_keys(seed: int, salt: str) -> list[tuple[int, int]]:
    """Factor and summand of each half round."""
    out = []
    for i in range(HALF_ROUNDS):
        h = hashlib.md5(f"{seed}|{salt}|{i}".encode()).hexdigest()
        out.append((int(h[:8], 16) % (PRIME - 1) + 1, int(h[8:16], 16) % PRIME))
    return out


@dataclass(frozen=True)
class Permutation:
    """A bijection of 0 to n - 1."""

    n: int
    keys: list[tuple[int, int]]

    @property
    def sides(self) -> tuple[int, int]:
        a = math.isqrt(max(self.n, 1) - 1) + 1
        return a, -(-max(self.n, 1) // a)

    def once(self, x: np.ndarray) -> np.ndarray:
        """One pass of the network over numbers below a * b."""
        a, b = self.sides
        left, right = x // b, x % b
        for i, key in enumerate(self.keys):
            if i % 2 == 0:
                left = (left + _mix(right, key)) % a
            else:
                right = (right + _mix(left, key)) % b
        return left * b + right

    def back(self, y: np.ndarray) -> np.ndarray:
        """The inverse of :meth:`once`."""
        a, b = self.sides
        left, right = y // b, y % b
        for i, key in reversed(list(enumerate(self.keys))):
            if i % 2 == 0:
                left = (left - _mix(right, key)) % a
            else:
                right = (right - _mix(left, key)) % b
        return left * b + right

    @property
    def walks(self) -> int:
        """How many more passes any number below n can need."""
        a, b = self.sides
        out = np.arange(self.n, a * b, dtype=np.int64)
        out, n = out[self.back(out) < self.n], 0
        while out.size:
            out, n = self.once(out), n + 1
            out = out[out >= self.n]
        return n


def _mix(v, key: tuple[int, int]):
    t = (v * key[0] + key[1]) % PRIME
    return t * t % PRIME


def permuted(df: DataFrame, rank: str, names: dict[str, Permutation]) -> DataFrame:
    """``df`` with the permuted rank as a column for each name; all have the same n."""
    if not names:
        return df
    a, b = next(iter(names.values())).sides
    out = df.withColumns({y: F.col(rank) for y in names})
    for walk in range(1 + max(p.walks for p in names.values())):
        steps, moved = [], []
        for y, p in names.items():
            # every half round is a name of its own, so that it is used twice and computed once
            left, right = f"_{y}_l", f"_{y}_r"
            steps += [f"{y} div {b}L AS {left}", f"{y} % {b}L AS {right}"]
            for i, (factor, summand) in enumerate(p.keys):
                by, side, old = (right, a, left) if i % 2 == 0 else (left, b, right)
                steps += [f"({by} * {factor}L + {summand}L) % {PRIME}L AS _{y}_t{i}", f"({old} + _{y}_t{i} * _{y}_t{i} % {PRIME}L) % {side}L AS _{y}_{i}"]
                left, right = (f"_{y}_{i}", right) if i % 2 == 0 else (left, f"_{y}_{i}")
            at = f"{left} * {b}L + {right}"
            moved.append((f"{at}" if walk == 0 else f"CASE WHEN {y} < {p.n}L THEN {y} ELSE {at} END") + f" AS _{y}_new")
        kept = [f"`{c}`" for c in df.columns]
        out = out.selectExpr("*", *steps, *moved).selectExpr(*kept, *[f"_{y}_new AS {y}" for y in names])
    return out


def permutation_sql(name: str, keys: list[tuple[int, int]], ranks: str, n: str) -> str:
    """Recursive tables: ``name`` has r and y, the permuted number, for the numbers r of a table ``ranks``; n is an expression."""
    size = f"{name}_n AS (SELECT n, a, ((greatest(n, 1) + a - 1) // a)::BIGINT AS b FROM (SELECT n, ceil(sqrt(greatest(n, 1)))::BIGINT AS a FROM (SELECT {n} AS n)))"

    def mix(v: str, key: tuple[int, int]) -> str:
        t = f"(({v} * {key[0]} + {key[1]}) % {PRIME})"
        return f"({t} * {t} % {PRIME})"

    steps, left, right = [], "l", "h"
    for i, key in enumerate(keys):
        if i % 2 == 0:
            steps.append(f"({left} + {mix(right, key)}) % a AS l{i}")
            left = f"l{i}"
        else:
            steps.append(f"({right} + {mix(left, key)}) % b AS h{i}")
            right = f"h{i}"
    once = lambda source: f"SELECT r, {left} * b + {right} AS y FROM (SELECT r, a, b, v // b AS l, v % b AS h, {', '.join(steps)} FROM ({source}), {name}_n)"
    walk = f"{name}_w AS ({once(f'SELECT r, r AS v FROM {ranks}')} UNION ALL {once(f'SELECT r, y AS v FROM {name}_w WHERE y >= (SELECT n FROM {name}_n)')})"
    return f"{size}, {walk}, {name} AS (SELECT r, y FROM {name}_w WHERE y < (SELECT n FROM {name}_n))"
