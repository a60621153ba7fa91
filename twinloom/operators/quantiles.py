"""Exact quantiles of many columns at once, by counts of ever narrower bins.

Every pass counts all columns' values in bins; of each bin the smallest and largest
value are known too. Bins that hold a wanted rank are split further, the others are
left aside, until few values are left in them, which the last pass returns. The
result depends on the values alone, not on how rows are dealt, and what reaches the
driver is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of all columns together, and of one column at most.
BINS, COLUMN_BINS = 400_000, 4096
#: Values that may be left in the bins of a column for the last pass to return.
LEFT = 20_000


@dataclass
class _Bracket:
    """Values from low through high, of which ``below`` are smaller than low and ``n`` are in it; ``wanted`` are ranks from 1."""

    low: float
    high: float
    below: int
    n: int
    wanted: list[int]


@dataclass
class _Search:
    open: list[_Bracket]
    found: dict[int, float] = field(default_factory=dict)

    def settle(self) -> None:
        for b in self.open:
            if b.low == b.high:
                self.found.update(dict.fromkeys(b.wanted, b.low))
        self.open = [b for b in self.open if b.low != b.high]


def _edges(brackets: list[_Bracket], bins: int) -> np.ndarray:
    """Lower ends of bins: those that split each bracket, its largest value for itself, and one after it."""
    out = []
    for b in brackets:
        # halves, as the width of a bracket may be more than a double can hold
        inner = (np.linspace(b.low / 2, b.high / 2, max(2, bins // len(brackets))) * 2)[:-1]
        out += [b.low, *inner[(inner > b.low) & (inner < b.high)].tolist(), b.high, np.nextafter(b.high, np.inf)]
    return np.unique(np.array(out))


def _doubles(column: pa.Array) -> np.ndarray:
    return np.asarray(column.drop_null(), dtype=np.float64) + 0.0  # without negative zeros


def _counter(edges: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(len(e), np.int64) for e in edges]
        low, high = [np.full(len(e), np.inf) for e in edges], [np.full(len(e), -np.inf) for e in edges]
        for batch in batches:
            for c, e in enumerate(edges):
                x = np.sort(_doubles(batch.column(c)))
                if not len(e) or not len(x):
                    continue
                first = np.searchsorted(x, e, side="left")  # of each bin
                last = np.append(first[1:], len(x))
                some = last > first
                n[c] += last - first
                low[c][some] = np.minimum(low[c][some], x[first[some]])
                high[c][some] = np.maximum(high[c][some], x[last[some] - 1])
        for c in range(len(edges)):
            b = np.flatnonzero(n[c])
            if len(b):
                yield pa.record_batch([pa.array(np.full(len(b), c, np.int32)), pa.array(b.astype(np.int32)), pa.array(n[c][b]), pa.array(low[c][b]), pa.array(high[c][b])], ["c", "b", "n", "low", "high"])

    return run


def _collector(ranges: list[list[tuple[float, float]]]):
    """Values that lie in one of the ranges of their column, with how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, pairs in enumerate(ranges):
                x = _doubles(batch.column(c)) if pairs else np.zeros(0)
                inside = np.zeros(len(x), bool)
                for low, high in pairs:
                    inside |= (x >= low) & (x <= high)
                v, n = np.unique(x[inside], return_counts=True)
                if len(v):
                    yield pa.record_batch([pa.array(np.full(len(v), c, np.int32)), pa.array(v), pa.array(n.astype(np.int64))], ["c", "v", "n"])

    return run


def exact_quantiles(df: DataFrame, columns: dict[str, Column], parts: int) -> dict[str, list[float] | None]:
    """Of each column the values at ranks ceil(i * n / parts), 1 at least, for i from 0 to ``parts``; null for columns without values.

    Columns are doubles; nulls are left out, NaN and infinity must be nulls.
    """
    names = list(columns)
    if not names:
        return {}
    slim = df.select(*[c.alias(f"_{i}") for i, c in enumerate(columns.values())])
    ends = slim.agg(*[f(F.col(f"_{i}")).alias(f"{f.__name__}{i}") for i in range(len(names)) for f in (F.count, F.min, F.max)]).first()
    wanted, searches = {}, {}
    for i, name in enumerate(names):
        n = ends[f"count{i}"]
        if n:
            wanted[name] = [max(1, -(-k * n // parts)) for k in range(parts + 1)]
            searches[name] = _Search([_Bracket(ends[f"min{i}"] + 0.0, ends[f"max{i}"] + 0.0, 0, n, sorted(set(wanted[name])))])
            searches[name].settle()
    bins = max(4 * parts, min(COLUMN_BINS, BINS // len(names)))
    while any(sum(b.n for b in s.open) > LEFT for s in searches.values()):
        edges = [_edges(searches[c].open, bins) if c in searches and searches[c].open else np.zeros(0) for c in names]
        counted = slim.mapInArrow(_counter(edges), "c int, b int, n long, low double, high double").groupBy("c", "b").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        rows: dict[int, list] = {}
        for r in counted.orderBy("c", "b").collect():  # BINS at most
            rows.setdefault(r.c, []).append(r)
        for i, c in enumerate(names):
            if c in searches:
                searches[c] = _narrowed(searches[c], rows.get(i, []))
    ranges = [[(b.low, b.high) for b in searches[c].open] if c in searches else [] for c in names]
    if any(ranges):
        values: dict[int, list] = {}
        for r in slim.mapInArrow(_collector(ranges), "c int, v double, n long").groupBy("c", "v").agg(F.sum("n").alias("n")).orderBy("c", "v").collect():
            values.setdefault(r.c, []).append(r)
        for i, c in enumerate(names):
            for b in searches[c].open if c in searches else []:
                at, left = b.below, list(b.wanted)
                for r in values[i]:
                    if b.low <= r.v <= b.high:
                        at += r.n
                        while left and left[0] <= at:
                            searches[c].found[left.pop(0)] = r.v
    return {c: [searches[c].found[r] for r in wanted[c]] if c in searches else None for c in names}


def _narrowed(search: _Search, bins: list) -> _Search:
    """The brackets that hold the wanted ranks, once bins are counted."""
    out = _Search([], search.found)
    for b in search.open:
        at, left = b.below, list(b.wanted)
        for r in bins:
            if b.low <= r.low and r.high <= b.high:
                mine = [w for w in left if w <= at + r.n]
                if mine:
                    out.open.append(_Bracket(r.low, r.high, at, r.n, mine))
                    left = left[len(mine) :]
                at += r.n
    out.settle()
    return out
