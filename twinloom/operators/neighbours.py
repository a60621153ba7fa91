"""Nearest rows and matching rows of a bounded set of attacks, in one scan of a table.

The attacks travel to the tasks as encoded columns: numbers as they are, categories
as numbers of the values that attacks have. A task goes through its rows in blocks,
works out the distance of each column once a pair, and keeps the best few rows of
each question; one row a question, attack and place leaves it, to be merged by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from twinloom.operators.profile import ColumnSpec

#: Attacks times rows that are compared at once.
CELLS = 2_000_000
DIGITS = 9
#: Up to so many nearest rows are found by repeated minima, more by sorting.
BY_MINIMA = 8
TOLERANCE = 0.05


def encodable(spec: ColumnSpec) -> Column:
    """A column as tasks take it: numbers as doubles, categories as texts."""
    return F.col(f"`{spec.name}`").cast("double" if spec.kind == "continuous" else "string")


@dataclass
class Encoder:
    """Columns of attacks as arrays: NaN is null for numbers; for categories -2 is null and -1 a value that no attack has."""

    specs: list[ColumnSpec]
    values: dict[str, list[str]]

    @classmethod
    def of(cls, specs: list[ColumnSpec], rows: list[Row]) -> Encoder:
        return cls(specs, {s.name: sorted({r[s.name] for r in rows if r[s.name] is not None}) for s in specs if s.kind != "continuous"})

    def __call__(self, columns: dict[str, pa.Array]) -> dict[str, np.ndarray]:
        out = {}
        for s in self.specs:
            x = columns[s.name]
            if s.kind == "continuous":
                out[s.name] = np.asarray(pc.fill_null(pc.cast(x, pa.float64()), np.nan))
            else:
                place = pc.index_in(x, value_set=pa.array(self.values[s.name], pa.string()), skip_nulls=True)
                out[s.name] = np.where(np.asarray(pc.is_null(x)), -2, np.asarray(pc.fill_null(place, -1))).astype(np.int32)
        return out

    def rows(self, rows: list[Row]) -> dict[str, np.ndarray]:
        return self({s.name: pa.array([r[s.name] for r in rows], pa.float64() if s.kind == "continuous" else pa.string()) for s in self.specs})


def _distance(spec: ColumnSpec, a: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Attacks times rows: distance over range for numbers, 0 or 1 for categories; a null is at distance 1, from a null 0."""
    if spec.kind != "continuous":
        return (a[:, None] != t[None, :]).astype(np.float64)
    width = (spec.high - spec.low) if spec.high is not None and spec.high > spec.low else 1.0
    d = np.abs(a[:, None] - t[None, :])
    d /= width
    one, other = np.isnan(a)[:, None], np.isnan(t)[None, :]
    if one.any() or other.any():
        d = np.where(one & other, 0.0, np.where(one | other, 1.0, d))
    return d


@dataclass
class Question:
    """Which rows are nearest to some attacks (a range of the rows collected) by some columns; of ``secret`` it is said whether it is given away."""

    first: int
    last: int
    columns: list[str]
    secret: str | None = None


def _right(spec: ColumnSpec, truth: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """Whether secrets are guessed: equal for categories, within 5 % for numbers; nulls alike."""
    if spec.kind != "continuous":
        return truth == guess
    with np.errstate(invalid="ignore"):
        return (np.abs(guess - truth) <= TOLERANCE * np.abs(truth)) | (np.isnan(guess) & np.isnan(truth))


def _smallest(d: np.ndarray, k: int) -> np.ndarray:
    """Column numbers of the k smallest of each row, the first ones in ties."""
    k = min(k, d.shape[1])
    if k == 1:
        return d.argmin(axis=1)[:, None]
    if k > BY_MINIMA:
        return np.argsort(d, axis=1, kind="stable")[:, :k]
    d, out, at = d.copy(), np.empty((len(d), k), np.int64), np.arange(len(d))
    for i in range(k):
        out[:, i] = d.argmin(axis=1)
        d[at, out[:, i]] = np.inf
    return out


class _Best:
    """The k best (distance, key, right) of each attack of a question so far."""

    def __init__(self, n: int, k: int):
        self.k, self.rows = k, [[] for _ in range(n)]
        self.worst = np.full(n, np.inf)

    def take(self, d: np.ndarray, keys: list, right) -> None:
        """``d``: attacks times rows in the order of their keys."""
        places = _smallest(d, self.k)
        found = np.take_along_axis(d, places, axis=1)
        for i, j in zip(*np.nonzero((found <= self.worst[:, None]) & (found < np.inf))):
            at = places[i, j]
            self.rows[i] = sorted([*self.rows[i], (float(found[i, j]), keys[at], right(i, at))])[: self.k]
            if len(self.rows[i]) == self.k:
                self.worst[i] = self.rows[i][-1][0]


def _searcher(encoder: Encoder, attacks: dict[str, np.ndarray], asked: list[Question], k: int, key_type: pa.DataType):
    known = {s.name: s for s in encoder.specs}
    groups: dict[tuple[int, int], list[int]] = {}
    for i, q in enumerate(asked):
        groups.setdefault((q.first, q.last), []).append(i)

    def block(t: dict[str, np.ndarray], keys: list, best: list[_Best]) -> None:
        for (first, last), members in groups.items():
            used = list(dict.fromkeys(c for i in members for c in asked[i].columns))
            total, parts = 0.0, {}
            for c in used:
                parts[c] = _distance(known[c], attacks[c][first:last], t[c])
                total = total + parts[c]
            for i in members:
                q = asked[i]
                without = [c for c in used if c not in q.columns]
                # the share of a single column is taken off the sum of all
                d = total if not without else total - parts[without[0]] if len(without) == 1 else sum(parts[c] for c in q.columns)
                truth = attacks[q.secret][first:last] if q.secret else None
                right = (lambda a, r: bool(_right(known[q.secret], truth[a : a + 1], t[q.secret][r : r + 1])[0])) if q.secret else (lambda a, r: False)
                best[i].take(np.round(d, DIGITS), keys, right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(q.last - q.first, k) for q in asked]
        size = max(64, CELLS // max(1, max((q.last - q.first for q in asked), default=1)))
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column(0)))  # by key, so that the first of equal distances has the smallest
            t = encoder({s.name: batch.column(1 + i) for i, s in enumerate(encoder.specs)})
            keys = batch.column(0).to_pylist()
            for lo in range(0, len(keys), size):
                block({c: x[lo : lo + size] for c, x in t.items()}, keys[lo : lo + size], best)
        out = [(i, q.first + a, *row) for i, q in enumerate(asked) for a, rows in enumerate(best[i].rows) for row in rows]
        if out:
            q, a, d, key, right = zip(*out)
            yield pa.record_batch([pa.array(q, pa.int32()), pa.array(a, pa.int32()), pa.array(d, pa.float64()), pa.array(key, key_type), pa.array(right, pa.bool_())], ["q", "a", "dist", "t_key", "right"])

    return run


def nearest_of(twin: DataFrame, key: str, specs: list[ColumnSpec], rows: list[Row], asked: list[Question], k: int = 1) -> DataFrame:
    """q, a (numbers of question and row), dist, t_key and right: of every partition of ``twin`` the k nearest rows, in one scan.

    ``rows`` are encodable attacks. The results of the partitions are still to be merged, by dist and t_key.
    """
    used = {c for q in asked for c in [*q.columns, *([q.secret] if q.secret else [])]}
    specs = [s for s in specs if s.name in used]
    encoder = Encoder.of(specs, rows)
    run = _searcher(encoder, encoder.rows(rows), asked, k, to_arrow_type(twin.schema[key].dataType))
    kind = twin.schema[key].dataType.simpleString()
    slim = twin.select(F.col(f"`{key}`").alias("_key"), *[encodable(s).alias(f"_{i}") for i, s in enumerate(specs)])
    return slim.mapInArrow(run, f"q int, a int, dist double, t_key {kind}, right boolean")


@dataclass
class Predicate:
    """A column's condition for every attack: equal to a category, or on one side of a number."""

    spec: ColumnSpec
    value: np.ndarray
    upward: np.ndarray | None = None


def _counter(encoder: Encoder, tests: list[Predicate], n: int, most: int | None):
    # a null meets nothing
    sound = np.ones(n, bool)
    for p in tests:
        sound &= ~np.isnan(p.value) if p.spec.kind == "continuous" else p.value >= 0
    places = {}
    for p in tests:
        if p.spec.kind == "continuous":
            steps = np.unique(p.value[sound])
            places[p.spec.name] = (steps, np.searchsorted(steps, p.value))

    def bitmaps(p: Predicate, x: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """Predicates times rows, a bit each."""
        if p.spec.kind != "continuous":
            mine, row = np.unique(p.value[alive], return_inverse=True)
            return np.packbits(x[None, :] == mine[:, None], axis=1)[row]
        steps, place = places[p.spec.name]
        place, missing = place[alive][:, None].astype(np.int32), np.isnan(x)
        up = np.where(missing, -1, np.searchsorted(steps, x, side="right") - 1).astype(np.int32)  # the last step that is not above
        down = np.where(missing, len(steps), np.searchsorted(steps, x, side="left")).astype(np.int32)  # the first that is not below
        return np.packbits(np.where(p.upward[alive][:, None], up[None, :] >= place, down[None, :] <= place), axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, alive = np.zeros(n, np.int64), np.flatnonzero(sound)
        for batch in batches:
            t = encoder({s.name: batch.column(i) for i, s in enumerate(encoder.specs)})
            lo = 0
            while lo < batch.num_rows and len(alive):
                size = max(64, CELLS // len(alive))
                bits = None
                for p in tests:
                    found = bitmaps(p, t[p.spec.name][lo : lo + size], alive)
                    bits = found if bits is None else bits & found
                counts[alive] += np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
                if most is not None:
                    alive = alive[counts[alive] < most]
                lo += size
        met = np.flatnonzero(counts)
        if len(met):
            yield pa.record_batch({"p": met.astype(np.int32), "n": counts[met]})

    return run


def matches_of(real: DataFrame, specs: list[ColumnSpec], rows: list[Row], middle: dict[str, float], most: int | None = None) -> DataFrame:
    """p and n: how many rows meet the predicate of each encodable row; with ``most``, at least that many count as that many.

    Categories have to be equal; numbers lie on the row's side of the middle, beyond it.
    """
    encoder = Encoder.of(specs, rows)
    own = encoder.rows(rows)
    tests = [Predicate(s, own[s.name], own[s.name] >= middle[s.name] if s.kind == "continuous" else None) for s in specs]
    counted = real.select(*[encodable(s) for s in specs]).mapInArrow(_counter(encoder, tests, len(rows), most), "p int, n long")
    n = F.sum("n")
    return counted.groupBy("p").agg((n if most is None else F.least(n, F.lit(most))).alias("n"))
