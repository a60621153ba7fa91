"""Correlations of the scores behind categories.

A category is a range of a standard normal score that is not seen. Two of them are
correlated as their table of counts makes most likely (polychoric); a category and a
number as the number's mean scores in the categories say (polyserial). Both come from
one pass: sums of scores by category and counts by pairs of categories, as products
of a matrix of scores and indicators with itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinloom.functions.rng import normal_cdf_array, normal_quantile_array
from twinloom.operators.model import EDGE, Model, Scorer, encoded, share_below

#: Correlations of categories are sought within this.
MOST = 0.999
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(24)


def cuts_of(through: list[float]) -> np.ndarray:
    """Normal quantiles of running shares, with both ends."""
    inner = normal_quantile_array(np.clip(np.array(through[:-1], dtype=np.float64), EDGE, 1 - EDGE))
    return np.array([-np.inf, *inner, np.inf])


def _density(x: np.ndarray) -> np.ndarray:
    return np.exp(-np.minimum(x * x, 1e4) / 2) / np.sqrt(2 * np.pi)


def table_shares(a: np.ndarray, b: np.ndarray, r: float) -> np.ndarray:
    """The shares of a table of two categories with these cuts, for scores with correlation ``r``.

    The bivariate distribution function is the product of both plus the integral of its density over the correlation.
    """
    h, k = np.clip(a, -12, 12)[:, None], np.clip(b, -12, 12)[None, :]
    t = r * (_NODES + 1) / 2
    s = 1 - t * t
    inside = np.exp(-(h[..., None] ** 2 - 2 * h[..., None] * k[..., None] * t + k[..., None] ** 2) / (2 * s)) / (2 * np.pi * np.sqrt(s))
    below = normal_cdf_array(h) * normal_cdf_array(k) + (inside * _WEIGHTS).sum(axis=-1) * r / 2
    return np.diff(np.diff(below, axis=0), axis=1)


def polychoric(counts: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    """The correlation for which a table of counts is most likely; 0 for an empty one."""
    if not counts.sum():
        return 0.0

    def loss(r: float) -> float:
        return -float((counts * np.log(np.maximum(table_shares(a, b, r), 1e-12))).sum())

    low, high, golden = -MOST, MOST, (np.sqrt(5) - 1) / 2
    left, right = high - golden * (high - low), low + golden * (high - low)
    fl, fr = loss(left), loss(right)
    while high - low > 1e-6:
        if fl < fr:
            high, right, fr = right, left, fl
            left = high - golden * (high - low)
            fl = loss(left)
        else:
            low, left, fl = left, right, fr
            right = low + golden * (high - low)
            fr = loss(right)
    return (low + high) / 2


def polyserial(sums: np.ndarray, n: float, a: np.ndarray) -> float:
    """The correlation of a score with a category, from the sums of the score by category: they are to the densities at the cuts as the correlation says."""
    steps = _density(a[:-1]) - _density(a[1:])
    return float(np.clip((sums * steps).sum() / n / (steps * steps).sum(), -MOST, MOST)) if n else 0.0


def takes_digests(model: Model) -> bool:
    """Whether sums need random words: for numbers that are null alone, as those of categories are counts."""
    return any(c.kind == "continuous" and c.nulls for c in model.scored)


def _sums(model: Model):
    """Per partition: the products of all scores of numbers and indicators of categories, a row each, and the count of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = takes_digests(model)
        scorer, total, n = Scorer(model), None, 0
        for batch in batches:
            z = scorer(batch)[0] if digests else None
            blocks, at = [], 0
            for i, c in enumerate(model.scored):
                x = batch.column(scorer.blocks * digests + i)
                if c.kind == "continuous" and z is None:
                    u = share_below(np.asarray(x, dtype=np.float64), np.array(c.knots))
                    blocks.append(normal_quantile_array(np.clip(u, EDGE, 1 - EDGE))[:, None])
                elif c.kind == "continuous":
                    blocks.append(z[:, [at]])
                else:
                    place = np.asarray(pc.index_in(x, value_set=pa.array(c.values, pa.string()), skip_nulls=True).fill_null(-1))
                    blocks.append((place[:, None] == np.arange(len(c.values))).astype(np.float64))
                if c.nulls:
                    missing = np.asarray(pc.is_null(x)).astype(np.float64)
                    blocks.append(np.column_stack([missing, 1 - missing]))
                at += len(c.scores)
            m = np.column_stack(blocks)
            m = np.column_stack([np.ones(len(m)), m])
            total, n = m.T @ m if total is None else total + m.T @ m, n + len(m)
        if n:
            yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "sums"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, i in enumerate(batch.column(0).to_pylist()):
            row = np.asarray(batch.column(1)[at].values)
            total[i] = total[i] + row if i in total else row
    if total:
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["i", "sums"])


def correlation(df: DataFrame, model: Model) -> np.ndarray:
    """The correlation of a model's scores, rounded to 9 digits, so that it does not depend on how rows are dealt."""
    # a slot a score: where its columns of the matrix begin and end, and the cuts of a category
    slots, at = [], 1
    for c in model.scored:
        cuts = None if c.kind == "continuous" else cuts_of(c.through)
        for x in [cuts, *([cuts_of([c.nulls, 1.0])] if c.nulls else [])]:
            width = 1 if x is None else len(x) - 1
            slots.append((at, at + width, x))
            at += width
    out = np.eye(len(slots))
    if len(slots) < 2:
        return out
    rows = df.select(*encoded(df, model, takes_digests(model))).mapInArrow(_sums(model), "i int, sums array<double>").repartition("i").mapInArrow(_added, "i int, sums array<double>").collect()
    if not rows:
        return out
    g = np.zeros((at, at))
    for r in rows:
        g[r.i] = r.sums
    n = g[0, 0]
    for i, (a0, a1, a) in enumerate(slots):
        for j, (b0, b1, b) in enumerate(slots[:i]):
            if a is None and b is None:
                va, vb = g[a0, a0] - g[0, a0] ** 2 / n, g[b0, b0] - g[0, b0] ** 2 / n
                r = (g[a0, b0] - g[0, a0] * g[0, b0] / n) / np.sqrt(va * vb) if va > 0 and vb > 0 else 0.0
            elif a is None:
                r = polyserial(g[a0, b0:b1], n, b)
            elif b is None:
                r = polyserial(g[b0, a0:a1], n, a)
            else:
                r = polychoric(g[a0:a1, b0:b1], a, b)
            out[i, j] = out[j, i] = round(float(r), 9)
    return out


def contingency(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, value_a, value_b and n: the table of every two columns, nulls aside; values are texts."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}`").cast("string").alias("value_a"), F.col(f"`{b}`").cast("string").alias("value_b")) for a, b in pairs])
    joint = df.groupBy(*columns).agg(F.count("*").alias("_n"))  # few rows where all columns are categories
    return joint.select(F.inline(cells), "_n").where("value_a IS NOT NULL AND value_b IS NOT NULL").groupBy("a", "b", "value_a", "value_b").agg(F.sum("_n").alias("n"))
