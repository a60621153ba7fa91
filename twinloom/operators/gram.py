"""Sums over all pairs of many columns in one pass, as matrix products.

A task multiplies its rows' matrix with itself and with the mask of known values,
so that every pair has its own count and sums; a row a column leaves it, and these
rows are added up by column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Of columns i and j where both are known: count, sum of i and of j, of their squares, and of the product.
_SUMS = ("n", "si", "sj", "qi", "qj", "p")
_SCHEMA = "i int, " + ", ".join(f"{s} array<double>" for s in _SUMS)


def matrix_of(batch: pa.RecordBatch) -> np.ndarray:
    """Rows times columns; NaN for nulls."""
    return np.column_stack([np.asarray(c.fill_null(np.nan), dtype=np.float64) for c in batch.columns]) if batch.num_columns else np.zeros((batch.num_rows, 0))


def _sums(matrix: Callable[[pa.RecordBatch], np.ndarray], centre: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(centre)
        total = {s: np.zeros((width, width)) for s in _SUMS}
        for batch in batches:
            x = matrix(batch) - centre
            known = ~np.isnan(x)
            x = np.where(known, x, 0.0)
            m = known.astype(np.float64)
            total["n"] += m.T @ m
            total["si"] += x.T @ m
            total["qi"] += (x * x).T @ m
            total["p"] += x.T @ x
        total["sj"], total["qj"] = total["si"].T, total["qi"].T
        if total["n"].any():
            yield pa.record_batch([pa.array(range(width), pa.int32()), *[pa.array(list(total[s]), pa.list_(pa.float64())) for s in _SUMS]], ["i", *_SUMS])

    return run


def _merged(names: list[str], what: str):
    def value(n, si, sj, qi, qj, p):
        if n < 2:
            return None
        covar = p - si * sj / n
        if what == "covar":
            return float(covar / (n - 1))
        vi, vj = qi - si * si / n, qj - sj * sj / n
        return float(covar / np.sqrt(vi * vj)) if vi > 0 and vj > 0 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, i in enumerate(batch.column(0).to_pylist()):
                row = np.stack([np.asarray(batch.column(1 + s)[at].values) for s in range(len(_SUMS))])
                total[i] = total[i] + row if i in total else row
        out = [(names[i], names[j], value(*row[:, j])) for i, row in total.items() for j in range(i + 1, len(names))]
        if out:
            a, b, v = zip(*out)
            yield pa.record_batch([pa.array(a), pa.array(b), pa.array(v, pa.float64())], ["a", "b", what])

    return run


def pairs(df: DataFrame, names: list[str], what: str, matrix: Callable[[pa.RecordBatch], np.ndarray] = matrix_of, centre: list[float] | None = None) -> DataFrame:
    """a, b and corr (or covar) of every pair of the columns that ``matrix`` makes of a batch; null where it isn't defined.

    ``centre`` is taken off the values first: numbers near the means, for precision alone.
    """
    sums = df.mapInArrow(_sums(matrix, np.array(centre if centre is not None else [0.0] * len(names))), _SCHEMA)
    return sums.repartition("i").mapInArrow(_merged(names, what), f"a string, b string, {what} double")


def near_means(df: DataFrame, columns: list[str], rows: int = 1000) -> list[float]:
    """Means of some rows."""
    found = df.select(*columns).limit(rows).agg(*[F.avg(c) for c in columns]).first()
    return [x or 0.0 for x in found]
