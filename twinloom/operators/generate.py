"""Twins: a Gaussian copula blended with noise of the same correlation.

Every column becomes a standard normal score, by its distribution function for
numbers and by a hash within the category's share for categories. A pass replaces
z by sqrt(1 - a^2) z + a L e, where L L' is the correlation of the scores and e
is hash noise, which keeps the correlation; k passes are one step in closed form.
Scores are then turned back by the columns' own distributions.

A table is fitted in a few passes (:func:`fit`), and twins are made from the model
in one more, in Arrow batches (:func:`twinloom.operators.model.twin_of`).

A defined meaning for the knobs, from public statistics (Kim 1986; Gaussian
copulas); it carries no formal privacy guarantee.
"""

from __future__ import annotations

import json
import math
import secrets
import time
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinloom import __version__
from twinloom.operators.latent import correlation
from twinloom.operators.model import Fitted, Model, retained, twin_of
from twinloom.operators.profile import ColumnSpec, as_double, finite, profile
from twinloom.operators.quantiles import exact_quantiles

KNOTS = 101
RIDGE = 1e-6
PROVENANCE_SCHEMA = "seed long, k int, mix_prob double, n_rows long, n_cols int, columns string, engine_version string, load_seconds double, run_seconds double"


def mixed(z: Column, noise: Column, mix_prob: float, k: int) -> Column:
    rho = retained(mix_prob, k)
    return F.lit(rho) * z + F.lit(math.sqrt(1 - rho * rho)) * noise


def quantile_knots(df: DataFrame, columns: dict[str, Column], n: int = KNOTS) -> dict[str, list[float]]:
    """``n`` averaged quantiles of each column: midpoints of neighbouring exact quantiles, so that no knot is a value of the data by design."""
    found = exact_quantiles(df, columns, n)
    return {c: [a / 2 + b / 2 for a, b in zip(q[:-1], q[1:])] if q else [0.0] * n for c, q in found.items()}


def at_quantile(u: Column, knots: list[float]) -> Column:
    """The piecewise linear function through the knots, at u in (0, 1)."""
    array = F.array(*[F.lit(float(x)) for x in knots])
    p = F.least(F.greatest(u, F.lit(0.0)), F.lit(1.0)) * (len(knots) - 1)
    i = F.least(F.floor(p), F.lit(len(knots) - 2)).cast("int")
    low = F.element_at(array, i + 1)
    return low + (p - i) * (F.element_at(array, i + 2) - low)


def cutpoints(df: DataFrame, column: str) -> list[tuple[object, float, float]]:
    """(value, share below, share through) of each category, by value; nulls aside."""
    rows = df.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(column).collect()  # categories only
    total, out, seen = sum(r["count"] for r in rows), [], 0
    for r in rows:
        out.append((r[0], seen / total, (seen + r["count"]) / total))
        seen += r["count"]
    return out


def category_at(u: Column, cuts: list[tuple[object, float, float]]) -> Column:
    """The category whose share holds u: a ladder over the cut points."""
    out = F.when(u < F.lit(cuts[0][2]), F.lit(cuts[0][0]))
    for value, _, through in cuts[1:-1]:
        out = out.when(u < F.lit(through), F.lit(value))
    return out.otherwise(F.lit(cuts[-1][0]))


@dataclass
class TwinResult:
    df: DataFrame
    provenance: DataFrame
    model: Model


def _shares(df: DataFrame, specs: list[ColumnSpec]) -> dict[str, tuple[list[str], list[float]]]:
    """Values as texts, in the columns' own order, and running shares of all categories, from one pass; nulls aside."""
    if not specs:
        return {}
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{s.name}`").cast("string").alias("v")) for i, s in enumerate(specs)])
    found: dict[int, list] = {}
    for r in df.select(F.inline(cells)).where("v IS NOT NULL").groupBy("i", "v").count().collect():  # categories only
        found.setdefault(r.i, []).append((r.v, r["count"]))
    out = {}
    for i, s in enumerate(specs):
        rows = sorted(found[i], key=lambda x: x[0] if isinstance(s.type, (T.StringType, T.BooleanType)) else float(x[0]))
        total = np.cumsum([n for _, n in rows])
        out[s.name] = ([v for v, _ in rows], [int(t) / int(total[-1]) for t in total])
    return out


def fit(df: DataFrame, key: str | list[str], k: int = 2, mix_prob: float = 0.75, seed: int | None = None, columns: list[str] | None = None, surrogates: bool = False) -> Model:
    """The model of a table; see :func:`generate`."""
    if k < 1 or not 0 <= mix_prob <= 1:
        raise ValueError("k is 1 or more and mix_prob from 0 to 1")
    keys = [key] if isinstance(key, str) else list(key)
    df = finite(df)
    seed = secrets.randbits(32) if seed is None else seed
    specs = profile(df, [c for c in (columns or df.columns) if c not in keys])
    free = [s for s in specs if s.kind != "identifier" and s.nulls < s.n and (s.ndv is None or s.ndv > 1)]
    knots = quantile_knots(df, {s.name: as_double(s.name, s.type) for s in free if s.kind == "continuous"})
    shares = _shares(df, [s for s in free if s.kind == "categorical"])
    fitted = []
    for s in specs:
        kind, nulls = s.type.simpleString(), s.nulls / s.n if s.n else 0.0
        if s.kind == "identifier":
            fitted += [Fitted(s.name, kind, "surrogate")] if surrogates else []
        elif s.name in knots:
            fitted.append(Fitted(s.name, kind, "continuous", nulls, knots=knots[s.name]))
        elif s.name in shares:
            fitted.append(Fitted(s.name, kind, "categorical", nulls, values=shares[s.name][0], through=shares[s.name][1]))
        else:
            fitted.append(Fitted(s.name, kind, "copied"))
    model = Model(keys, seed, k, float(mix_prob), specs[0].n if specs else 0, fitted)
    if model.n_scores:
        values, vectors = np.linalg.eigh(correlation(df, model))
        r = (vectors * np.maximum(values, RIDGE)) @ vectors.T
        model.lower = np.linalg.cholesky(r / np.sqrt(np.outer(np.diag(r), np.diag(r)))).tolist()
    return model


def generate(
    df: DataFrame, key: str | list[str], k: int = 2, mix_prob: float = 0.75, seed: int | None = None, columns: list[str] | None = None, keep_key: bool = True, surrogates: bool = False
) -> TwinResult:
    """A twin with a row for each row of ``df``.

    ``key`` names columns that make rows unique; they seed the row's noise and are
    kept as they are (or dropped). NaN and infinity count as nulls. Text with more than 50 values is left out or,
    with ``surrogates``, replaced value by value; constant or all-null columns are copied.
    """
    began = time.time()
    model = fit(df, key, k, mix_prob, seed, columns, surrogates)
    took = time.time() - began
    return TwinResult(twin_of(finite(df), model, keep_key), provenance(df.sparkSession, model, took), model)


def provenance(spark, model: Model, seconds: float = 0.0) -> DataFrame:
    """What a twin was made with; ``run_seconds`` are those of the fit, to which those of writing are added."""
    listed = json.dumps({c.name: c.kind for c in model.columns})
    return spark.createDataFrame([(model.seed, model.k, model.mix_prob, model.n_rows, len(model.columns), listed, __version__, None, round(seconds, 3))], PROVENANCE_SCHEMA)
