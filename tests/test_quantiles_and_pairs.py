import numpy as np
import pytest
from pyspark.sql import functions as F

from twinloom.operators import fidelity, quantiles


def _expected(x, parts):
    x = np.sort(x)
    return [float(x[max(1, -(-i * len(x) // parts)) - 1]) for i in range(parts + 1)]


@pytest.mark.parametrize("left", [20_000, 3])
def test_quantiles_are_exact(spark, monkeypatch, left):
    monkeypatch.setattr(quantiles, "LEFT", left)
    rng = np.random.default_rng(3)
    n = 3000
    data = {
        "flat": rng.random(n), "normal": rng.normal(size=n), "heavy": np.exp(rng.normal(size=n) * 30), "ties": rng.integers(0, 4, n).astype(float), "one": np.full(n, 7.5), "signs": np.where(rng.random(n) < 0.5, -0.0, 0.0),
        "wide": np.where(rng.random(n) < 0.5, -1.7e308, 1.7e308) * rng.random(n), "tiny": 1 + np.arange(n) % 5 * 2.0**-52, "spike": np.where(rng.random(n) < 0.9, 1.0, rng.random(n) * 1e9),
    }
    df = spark.createDataFrame([tuple(float(v[i]) for v in data.values()) for i in range(n)], ", ".join(f"{c} double" for c in data)).repartition(5)
    df = df.withColumn("holes", F.when(F.col("flat") < 0.3, F.col("normal"))).withColumn("none", F.lit(None).cast("double"))
    data["holes"] = data["normal"][data["flat"] < 0.3]
    for parts in (1, 2, 101):
        found = quantiles.exact_quantiles(df, {c: F.col(c) for c in [*data, "none"]}, parts)
        assert found.pop("none") is None
        assert found == {c: _expected(x, parts) for c, x in data.items()}
    assert quantiles.exact_quantiles(df.where("false"), {"flat": F.col("flat")}, 4) == {"flat": None} and quantiles.exact_quantiles(df, {}, 4) == {}


def test_pairs_of_many_columns(spark):
    """500 columns in one pass, with nulls, far from zero."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 500)) @ rng.normal(size=(500, 500)) / 20 + 1e6
    x[rng.random(x.shape) < 0.05] = np.nan
    x[:, 7] = 3.0
    names = [f"c{i}" for i in range(500)]
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame(x, columns=names)).repartition(3)
    df = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in names])
    expected = pd.DataFrame(x, columns=names).corr(min_periods=2)
    found = fidelity.pairwise(df, names).toPandas()
    assert len(found) == 500 * 499 // 2
    got = expected.to_numpy()[[int(a[1:]) for a in found.a], [int(b[1:]) for b in found.b]]
    known = ~np.isnan(got)
    assert np.isnan(found["corr"].to_numpy(dtype=float))[~known].all() and np.abs(found["corr"].to_numpy(dtype=float)[known] - got[known]).max() < 1e-7
    native = df.agg(*[F.covar_samp("c1", c).alias(c) for c in ("c2", "c3")]).first()
    covar = {(r.a, r.b): r.covar for r in fidelity.pairwise(df, ["c1", "c2", "c3"], "covar").collect()}
    assert covar["c1", "c2"] == pytest.approx(native.c2, rel=1e-9) and covar["c1", "c3"] == pytest.approx(native.c3, rel=1e-9)
    with pytest.raises(ValueError):
        fidelity.pairwise(df, ["c1"])
