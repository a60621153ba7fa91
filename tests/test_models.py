"""Fitted models, surrogates of texts, and correlations behind categories."""

import random
import string

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from conftest import duck
from pyspark.sql import functions as F

from twinloom.cli import main
from twinloom.functions.surrogate import MARK, surrogate_sql, surrogate_text, surrogates
from twinloom.operators import latent
from twinloom.operators.generate import fit, generate
from twinloom.operators.latent import contingency, polychoric, polyserial, table_shares
from twinloom.operators.model import Model, twin_of
from twinloom.sources.io import model_path, read_model, write_twin
from twinloom.storage import written

TEXTS = ["", "a", "Z9", "John Smith", "+44 20 7946-0958", "x" * 70, "Ärger", "日本", "ABC-123-xyz", "ÿ" * 9, "a\nb", "0", "|", "¤1"]


@pytest.fixture(scope="module")
def table(spark):
    i = F.col("id")
    x = F.sin(i * 12.9898)
    return spark.range(2500).select(
        i, x.alias("x"), (0.8 * x + 0.3 * F.cos(i * 78.233)).alias("y"), F.floor(F.least(F.greatest(x * 3 + F.cos(i * 7.7), F.lit(-2)), F.lit(2))).cast("int").alias("grade"),
        F.when(i % 7 != 0, F.pmod(F.hash(i), F.lit(1000))).alias("holes"), F.concat(F.lit("Name "), i).alias("name"), F.lit(3).alias("same"), F.when(i % 5 > 0, x > 0).alias("flag"),
        F.timestamp_seconds(i * 977).alias("at"), F.date_add(F.lit("2020-01-01").cast("date"), (i % 365).cast("int")).alias("day"), (x * 100).cast("decimal(9,2)").alias("price"), F.lit(None).cast("string").alias("none"),
    )


def test_a_model_makes_the_same_twin_again(spark, table, tmp_path):
    result = generate(table, "id", seed=5, surrogates=True)
    twin = written(result.df, "twin")
    assert twin.dtypes == table.dtypes and twin.count() == 2500
    again = Model.from_json(result.model.to_json())
    assert again == result.model and twin_of(table.repartition(5), again).exceptAll(twin).count() == 0
    done = write_twin(result, f"{tmp_path}/t.parquet", load_seconds=1.5).first()
    assert done.load_seconds == 1.5 and done.run_seconds > 0
    stored = read_model(spark, model_path(f"{tmp_path}/t.parquet"))
    assert stored == result.model
    some = table.where("id % 10 = 3")
    assert twin_of(some, stored).exceptAll(twin.where("id % 10 = 3")).count() == 0


def test_twins_do_not_depend_on_the_layout(spark):
    """Above the 20,000 values to which quantile sketches would be exact."""
    x = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").withColumn("key", F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")).select("key", "l_quantity", "l_extendedprice", "l_tax", "l_returnflag")
    a, b = (fit(t, "key", seed=2) for t in (x, x.repartition(13, "l_tax")))
    assert a.columns == b.columns and np.abs(np.array(a.lower) - np.array(b.lower)).max() < 1e-8
    assert a.to_json() == b.to_json()


def test_fresh_draws_keep_correlations_of_categories(spark):
    """Both twins of graded columns, one that keeps ranks and one that draws afresh, are correlated as the real table."""
    rng = np.random.default_rng(4)
    n = 20_000
    z = rng.multivariate_normal([0, 0, 0], [[1, 0.7, 0.5], [0.7, 1, -0.3 + 0.6], [0.5, 0.3, 1]], n)
    df = spark.createDataFrame([(i, int(a > 0.8) + int(a > -0.2), int(b > 1) + int(b > 0) + int(b > -1), float(c)) for i, (a, b, c) in enumerate(z)], "id long, a int, b int, c double")
    corr = lambda d: np.array(d.agg(F.corr("a", "b"), F.corr("a", "c"), F.corr("b", "c")).first())
    real = corr(df)
    for mix in (0.0, 0.75, 1.0):
        assert np.abs(corr(generate(df, "id", seed=3, mix_prob=mix).df) - real).max() < 0.05, mix


def test_polychoric_and_polyserial():
    rng = np.random.default_rng(6)
    a, b = np.array([-np.inf, -0.5, 0.4, np.inf]), np.array([-np.inf, 0.2, np.inf])
    for r in (-0.9, -0.4, 0.0, 0.3, 0.8):
        z = rng.multivariate_normal([0, 0], [[1, r], [r, 1]], 200_000)
        counts = np.histogram2d(z[:, 0], z[:, 1], [np.clip(a, -9, 9), np.clip(b, -9, 9)])[0]
        shares = table_shares(a, b, r)
        assert shares.sum() == pytest.approx(1, abs=1e-6) and np.abs(shares - counts / counts.sum()).max() < 5e-3
        assert polychoric(counts, a, b) == pytest.approx(r, abs=0.02)
        sums = np.array([z[(z[:, 1] >= lo) & (z[:, 1] < hi), 0].sum() for lo, hi in zip(b[:-1], b[1:])])
        assert polyserial(sums, len(z), b) == pytest.approx(r, abs=0.02)
    assert polychoric(np.zeros((3, 2)), a, b) == 0


def test_tables_of_categories(spark):
    df = spark.createDataFrame([(1, "a", True), (1, "a", None), (2, None, True), (1, "b", True)], "g int, t string, f boolean")
    assert sorted(map(tuple, contingency(df, ["g", "t", "f"]).collect())) == [("g", "f", "1", "true", 2), ("g", "f", "2", "true", 1), ("g", "t", "1", "a", 2), ("g", "t", "1", "b", 1), ("t", "f", "a", "true", 1), ("t", "f", "b", "true", 1)]


def test_surrogates_are_one_to_one_and_keep_the_form():
    random.seed(1)
    texts = TEXTS + ["".join(random.choices(string.ascii_letters + string.digits + " -", k=random.randint(1, 12))) for _ in range(2000)]
    texts = list(dict.fromkeys(texts))
    made = surrogates(pa.array([*texts, None, texts[3]]), "9|t").to_pylist()
    assert made[-2:] == [None, made[3]] and made[: len(texts)] == [surrogate_text(t, "9|t") for t in texts]
    found = dict(enumerate(made[: len(texts)]))
    plain = [t for t in texts if t.isascii()]
    sql = duck(f"WITH {surrogate_sql('s', 'texts', 't', '9|t')} SELECT i, t FROM s", {"texts": pd.DataFrame({"i": range(len(plain)), "t": plain})})
    assert dict(zip(sql.i, sql.t)) == {i: surrogate_text(t, "9|t") for i, t in enumerate(plain)}
    assert len(set(found.values())) == len(texts)
    form = lambda t: "".join("A" if c in string.ascii_uppercase else "a" if c in string.ascii_lowercase else "0" if c in string.digits else c for c in t)
    for t, s in zip(texts, found.values()):
        assert form(t) == form(s) if t.isascii() else s[0] == MARK and s[1:].isascii()
    kept = sum(t == s for t, s in zip(texts, found.values()) if len(t) > 3)
    assert kept < 10
    # every text of a small form is met once: the map is a bijection of the form
    small = [a + b for a in string.ascii_lowercase for b in string.digits]
    assert sorted(surrogate_text(t, "k") for t in small) == sorted(small)


def test_surrogates_in_a_twin(table):
    twin = generate(table, "id", seed=5, surrogates=True).df
    assert twin.select("name").distinct().count() == 2500 and twin.where("name rlike '^[A-Z][a-z]{3} [0-9]+$'").count() == 2500
    both = twin.select("id", "name").join(table.select("id", F.col("name").alias("real")), "id")
    assert both.where("name = real").count() < 5
    assert "name" not in generate(table, "id", seed=5).df.columns


def test_demo(spark, capsys):
    assert main(["demo"], spark) == 0
    assert '"fidelity"' in capsys.readouterr().out


def test_correlation_takes_random_words_for_null_numbers_alone(spark):
    """Sums over categories and whole numbers need no digest of the key, so the key is not even read."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=500)
    rows = [(i, float(v), "ab"[int(v + e > 0)], None if i % 7 == 0 else float(v + e)) for i, (v, e) in enumerate(zip(x, rng.normal(size=500)))]
    df = spark.createDataFrame(rows, "id long, x double, c string, y double")
    whole, holed = fit(df, "id", seed=3, columns=["x", "c"]), fit(df, "id", seed=3, columns=["x", "c", "y"])
    assert latent.takes_digests(holed) and not latent.takes_digests(whole)
    r = latent.correlation(df.drop("id"), whole)
    assert 0.5 < r[0, 1] < 0.9
    assert np.abs(r - latent.correlation(df, holed)[:2, :2]).max() == 0
