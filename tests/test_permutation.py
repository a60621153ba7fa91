import numpy as np
import pytest
from pyspark.sql import functions as F

from twinloom.functions.permutation import Permutation, permuted, round_keys
from twinloom.operators.baseline import shuffle_columns
from twinloom.operators.profile import profile


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 10, 97, 1000, 1023, 5000])
def test_every_number_once(n):
    for salt in "abcd":
        p = Permutation(n, round_keys(3, salt))
        a, b = p.sides
        assert n <= a * b <= n + a
        x = np.arange(a * b)
        assert (p.back(p.once(x)) == x).all() and sorted(p.once(x)) == x.tolist()
        y = p.once(np.arange(n))
        for _ in range(p.walks):
            y = np.where(y < n, y, p.once(y))
        assert sorted(y) == list(range(n))


def test_large_numbers_fit():
    p = Permutation(10**15 + 37, round_keys(1, "x"))
    x = np.random.default_rng(1).integers(0, 10**15, 1000)
    assert (p.back(p.once(x)) == x).all() and p.walks < 50


def test_expressions_are_the_same(spark):
    names = {c: Permutation(997, round_keys(8, c)) for c in "uv"}
    found = permuted(spark.range(997), "id", names).toPandas().sort_values("id")
    for c, p in names.items():
        y = p.once(np.arange(997))
        for _ in range(p.walks):
            y = np.where(y < 997, y, p.once(y))
        assert found[c].tolist() == y.tolist()
    assert abs(np.corrcoef(found.u, found.v)[0, 1]) < 0.1 and abs(np.corrcoef(found.u, found.id)[0, 1]) < 0.1


def test_shuffled_columns_keep_their_values(spark):
    i = F.col("id")
    df = spark.range(503).select("id", (i * i).alias("sq"), F.when(i % 3 > 0, F.concat(F.lit("t"), i)).alias("text"), (i % 2 == 0).alias("even"), F.col("id").cast("timestamp").alias("at"))
    found = shuffle_columns(df, "id", ["sq", "text", "even", "at"], 5)
    assert found.columns == df.columns and found.count() == 503
    for c in df.columns:
        assert found.select(c).exceptAll(df.select(c)).count() == 0 and df.select(c).exceptAll(found.select(c)).count() == 0
    moved = found.join(df.select("id", F.col("sq").alias("own")), "id")
    assert moved.where("sq = own").count() < 10 and abs(moved.select(F.corr("sq", "own")).first()[0]) < 0.15
    assert shuffle_columns(df.where("id < 0"), "id", ["sq"], 5).count() == 0
    assert found.exceptAll(shuffle_columns(df.repartition(9), "id", ["sq", "text", "even", "at"], 5)).count() == 0


def test_cuts_are_exact_in_one_pass(spark):
    i = F.col("id")
    df = spark.range(5000).select(
        (i % 10).alias("a10"), (i % 11).alias("a11"), F.concat(F.lit("s"), i % 50).alias("s50"), F.concat(F.lit("s"), i % 51).alias("s51"), F.when(i % 4 == 0, "").when(i % 4 == 1, "x").alias("blank"),
        (i % 3).cast("decimal(9,2)").alias("dec"), (i % 2 == 0).alias("flag"), F.when(i % 2 == 0, -0.0).otherwise(0.0).alias("zero"), F.date_add(F.lit("2020-01-01").cast("date"), (i % 7).cast("int")).alias("day"), F.lit(None).cast("int").alias("none"),
    )
    found = {s.name: (s.kind, s.ndv) for s in profile(df.repartition(13))}
    assert found == {
        "a10": ("categorical", 10), "a11": ("continuous", 11), "s50": ("categorical", 50), "s51": ("identifier", None), "blank": ("categorical", 2), "dec": ("categorical", 3), "flag": ("categorical", 2),
        "zero": ("categorical", 1), "day": ("continuous", 7), "none": ("categorical", 0),
    }
