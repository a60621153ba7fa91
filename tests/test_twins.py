import json

import pytest
from pyspark.sql import functions as F

from twinloom.cli import main
from twinloom.operators.evaluate import certify, evaluate
from twinloom.operators.generate import generate, retained
from twinloom.operators.profile import UnsupportedColumnError, profile
from twinloom.operators.ranking import ranked
from twinloom.sources.io import default_output, read_provenance, read_table, write_twin
from twinloom.storage import written


@pytest.fixture(scope="module")
def table(spark):
    i = F.col("id")
    x = F.sin(i * 12.9898)
    return spark.range(600).select(
        i, x.alias("x"), (0.8 * x + 0.3 * F.cos(i * 78.233)).alias("y"), (i % 2).alias("flag"), (i % 5).cast("int").alias("grade"),
        F.when(i % 7 != 0, F.pmod(F.hash(i), F.lit(1000))).alias("holes"), F.concat(F.lit("n"), i).alias("name"), F.lit(3).alias("same"),
    )


def test_kinds(table):
    kinds = {s.name: s.kind for s in profile(table)}
    assert kinds == {"id": "continuous", "x": "continuous", "y": "continuous", "flag": "categorical", "grade": "categorical", "holes": "continuous", "name": "identifier", "same": "categorical"}


def test_boundary_of_categories(spark):
    df = spark.range(110).select((F.col("id") % 10).alias("c10"), (F.col("id") % 11).alias("c11"), (F.col("id") % 3 / 2).alias("half"))
    assert [s.kind for s in profile(df)] == ["categorical", "continuous", "continuous"]


def test_nested_columns_are_refused(spark):
    with pytest.raises(UnsupportedColumnError, match="arr"):
        profile(spark.sql("SELECT 1 AS id, array(1) AS arr"))


def test_twin_keeps_what_it_should(table):
    result = generate(table, "id", seed=9)
    twin = result.df.persist()
    assert twin.count() == table.count() and "name" not in twin.columns
    assert {r.grade for r in twin.select("grade").distinct().collect()} <= set(range(5))
    corr = lambda d: d.select(F.corr("x", "y")).first()[0]
    assert abs(corr(twin) - corr(table)) < 0.1
    assert abs(twin.where("holes is null").count() - table.where("holes is null").count()) < 60
    assert twin.where("same <> 3").count() == 0
    again = generate(table.repartition(7), "id", seed=9).df
    assert twin.exceptAll(again).count() == 0
    assert result.provenance.first().seed == 9


def test_more_passes_keep_less():
    assert retained(0.75, 1) > retained(0.75, 2) > retained(0.75, 6) and retained(0, 3) == 1 and retained(1, 1) == 0


def test_evaluation_ends(table):
    real = table.select("id", "x", "y", "grade")
    same = evaluate(real, real, "id", n_attacks=50, n_reps=1, seed=1).first()
    assert same.fidelity.asDict()["composite"] == pytest.approx(100) and same.privacy.inference < 50
    twin = generate(real, "id", seed=1)
    page = certify(real, twin.df, twin.provenance, "id", k=3, n_attacks=20, n_reps=1)
    assert page.startswith("<!DOCTYPE html>") and "Provenance" in page
    assert evaluate(real, real, "id", skip_privacy=True, seed=1).first().privacy is None


def test_small_and_odd_tables(spark):
    three = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 4.0), (3, 5.0, 6.0)], "id int, a double, b double")
    assert generate(three, "id", seed=1).df.count() == 3
    assert evaluate(three, three, "id", n_attacks=500, n_reps=1, seed=1).count() == 1
    empty = three.where("id > 9")
    assert generate(empty, "id", seed=1).df.count() == 0
    one = three.select("id", "a")
    assert evaluate(one, one, "id", n_attacks=5, n_reps=1, seed=1).first().privacy.linkability is None


def test_ranks(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v"))
    assert ranked(df, [F.col("v")], "r").where("r <> v").count() == 0


def test_files_and_cli(spark, table, tmp_path, capsys):
    path = f"{tmp_path}/real.csv"
    table.select("id", "x", "grade").coalesce(1).write.option("header", True).csv(path)
    assert default_output(path) == f"{tmp_path}/real_twin.csv"
    assert main(["generate", path, "--key", "id", "--seed", "5", "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["seed"] == 5
    twin = f"{tmp_path}/real_twin.csv"
    assert read_table(spark, twin).count() == 600 and read_provenance(spark, twin).first().k == 2
    page = f"{tmp_path}/c.html"
    assert main(["certify", path, twin, "--key", "id", "--skip-privacy", "-o", page, "--seed", "3"], spark) == 0
    assert "Fidelity" in open(page).read()
    write_twin(generate(table, "id", seed=1), f"{tmp_path}/t.parquet")
    assert read_table(spark, f"{tmp_path}/t.parquet").count() == 600


def test_dates_and_missing_numbers(spark):
    """Dates and times take part in every score; NaN and infinity are missing values."""
    i = F.col("id")
    real = spark.range(300).select(
        i, F.date_add(F.lit("2020-01-01").cast("date"), (i * 7 % 365).cast("int")).alias("day"), F.timestamp_seconds(i * 86_401).alias("at"),
        F.timestamp_seconds(i * 977).cast("timestamp_ntz").alias("local"), F.when(i % 9 == 0, float("nan")).when(i % 11 == 0, float("inf")).otherwise(F.sin(i)).alias("x"),
    )
    spec = {s.name: s for s in profile(real)}
    missing = real.where("isnan(x) or abs(x) = double('inf')").count()
    assert spec["x"].nulls == missing and spec["x"].high <= 1 and spec["day"].kind == "continuous"
    twin = written(generate(real, "id", seed=3).df, "dated")
    assert dict(twin.dtypes)["day"] == "date" and twin.where("isnan(x)").count() == 0
    assert abs(twin.where("x is null").count() - missing) < 40
    scores = evaluate(real, twin, "id", n_attacks=30, n_reps=1, seed=3).first()
    for value in [*scores.fidelity, *scores.privacy]:
        assert value is not None and 0 <= value <= 100
    for low, high in scores.intervals:
        assert 0 <= low <= high <= 1


def test_shared_folders(spark, monkeypatch):
    """Written tables are in the folder that the session names; a cluster without one is told so."""
    import types

    from twinloom import storage

    assert storage.written(spark.range(3), "x").written_to.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert [storage.in_one_process(m) for m in ("local", "local[4]", "local[*]", "local-cluster[2,1,1024]", "yarn", "spark://a:7077")] == [True] * 3 + [False] * 3
    cluster = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None), sparkContext=types.SimpleNamespace(master="yarn"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(cluster)
    table = storage.written(spark.range(3), "x")
    storage.delete(table)
    assert not spark._jvm.org.apache.hadoop.fs.Path(table.written_to).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(table.written_to))
