"""Tables in CSV or Parquet, twins with their provenance beside them, certificates."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinloom.operators.generate import PROVENANCE_SCHEMA, TwinResult
from twinloom.operators.model import Model


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet folder or file, or CSV with a header; types are inferred where no schema is given."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def sidecar(path: str) -> str:
    return path.rstrip("/") + ".twin.json"


def default_output(path: str) -> str:
    stem, dot, ending = path.rstrip("/").rpartition(".")
    return f"{stem}_twin.{ending}" if dot and "/" not in ending else path.rstrip("/") + "_twin"


def model_path(path: str) -> str:
    return path.rstrip("/") + ".model.json"


def write_twin(result: TwinResult, path: str, single_file: bool = False, load_seconds: float | None = None) -> DataFrame:
    """The twin at ``path``, and beside it its provenance and its model, each in a folder of one JSON line. Returns the provenance, with the seconds that it took."""
    began = time.time()
    df = result.df.coalesce(1) if single_file else result.df
    if path.rstrip("/").endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    else:
        df.write.mode("overwrite").option("header", True).csv(path)
    took = time.time() - began
    done = result.provenance.withColumns({"load_seconds": F.lit(load_seconds).cast("double"), "run_seconds": F.round(F.col("run_seconds") + took, 3)})
    done.coalesce(1).write.mode("overwrite").json(sidecar(path))
    write_model(done.sparkSession, result.model, model_path(path))
    return done


def write_model(spark: SparkSession, model: Model, path: str) -> None:
    spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_model(spark: SparkSession, path: str) -> Model:
    """A model written beside a twin, to make twins without fitting."""
    return Model.from_json(spark.read.text(path).first().value)


def read_provenance(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROVENANCE_SCHEMA).json(sidecar(path))


def as_json(df: DataFrame) -> str:
    """The first row as JSON."""
    return df.toJSON().first()
