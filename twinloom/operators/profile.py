"""What the columns of a table are: counts, moments, and their kind."""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Context, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CATEGORICAL_MAX = 10
STRING_MAX = 50
#: Sketches of distinct values hold at least 2**8 of them, and are exact while they hold all.
SKETCH = 8


class UnsupportedColumnError(TypeError):
    """A column of a type that no operator takes."""


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: T.DataType
    kind: str  # categorical, continuous, identifier
    n: int
    nulls: int
    ndv: int | None  # up to STRING_MAX, else None
    low: float | None
    high: float | None
    mean: float | None
    variance: float | None


def as_double(name: str, kind: T.DataType) -> Column:
    """Numbers as they are, dates as days and timestamps as seconds of the epoch; null for others, and for NaN and infinity."""
    c = F.col(f"`{name}`")
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return F.when(F.abs(c) < float("inf"), c.cast("double"))
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c) / 1e6
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{name}`) / 1e6D")
    return F.lit(None).cast("double")


def _value(name: str, kind: T.DataType) -> Column:
    """What a sketch of distinct values takes: equal if and only if the values are. It ignores empty texts, so texts get a letter."""
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return as_double(name, kind)
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return (c.cast("int") if isinstance(kind, T.BooleanType) else c).cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    return F.concat(F.lit("v"), c.cast("string"))


def finite(df: DataFrame) -> DataFrame:
    """``df`` with null for NaN and infinity: to all operators they are missing values."""
    floats = [f for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({f.name: as_double(f.name, f.dataType).cast(f.dataType) for f in floats})


def as_numbers(df: DataFrame, but: str) -> DataFrame:
    """``df`` with dates and times as numbers, and null for what is not finite; the column ``but`` stays."""
    kinds = (T.FloatType, T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType)
    changed = [f for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name != but]
    return df.withColumns({f.name: as_double(f.name, f.dataType) for f in changed})


def profile(df: DataFrame, columns: list[str] | None = None) -> list[ColumnSpec]:
    """One pass for counts, moments and the number of values.

    Distinct values are gathered in sketches that are exact up to 2**SKETCH values, more
    than any cut asks for, and do not grow beyond.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    for f in fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
            raise UnsupportedColumnError(f"column {f.name} has type {f.dataType.simpleString()}")
    aggs = [F.count("*").alias("n")]
    for i, f in enumerate(fields):
        x = as_double(f.name, f.dataType)
        c = x if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(f"`{f.name}`")
        aggs += [
            F.count(c).alias(f"c{i}"), F.theta_sketch_estimate(F.theta_sketch_agg(_value(f.name, f.dataType), SKETCH)).alias(f"a{i}"), F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}"),
            F.avg(x).alias(f"m{i}"), F.var_samp(x).alias(f"v{i}"), F.min((x == F.floor(x)).cast("int")).alias(f"w{i}"),
        ]
    row = df.agg(*aggs).first()
    ndv = {i: row[f"a{i}"] for i in range(len(fields)) if row[f"a{i}"] <= STRING_MAX}
    out = []
    for i, f in enumerate(fields):
        n_values = ndv.get(i)
        number = isinstance(f.dataType, T.NumericType)
        if isinstance(f.dataType, T.StringType):
            kind = "categorical" if n_values is not None and n_values <= STRING_MAX else "identifier"
        elif isinstance(f.dataType, T.BooleanType) or (number and n_values is not None and n_values <= CATEGORICAL_MAX and row[f"w{i}"] != 0):
            kind = "categorical"
        else:
            kind = "continuous"
        out.append(
            ColumnSpec(f.name, f.dataType, kind, row["n"], row["n"] - row[f"c{i}"], n_values if n_values is not None and n_values <= STRING_MAX else None,
                       row[f"l{i}"], row[f"h{i}"], row[f"m{i}"], row[f"v{i}"])
        )
    return out


PROFILE_SCHEMA = "column_name string, kind string, n long, nulls long, ndv long, low double, high double, mean double, variance double"


def _half_up(x: float | None, digits: int) -> float | None:
    """Rounded as SQL does: a five at the end goes up."""
    if x is None or not math.isfinite(x):
        return x
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP, Context(prec=400)))


def profile_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The profile as a table, a row a column; mean and variance rounded to 4 and 2 digits."""
    rows = [
        (s.name, s.kind, s.n, s.nulls, s.ndv, s.low, s.high, _half_up(s.mean, 4), _half_up(s.variance, 2))
        for s in profile(df, columns)
    ]
    return df.sparkSession.createDataFrame(rows, PROFILE_SCHEMA)
