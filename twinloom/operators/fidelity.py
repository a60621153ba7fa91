"""How well a twin keeps means, variances, correlations and distributions (0 to 100)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinloom.operators import gram
from twinloom.operators.ranking import running_sums


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, mean and variance, a row a column."""
    parts = [F.struct(F.lit(c).alias("column_name"), F.avg(F.col(c).cast("double")).alias("mean"), F.var_samp(F.col(c).cast("double")).alias("variance")) for c in columns]
    return df.agg(F.array(*parts).alias("m")).select(F.inline("m"))


def fidelity_mean(real: DataFrame, twin: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: 100 less the shift of the mean in standard deviations of the real column."""
    r = moments(real, columns)
    t = moments(twin, columns).select("column_name", F.col("mean").alias("twin_mean"))
    shift = F.abs(F.col("twin_mean") - F.col("mean")) / F.sqrt("variance")
    score = F.when(F.col("variance") > 0, 100 * F.greatest(F.lit(0.0), 1 - shift)).otherwise(F.when(F.col("twin_mean") == F.col("mean"), 100.0).otherwise(0.0))
    return r.join(t, "column_name").select("column_name", score.alias("score"))


def fidelity_variance(real: DataFrame, twin: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: 100 times the smaller of both variances over the larger."""
    r = moments(real, columns)
    t = moments(twin, columns).select("column_name", F.col("variance").alias("twin_variance"))
    top = F.greatest("variance", "twin_variance")
    score = F.when(top > 0, 100 * F.least("variance", "twin_variance") / top).otherwise(100.0)
    return r.join(t, "column_name").select("column_name", score.alias("score"))


def pairwise(df: DataFrame, columns: list[str], what: str = "corr") -> DataFrame:
    """a, b and corr (or covar) of every pair of columns, all pairs in one pass; rows with both values count for a pair."""
    if len(columns) < 2:
        raise ValueError("pairs need two columns")
    numbers = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    return gram.pairs(numbers, columns, what, centre=gram.near_means(numbers, numbers.columns))


def fidelity_correlation(real: DataFrame, twin: DataFrame, shuffled: DataFrame, columns: list[str]) -> DataFrame:
    """One row: 100 less the twin's mean deviation of correlations, relative to that of the shuffled table."""
    r = pairwise(real, columns)
    t = pairwise(twin, columns).withColumnRenamed("corr", "twin")
    s = pairwise(shuffled, columns).withColumnRenamed("corr", "shuffled")
    off = r.join(t, ["a", "b"]).join(s, ["a", "b"]).agg(F.avg(F.abs(F.col("corr") - F.col("twin"))).alias("t"), F.avg(F.abs(F.col("corr") - F.col("shuffled"))).alias("s"))
    return off.select((100 * F.greatest(F.lit(0.0), 1 - F.try_divide("t", "s"))).alias("score"))


def ks(real: DataFrame, twin: DataFrame, columns: list[str]) -> DataFrame:
    """column_name and ks, the largest distance of both distribution functions.

    Values are counted per column first; the running sums then run over ranges of
    distinct values, with the sums of the ranges before added.
    """
    def long(df: DataFrame, side: str) -> DataFrame:
        parts = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns])
        return df.select(F.inline(parts)).where("v is not null").select("column_name", "v", F.lit(int(side == "r")).alias("r"), F.lit(int(side == "t")).alias("t"))

    counts = long(real, "r").unionByName(long(twin, "t")).groupBy("column_name", "v").agg(F.sum("r").alias("r"), F.sum("t").alias("t"))
    total = counts.groupBy("column_name").agg(F.sum("r").alias("nr"), F.sum("t").alias("nt"))
    steps = running_sums(counts, "column_name", "v", ["r", "t"])
    gap = F.abs(F.try_divide("run_r", "nr") - F.try_divide("run_t", "nt"))
    return steps.join(F.broadcast(total), "column_name").groupBy("column_name").agg(F.max(gap).alias("ks"))


def fidelity_ks(real: DataFrame, twin: DataFrame, columns: list[str]) -> DataFrame:
    return ks(real, twin, columns).select("column_name", (100 * (1 - F.col("ks"))).alias("score"))


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)
