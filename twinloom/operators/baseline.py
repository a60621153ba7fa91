"""The column-shuffled baseline: every column permuted by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinloom.functions.permutation import Permutation, permuted, round_keys
from twinloom.operators.ranking import ranked


def shuffle_columns(df: DataFrame, key: str, columns: list[str], seed: int) -> DataFrame:
    """(key, columns): each value goes to the row whose rank by key is the permuted rank of its own, by another bijection a column.

    Rows are ranked once; then every value travels to its new row in one shuffle.
    """
    rows = ranked(df.select(key, *columns), [F.col(key).asc()], "_rank")
    n = rows.count()
    to = [f"_to{i}" for i in range(len(columns))]
    moved = permuted(rows, "_rank", {y: Permutation(n, round_keys(seed, f"shuffle:{c}")) for y, c in zip(to, columns)})
    names = [key, *columns]
    kinds = dict(df.select(*names).dtypes)

    def parcel(target: str, name: str):
        return F.struct(F.col(target).alias("_at"), *[(F.col(f"`{c}`") if c == name else F.lit(None).cast(kinds[c])).alias(f"_v{i}") for i, c in enumerate(names)])

    parcels = moved.select(F.inline(F.array(*[parcel(t, c) for t, c in zip(["_rank", *to], names)])))
    found = parcels.groupBy("_at").agg(*[F.first(f"_v{i}", ignorenulls=True).alias(c) for i, c in enumerate(names)])  # one value a place
    return found.drop("_at")
