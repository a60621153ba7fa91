"""Attacks on a twin: singling-out, linkability and inference, against a shuffled baseline.

An attack sample has a fixed number of rows, which are sent to the tasks; the other
side is read once for all questions and reduced where it lies, so nothing of its
size is moved.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from twinloom.functions.rng import hash_uniform
from twinloom.operators.neighbours import Question, encodable, matches_of, nearest_of
from twinloom.operators.profile import ColumnSpec
from twinloom.operators.quantiles import exact_quantiles

MAX_ATTACKS = 10_000


def attack_sample(df: DataFrame, key: str, n: int, seed: int, salt: str = "attack") -> DataFrame:
    """The ``n`` rows with the smallest hashes: the same for any layout."""
    if n > MAX_ATTACKS:
        raise ValueError(f"at most {MAX_ATTACKS} attacks")
    u = hash_uniform(seed, salt, F.col(key))
    return df.withColumn("_u", u).orderBy("_u", key).limit(n).drop("_u")


def attack_samples(df: DataFrame, key: str, n: int, seed: int, salts: list[str], rows: int | None = None) -> list[list[Row]]:
    """The rows of :func:`attack_sample` for each salt, in their order, from one scan.

    ``rows`` is about the size of the table, counted if it isn't given. Rows whose hash is small for
    some salt are few; should they be too few for one, the bound is raised.
    """
    if n > MAX_ATTACKS:
        raise ValueError(f"at most {MAX_ATTACKS} attacks")
    rows = df.count() if rows is None else rows
    bound = min(1.0, (2 * n + 50) / max(rows, 1))
    hashed = df.withColumn("_u", F.array(*[hash_uniform(seed, salt, F.col(key)) for salt in salts]))
    best = Window.partitionBy("_set").orderBy("_v", key)
    while True:
        near = hashed.where(F.array_min("_u") <= bound).select(*df.columns, F.posexplode("_u").alias("_set", "_v")).where(F.col("_v") <= bound)
        found: list[list[Row]] = [[] for _ in salts]
        for r in near.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= n).orderBy("_set", "_place").collect():
            found[r._set].append(r)
        if bound >= 1 or all(len(f) >= n for f in found):
            return found
        bound = min(1.0, 4 * bound)


def draw(names: list[str], n: int, seed: int, salt: str) -> list[str]:
    """``n`` of the names, in the order of their hashes."""
    return sorted(names, key=lambda c: hashlib.md5(f"{seed}|{salt}|{c}".encode()).hexdigest())[:n]


def _rows(df: DataFrame, specs: list[ColumnSpec], key: str, columns: list[str], n: int, seed: int, salts: list[str]) -> list[list[Row]]:
    """Attack samples as encodable rows, with the key."""
    known = {s.name: s for s in specs}
    return attack_samples(df.select(key, *[encodable(known[c]).alias(c) for c in columns]), key, n, seed, salts, specs[0].n if specs else None)


def real_samples(real: DataFrame, specs: list[ColumnSpec], key: str, columns: list[str], n: int, seed: int, reps: list[int]) -> dict[str, list[Row]]:
    """The attacked rows of linkability and of each replicate of inference, from one scan; they serve any twin."""
    salts = ["link", *[f"infer:{rep}" for rep in reps]]
    return dict(zip(salts, _rows(real, specs, key, columns, n, seed, salts)))


def _keys(df: DataFrame, key: str, rows: list[Row], alias: str, number: str) -> DataFrame:
    """The keys of collected rows with their numbers."""
    kind = df.schema[key].dataType.simpleString()
    return df.sparkSession.createDataFrame([(i, r[key]) for i, r in enumerate(rows)], f"{number} int, `{alias}` {kind}")


def nearest(attacks: DataFrame, twin: DataFrame, specs: list[ColumnSpec], key: str, columns: list[str], k: int = 1) -> DataFrame:
    """a_key, rank, dist (rounded to 9 digits) and t_key: the k nearest twin rows of each attack, by the sum of the columns' distances.

    Ties go to the smaller twin key.
    """
    known = {s.name: s for s in specs}
    rows = attacks.select(key, *[encodable(known[c]).alias(c) for c in columns]).limit(MAX_ATTACKS + 1).collect()
    if len(rows) > MAX_ATTACKS:
        raise ValueError(f"at most {MAX_ATTACKS} attacks")
    found = nearest_of(twin, key, specs, rows, [Question(0, len(rows), columns)], k)
    merged = found.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("dist", "t_key"))).where(F.col("rank") <= k)
    return merged.join(F.broadcast(_keys(attacks, key, rows, "a_" + key, "a")), "a").select("a_" + key, "rank", "dist", F.col("t_key").alias("t_" + key))


def linkability(real: DataFrame, twin: DataFrame, specs: list[ColumnSpec], key: str, part_a: list[str], part_b: list[str], n: int, k: int, seed: int, samples: dict[str, list[Row]] | None = None) -> DataFrame:
    """a_key and hit: whether the neighbours by one half of the columns and those by the other share a twin row. Both are found in one scan."""
    rows = (samples or real_samples(real, specs, key, list(dict.fromkeys([*part_a, *part_b])), n, seed, []))["link"]
    asked = [Question(0, len(rows), part_a), Question(0, len(rows), part_b)]
    found = nearest_of(twin, key, specs, rows, asked, k)
    near = found.withColumn("rank", F.row_number().over(Window.partitionBy("a", "q").orderBy("dist", "t_key"))).where(F.col("rank") <= k)
    both = near.groupBy("a", "t_key").agg(F.count_distinct("q").alias("q")).where("q = 2").groupBy("a").agg(F.lit(1).alias("hit"))
    ids = _keys(real, key, rows, "a_" + key, "a")
    return ids.join(both, "a", "left").select("a_" + key, F.coalesce("hit", F.lit(0)).alias("hit"))


def inference(real: DataFrame, twin: DataFrame, specs: list[ColumnSpec], key: str, columns: list[str], secrets: dict[int, list[str]], n: int, seed: int, samples: dict[str, list[Row]] | None = None) -> DataFrame:
    """rep, secret, hits and n: how many secrets the nearest twin row, by all other columns, gives away.

    ``secrets`` are the columns to guess in each replicate, which attacks rows of its own. The twin is
    read once for all replicates and secrets.
    """
    samples = samples or real_samples(real, specs, key, columns, n, seed, list(secrets))
    rows, asked, listed = [], [], []
    for rep, names in secrets.items():
        first = len(rows)
        rows += samples[f"infer:{rep}"]
        for s in names:
            listed.append((len(asked), rep, s))
            asked.append(Question(first, len(rows), [c for c in columns if c != s], s))
    names = real.sparkSession.createDataFrame(listed, "q int, rep int, secret string")
    found = nearest_of(twin, key, specs, rows, asked)
    best = found.groupBy("q", "a").agg(F.min(F.struct("dist", "t_key", "right")).alias("m"))
    counts = best.groupBy("q").agg(F.sum(F.col("m.right").cast("long")).alias("hits"), F.count("*").alias("n"))
    return names.join(counts, "q", "left").select("rep", "secret", "hits", F.coalesce("n", F.lit(0)).alias("n"))


def medians(real: DataFrame, specs: list[ColumnSpec], columns: list[str]) -> dict[str, float]:
    """The exact lower medians of the continuous columns."""
    numbers = {s.name: F.col(f"`{s.name}`").cast("double") for s in specs if s.kind == "continuous" and s.name in columns}
    return {c: q[1] for c, q in exact_quantiles(real, numbers, 2).items() if q}


def singling_out(real: DataFrame, twin: DataFrame, specs: list[ColumnSpec], key: str, columns: list[str], middle: dict[str, float], n: int, seed: int, most: int | None = None) -> DataFrame:
    """p_key and matches: how many real rows meet the predicate made from a sampled twin row.

    Categories have to be equal; numbers lie on the twin value's side of the median, beyond it. With
    ``most``, a task stops testing a predicate that has met so many, and more count as that many.
    """
    known = {s.name: s for s in specs}
    rows = _rows(twin, specs, key, columns, n, seed, ["single"])[0]
    found = matches_of(real, [known[c] for c in columns], rows, middle, most)
    ids = _keys(twin, key, rows, "p_" + key, "p")
    return ids.join(found, "p", "left").select("p_" + key, F.coalesce("n", F.lit(0)).alias("matches"))


def uniques(real: DataFrame, column: str) -> DataFrame:
    """How many values of a column single out a row by themselves: a diagnostic."""
    return real.groupBy(column).count().agg(F.count(F.when(F.col("count") == 1, 1)).alias("unique_values"), F.count("*").alias("distinct_values"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of a rate."""
    p = hits / n
    mid, half = (p + z * z / (2 * n)), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.greatest((mid - half) / (1 + z * z / n), F.lit(0.0)), F.least((mid + half) / (1 + z * z / n), F.lit(1.0))


def normalised(rate: Column, base: Column) -> Column:
    """100 where a twin leaks no more than the shuffled table, 0 where every attack succeeds; null if the base is 1."""
    risk = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(rate - base, 1 - base)))
    return F.when(base < 1, 100 * (1 - risk))
