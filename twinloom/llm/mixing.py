"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

Every source asks for a share of the corpus in proportion to its weight, but
stops at ``max_epochs`` times its own size; what it cannot use is shared again
among the others, until no source is above its cap. A source's documents are
then repeated whole as often as they fit, and a seeded part of them once more.

Edge cases: a null text has size 0; null sources are one source, last in order;
a source without words has target 0; an empty table gives an empty result; rows
that agree in id and text are taken together; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinloom.llm.common import count_spaced
from twinloom.storage import written

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: First-level slices of a source's hash range.
BUCKETS = 4096
#: Sources up to this number are broadcast to the documents (under 1 MB).
BROADCAST_SOURCES = 10_000
_BITS = 60


def seeded_hash(doc_id: Column, text_key: Column, seed: int) -> Column:
    """60 bits of md5 over seed, id and a key of the text."""
    digest = F.md5(
        F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("-")), text_key).cast("binary")
    )
    return F.conv(F.substring(digest, 1, _BITS // 4), 16, 10).cast("long")


def ordered_sources(sizes: DataFrame) -> DataFrame:
    """(source, source_size, weight): one row a source, weights dealt by code-point order, null last.

    The rank comes from range partitions and their offsets, so no task sees all sources.
    """
    grouped = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").asc_nulls_last()]
    ranged = written(
        grouped.repartitionByRange(*order).withColumn("pid", F.spark_partition_id()), "sources"
    )
    counts = ranged.groupBy("pid").agg(F.count("*").alias("n"))
    offsets = counts.select(
        "pid", (F.sum("n").over(Window.orderBy("pid")) - F.col("n")).alias("before")
    )  # one row a partition
    ranked = ranged.join(offsets, "pid").withColumn(
        "rank", F.col("before") + F.row_number().over(Window.partitionBy("pid").orderBy(*order)) - 1
    )
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    return written(ranked.select("source", "source_size", weight.cast("long").alias("weight")), "weights")


def water_level(sources: DataFrame, max_epochs: int) -> float:
    """Words per unit of weight once capped sources have been clamped.

    Each round is one small aggregate: the level only rises, so a source that is
    clamped stays clamped, and the loop ends when a round clamps no more.
    """
    cap = F.col("source_size") * max_epochs
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return 0.0
    level, clamped = total / weight, -1
    while True:
        full = cap <= F.lit(level) * F.col("weight")
        n, used, free = sources.agg(
            F.count(F.when(full, 1)),
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)),
        ).first()
        if n == clamped or not free:
            return level
        level, clamped = (total - used) / free, n


def plan_mix(sizes: DataFrame, max_epochs: int = 3) -> DataFrame:
    """Per source: source_size, target, whole repetitions, and the hash below which a document is taken once more.

    ``sizes`` has source, size and the hash ``h``. The cut is found in two steps:
    sums of 4,096 slices of the hash range, then the documents of one slice. One
    more document a source is then put in or left out where that comes nearer.
    """
    sources = ordered_sources(sizes)
    level = water_level(sources, max_epochs)
    size = F.col("source_size")
    target = F.when(size > 0, F.least((size * max_epochs).cast("double"), F.lit(level) * F.col("weight"))).otherwise(0.0)
    planned = (
        sources.withColumn("target", target)
        .withColumn("whole", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long"))
        .withColumn("extra", F.col("target") - F.col("whole") * size)
        .withColumn("key", F.xxhash64(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))))
    )
    slice_of = F.shiftright("h", _BITS - 12)
    keyed = sizes.withColumn("slice", slice_of).withColumnRenamed("source", "s")
    sums = keyed.groupBy("s", "slice").agg(F.sum("size").alias("n"))
    same = F.col("s").eqNullSafe(F.col("source"))
    through = F.sum("n").over(Window.partitionBy("source").orderBy("slice"))
    edge = (
        sums.join(planned, same)
        .select("source", "slice", "extra", (through - F.col("n")).alias("before"), through.alias("through"))
        .where((F.col("before") <= F.col("extra")) & (F.col("extra") < F.col("through")))
    )
    inside = (
        keyed.join(edge.withColumnRenamed("slice", "edge"), same & (F.col("slice") == F.col("edge")))
        .groupBy("source", "slice", "extra", "before", "h")
        .agg(F.sum("size").alias("n"))
    )
    so_far = F.sum("n").over(Window.partitionBy("source").orderBy("h"))
    cut = (
        inside.withColumn("ahead", F.col("before") + so_far - F.col("n"))
        .groupBy("source", "slice")
        .agg(F.max(F.when(F.col("ahead") + F.col("n") / 2 <= F.col("extra"), F.col("h"))).alias("last"))
        .select(
            F.col("source").alias("cs"),
            F.coalesce(F.col("last") + 1, F.shiftleft(F.col("slice"), _BITS - 12)).alias("below"),
        )
    )
    out = planned.join(cut, F.col("source").eqNullSafe(F.col("cs")), "left")
    out = written(
        out.select("source", "source_size", "target", "whole", "extra", F.coalesce("below", F.lit(0)).alias("below")), "mix"
    )
    return written(_with_swap(sizes, out), "mix")


def _with_swap(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with ``swap``: the hash of the one document a source that, put in or left out, brings it nearest to its target."""
    few = plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES  # else the join is dealt by source
    small = F.broadcast(plan) if few else plan
    joined = sizes.where("size > 0").join(small, sizes["source"].eqNullSafe(plan["source"])).drop(sizes["source"])
    had = joined.groupBy("source").agg(F.sum(F.when(F.col("h") < F.col("below"), F.col("size")).otherwise(0)).alias("had"))
    gap = plan.join(had.withColumnRenamed("source", "hs"), F.col("source").eqNullSafe(F.col("hs")), "left").select(
        "source", "source_size", "target", "whole", "below", (F.col("extra") - F.coalesce("had", F.lit(0))).alias("gap")
    )
    each = sizes.where("size > 0").withColumnRenamed("source", "s").join(F.broadcast(gap) if few else gap, F.col("s").eqNullSafe(F.col("source")))
    useful = (F.col("h") >= F.col("below")) == (F.col("gap") > 0)
    off = F.abs(F.abs("gap") - F.col("size"))
    best = (
        each.where(useful & (off < F.abs("gap")))
        .groupBy("s")
        .agg(F.min(F.struct(off.alias("off"), F.col("h").alias("h"))).alias("best"))
    )
    return gap.join(best, F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", "source_size", "target", "whole", "below", F.col("best.h").alias("swap")
    )


def _packed(docs: DataFrame, seed: int) -> DataFrame:
    """The rows of ``docs`` as one struct, so that none of their columns can clash, with size and hash beside it."""
    text_key = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col("source"),
        count_spaced(F.col("text")).alias("_size"),
        seeded_hash(F.col("doc_id"), text_key, seed).alias("_h"),
    )


def mix(docs: DataFrame, max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` as the struct ``row``, with size, source_size, target and copies: how often the mix takes each."""
    packed = _packed(docs, seed)
    sizes = written(packed.select("source", F.col("_size").alias("size"), F.col("_h").alias("h")), "sizes")
    taken = _take(packed, plan_mix(sizes, max_epochs))
    return taken.select(
        F.col("_row").alias("row"), F.col("_size").alias("size"), "source_size", "target", "copies"
    )


def _take(sized: DataFrame, plan: DataFrame) -> DataFrame:
    few = plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    plan = plan.withColumnRenamed("source", "_source")
    joined = sized.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("_source")))
    once_more = (F.col("_h") < F.col("below")) != F.coalesce(F.col("_h") == F.col("swap"), F.lit(False))
    taken = F.col("whole") + once_more.cast("long")
    return joined.withColumn("copies", F.when(F.col("_size") > 0, taken).otherwise(0))


def mix_digest(docs: DataFrame, max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken; texts are read once."""
    text_key = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))
    sizes = written(
        docs.select(
            "doc_id",
            "source",
            count_spaced(F.col("text")).alias("_size"),
            seeded_hash(F.col("doc_id"), text_key, seed).alias("_h"),
        ),
        "sizes",
    )
    plan = plan_mix(sizes.select("source", F.col("_size").alias("size"), F.col("_h").alias("h")), max_epochs)
    return _take(sizes, plan).select(
        "doc_id",
        F.col("_size").alias("size"),
        "source_size",
        "target",
        (F.col("_size") * F.col("copies")).alias("taken"),
    )


def mix_rows(docs: DataFrame, max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, each document as often as the mix takes it."""
    taken = mix(docs, max_epochs, seed).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(concat_ws('|', '17', coalesce(doc_id::VARCHAR, '-'), coalesce(md5(text), ''))), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight::DOUBLE, source NULLS LAST) AS k,
         sum(source_size) OVER () AS total,
         sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight::DOUBLE, source NULLS LAST ROWS UNBOUNDED PRECEDING) - 3 * source_size AS capped,
         sum(weight) OVER (ORDER BY 3 * source_size / weight::DOUBLE DESC, source DESC NULLS FIRST ROWS UNBOUNDED PRECEDING) AS free
  FROM s),
l AS (
  SELECT min_by((total - capped)::DOUBLE / free::DOUBLE, k) AS level FROM r
  WHERE (total - capped)::DOUBLE / free::DOUBLE * weight < 3 * source_size),
t AS (
  SELECT source, source_size,
         CASE WHEN source_size > 0 THEN least(3 * source_size::DOUBLE, level * weight) ELSE 0.0 END AS target
  FROM s, l),
w AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
c AS (
  SELECT d.doc_id, d.source, d.h, d.size, w.source_size, w.target, w.whole, w.target - w.whole * w.source_size AS extra,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE UNBOUNDED PRECEDING)
           - sum(d.size) OVER (PARTITION BY d.source, d.h) AS ahead,
         sum(d.size) OVER (PARTITION BY d.source, d.h) AS n
  FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source),
f AS (SELECT *, ahead + n / 2.0 <= extra AS inn FROM c),
g AS (SELECT *, extra - sum(CASE WHEN inn THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM f),
x AS (
  SELECT source AS xs, arg_min(h, (abs(abs(gap) - size), h)) AS swap FROM g
  WHERE size > 0 AND (NOT inn) = (gap > 0) AND abs(abs(gap) - size) < abs(gap) GROUP BY source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (size * (whole + CASE WHEN inn <> coalesce(h = swap, false) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM f LEFT JOIN x ON f.source IS NOT DISTINCT FROM x.xs
"""
