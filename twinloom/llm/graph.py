"""Connected components of an edge table, and rows of a group met in one task by blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinloom.storage import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, comp) for every node of the edges (a, b): the smallest id of its component.

    In a round every node goes to the first of its neighbours and itself, and on to where that one goes; edges are then
    those between the places reached, each once, so that a star is gone after one round. The first round's order is that of
    the ids, later ones have random orders, in which a fixed share of the nodes goes away whatever the graph looks like.
    Every round is written to the shared folder; the driver learns only whether edges are left.
    """
    one = written(edges.where("a <> b").select("a", "b"), "links")  # read twice
    left = written(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels, k = None, 0
    while True:
        order = lambda c: F.struct((F.xxhash64(c, F.lit(k)) if k else F.col(c)).alias("at"), F.col(c).alias("node"))  # noqa: B023, E731
        first = left.withColumn("place", order("b")).groupBy("a").agg(F.min("place").alias("near"))
        first = first.select(F.col("a").alias("id"), F.least("near", order("a"))["node"].alias("via"))
        onward = first.select(F.col("id").alias("via"), F.col("via").alias("root"))
        step = written(first.join(onward, "via").select("id", "root"), "step")
        if labels is None:
            labels = step.withColumnRenamed("root", "comp")
        else:
            moved = step.withColumnRenamed("id", "comp")
            labels = written(labels.join(moved, "comp", "left").select("id", F.coalesce("root", "comp").alias("comp")), "labels")
        ends = left.join(step.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a").join(step.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b")
        left = written(ends.where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
        if left.isEmpty():
            break
        k += 1
    least = labels.groupBy("comp").agg(F.min("id").alias("least"))
    return written(labels.join(least, "comp").select("id", F.col("least").alias("comp")), "labels")


def in_blocks(rows: DataFrame, group: str, member: str, count: str, block: int) -> DataFrame:
    """``rows`` with bi, bj and side: each group of ``count`` rows is cut into blocks that meet in pairs.

    A group of up to ``block`` rows is one block that meets itself. Larger ones
    are cut by a hash of the member, and each row goes to every pair of its block.
    """
    cut = F.ceil(F.col(count) / block).cast("int")
    own = F.pmod(F.xxhash64(member, group), cut).cast("int")
    others = F.when(cut == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), cut - 1))
    return (
        rows.withColumn("own", own)
        .withColumn("other", F.explode(others))
        .withColumn("bi", F.least("own", "other"))
        .withColumn("bj", F.greatest("own", "other"))
        .drop("other")
    )


def met(rows: DataFrame, group: str) -> DataFrame:
    """Rows dealt so that each pair of blocks of a group is consecutive in one task.

    The pairs of a group go to one task after the other from the group's own on, so that a large group is spread evenly.
    """
    keys = [group, "bi", "bj"]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.col("bj").cast("long") * (F.col("bj") + 1) / 2 + F.col("bi")
    task = F.pmod(F.pmod(F.xxhash64(group), F.lit(tasks)) + at.cast("long"), F.lit(tasks))
    return rows.repartitionById(tasks, task.cast("int")).sortWithinPartitions(*keys)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal (integer) keys, across batches."""
    pending: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([np.asarray(batch.column(c)) for c in keys], axis=1)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            key = tuple(k[lo].tolist())
            if pending and key != last:
                yield pa.Table.from_batches(pending)
                pending = []
            pending.append(batch.slice(lo, hi - lo))
            last = key
    if pending:
        yield pa.Table.from_batches(pending)


def local_labels(linked: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component in a symmetric matrix with a true diagonal."""
    n = len(linked)
    labels = np.arange(n)
    while True:
        new = np.where(linked, labels[None, :], n).min(axis=1)
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new
