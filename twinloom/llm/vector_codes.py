"""Product codes of vectors, learned by weighted Lloyd rounds over distinct parts.

Vectors become integers, floor(scale * x), and are cut into equal parts. Equal
parts of one position are counted once, so a round works on distinct parts and
their weights: each task finds the nearest entries of the codebooks, which are of
fixed size, and returns sums and counts an entry; these are added up by Spark, and
only one sum an entry and component reaches the driver. At the end codes and
errors of the distinct parts are joined back to the vectors. Parts with more than
a thousandth of all vectors, at most a thousand a position, are joined by
broadcast, so that no task gets all rows of a common part; the rest by a shuffle.

Edge cases: vectors that are null or empty, hold a null or a component that is not
finite, take no part, and neither do vectors whose length is no multiple of the
parts, or another than that of the smallest id taking part; null ids sort last
and repeated ids by their components, where the first entries are chosen; with
fewer vectors than entries the codebooks are smaller, and equal first entries leave
the later ones unused; rows that repeat get a code each; components beyond 2**63
either way and errors beyond 2**63 - 1 count as these limits; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinloom.storage import written

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: A key with more than this share of the rows is joined by broadcast; there are at most HOT of them a position.
HOT = 1000
_MOST = 2**63 - 1


@dataclass
class Codes:
    """codes: a row a vector with ``code`` and ``error``; codebooks: [part][entry][component]; codebooks_sha256."""

    codes: DataFrame
    codebooks: list[list[list[int]]]

    @property
    def codebooks_sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.codebooks for entry in part for x in entry).encode()).hexdigest()


def quantised(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """row, vec_id, label and v, the integer vector, of the rows that may take part."""
    sound = (F.size("x") > 0) & (F.size("x") % parts == 0) & ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    ints = rows.where(F.col("x").isNotNull() & sound).select("vec_id", "label", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))
    return written(ints.withColumn("row", F.monotonically_increasing_id()), "vectors")  # row numbers are fixed once written


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(-1, width)


def _most(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def nearest(x: np.ndarray, book: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row (the lower one in ties) and its squared distance, exactly."""
    most = max(_most(x), max(abs(c) for entry in book for c in entry))
    # floats where all sums are exact in them, else integers, and Python's where 64 bits may not do
    kind = np.float64 if 4 * most * most * x.shape[1] < 2**53 else np.int64 if 4 * most * most * x.shape[1] < _MOST else object
    x, book = x.astype(kind), np.array(book, dtype=object).astype(kind)
    if kind is np.float64:
        d = (x * x).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book * book).sum(axis=1)[None, :]
    else:
        d = np.stack([((x - e) ** 2).sum(axis=1) for e in book], axis=1)
    code = d.argmin(axis=1)
    return code, d[np.arange(len(d)), code]


def _by_part(batch: pa.RecordBatch, width: int):
    """(position, row numbers, parts) of a batch with columns p and part."""
    p, x = batch.column("p").to_numpy(), _numbers(batch.column("part"), width)
    for at in np.unique(p):
        rows = np.flatnonzero(p == at)
        yield int(at), rows, x[rows]


def _sums(books: list[list[list[int]]], width: int):
    """Per partition: p, e, d, and the weighted sum of the components d, and the weight, of the parts nearest to entry e."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            weights = batch.column("w").to_numpy()
            for p, rows, x in _by_part(batch, width):
                code, _ = nearest(x, books[p])
                w = weights[rows]
                if _most(x) * int(w.sum()) < 2**62:
                    product = x * w[:, None]
                else:
                    product, w = x.astype(object) * w.astype(object)[:, None], w.astype(object)
                for e in np.unique(code):
                    mine = code == e
                    found = [int(v) for v in product[mine].sum(axis=0)] + [int(w[mine].sum())]
                    known = total.get((p, int(e)))
                    total[p, int(e)] = [a + b for a, b in zip(known, found)] if known else found
        rows_ = [(p, e, d, Decimal(s[d]), s[-1]) for (p, e), s in total.items() for d in range(width)]
        if rows_:
            p, e, d, s, n = zip(*rows_)
            yield pa.record_batch([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(d, pa.int32()), pa.array(s, pa.decimal128(38, 0)), pa.array(n, pa.int64())], ["p", "e", "d", "s", "n"])

    return run


def _assigned(books: list[list[list[int]]], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, object)
            for p, rows, x in _by_part(batch, width):
                codes[rows], found = nearest(x, books[p])
                errors[rows] = [min(int(v), _MOST) for v in found]
            yield pa.record_batch([batch.column("p"), batch.column("part"), batch.column("w"), pa.array(codes), pa.array(errors.tolist(), pa.int64())], ["p", "part", "w", "code", "error"])

    return run


def _first_entries(vectors: DataFrame, entries: int, parts: int) -> list[list[list[int]]]:
    """The codebooks made of the vectors with the smallest ids, all of the length of the first."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").first()
    if first is None:
        return []
    same = vectors.where(F.size("v") == len(first.v)).orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    width = len(first.v) // parts
    return [[list(r.v[p * width : (p + 1) * width]) for r in same] for p in range(parts)]


def lloyd(distinct: DataFrame, books: list[list[list[int]]], rounds: int) -> list[list[list[int]]]:
    """The codebooks after some rounds over (p, part, w): entries move to the floor of their parts' mean, unused ones stay."""
    width = len(books[0][0])
    for _ in range(rounds):
        sums = distinct.mapInArrow(_sums(books, width), "p int, e int, d int, s decimal(38,0), n long").groupBy("p", "e", "d").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        books = [[list(entry) for entry in book] for book in books]
        for r in sums.collect():  # a row a component of the codebooks
            books[r.p][r.e][r.d] = int(r.s) // int(r.n)
    return books


def _joined(left: DataFrame, right: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``left`` with the columns of ``right``, whose keys are unique (nulls match) and which says in ``w`` how many rows of ``left`` have them."""
    named = right.select(*[F.col(k).alias("_" + k) for k in keys], F.lit(True).alias("_hit"), *[c for c in right.columns if c not in (*keys, "w")], F.col("w").alias("_w"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col("_" + k))
    extra = ["_w", *["_" + k for k in keys]]
    hot, cold = named.where(F.col("_w") * HOT > total), named.where(F.col("_w") * HOT <= total)
    tried = left.join(F.broadcast(hot), on, "left")
    there = tried.where("_hit").drop(*extra, "_hit")
    rest = tried.where("_hit IS NULL").select(*left.columns).join(cold, on).drop(*extra, "_hit")
    return there.unionByName(rest)


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codes:
    """vec_id, label, code (two hex digits a part) and error (squared distance) of each vector, and the codebooks. At most 256 entries."""
    if not 1 <= entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    data = quantised(vectors, id_col, vector_col, label_col, scale, parts)
    books = _first_entries(data, entries, parts)
    kind = data.schema["label"].dataType
    if not books:
        empty = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", kind), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
        return Codes(data.sparkSession.createDataFrame([], empty), books)
    width = len(books[0][0])
    data = data.where(F.size("v") == parts * width)
    pieces = data.select("row", "vec_id", "label", F.posexplode(F.array(*[F.slice("v", p * width + 1, width) for p in range(parts)])).alias("p", "part"))
    distinct = written(pieces.groupBy("p", "part").agg(F.count("*").alias("w")), "parts")
    books = lloyd(distinct, books, rounds)
    done = written(distinct.mapInArrow(_assigned(books, width), "p int, part array<long>, w long, code int, error long"), "part-codes")
    each = _joined(pieces, done, ["p", "part"], data.count()).drop("part")
    error = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_MOST).cast("decimal(38,0)")).cast("long")
    codes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "code"))), lambda c: F.lower(F.lpad(F.hex(c["code"].cast("long")), 2, "0"))), "")
    out = each.groupBy("row", "vec_id", "label").agg(codes.alias("code"), error.alias("error"))
    return Codes(written(out.drop("row"), "codes"), books)


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with label_error, the sum of the errors of all vectors with the label; null is a label too."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_MOST).cast("decimal(38,0)")).cast("long")
    sums = codes.groupBy("label").agg(total.alias("label_error"), F.count("*").alias("w"))
    return _joined(codes, sums, ["label"], codes.count())


_SOUND = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_DISTANCE = "list_sum(list_transform(list_zip(part, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"


def _round_sql(k: int) -> str:
    return f"""{_assign_sql(k)},
s{k} AS (SELECT p, e, d, sum(part[d] * w)::BIGINT AS s, sum(w)::BIGINT AS n FROM a{k}, range(1, (SELECT max(len(part)) FROM u) + 1) t(d) GROUP BY p, e, d),
m{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY d) AS m FROM s{k} GROUP BY p, e),
c{k} AS MATERIALIZED (SELECT p, e, coalesce(m, c) AS c FROM c{k - 1} LEFT JOIN m{k} USING (p, e))"""


def _assign_sql(k: int) -> str:
    return f"a{k} AS MATERIALIZED (SELECT p, part, w, min(struct_pack(d := {_DISTANCE}, e := e)).e AS e, min({_DISTANCE}) AS err FROM u JOIN c{k - 1} USING (p) GROUP BY p, part, w)"


VECTOR_CODES_SQL = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {_SOUND}),
x AS (SELECT r, vec_id, label, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS part FROM v, range({PARTS}) t(p)),
u AS MATERIALIZED (SELECT p, part, count(*) AS w FROM x GROUP BY p, part),
c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, part AS c FROM x WHERE r IN (SELECT r FROM v ORDER BY vec_id LIMIT {ENTRIES})),
{', '.join(_round_sql(k) for k in range(1, ROUNDS + 1))},
{_assign_sql(ROUNDS + 1)},
y AS (SELECT r, vec_id, label, string_agg(lpad(lower(hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(err)::BIGINT AS error FROM x JOIN a{ROUNDS + 1} USING (p, part) GROUP BY r, vec_id, label)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM c{ROUNDS}) AS codebooks_sha256 FROM y
"""
