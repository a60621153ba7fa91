"""Lines that many documents hold are dropped, by bitmaps that say which lines of each document stay.

A line's key is the line without white space at its ends and with A-Z in lower
case. Keys are hashed to 128 bits, and the hashes are range-partitioned together
with the document, so that a line which every other document holds is spread over
as many tasks as its share of all lines asks for. Within a range the rows are
sorted by hash, document and position: the first row of a document is where the
key first occurs in it, and the number of these first rows is the number of
documents. Only the first and the last hash of a range can go on in another one;
their counts are added up in a table of two rows a range, which is broadcast.

The result has no text: a row a document with the number of its lines and a
bitmap of those that stay, as the lengths of alternating runs of kept and dropped
lines, each in groups of 7 bits, the highest first, with the top bit of all bytes
but the last set. The last run is left out if it is kept, so a document that loses
nothing has an empty bitmap.

Edge cases: null and empty texts have one empty line; lines without a key are
never dropped; a document is a row, and rows with one id and one text count as
several documents but share one row of the bitmaps, as all of them keep the same;
null ids are ids like others (they sort first); an empty table gives none.
Documents are told apart by id and a 64-bit hash of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinloom.llm.common import SPACE_CHARS, ascii_lower
from twinloom.storage import written

#: Keys in this many documents or more lose their lines.
MIN_DOCS = 10
_HASH, _DOC = ["h1", "h2"], ["doc", "mark"]


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hashes(docs: DataFrame) -> DataFrame:
    """doc, mark (the text's hash), pos and the key's two hashes (null without a key), a row a line."""
    # the hash of the text has a projection of its own below the lines, so that it is made once a document
    rows = docs.select(F.col("doc_id").alias("doc"), F.xxhash64(_text()).alias("mark"), _lines_of(_text()).alias("lines"))
    lines = rows.select(*_DOC, F.posexplode("lines").alias("pos", "line"))
    keys = lines.select(*_DOC, "pos", ascii_lower(F.btrim("line", F.lit(SPACE_CHARS))).alias("key"))
    known = F.col("key") != ""
    return keys.select(*_DOC, "pos", F.when(known, F.xxhash64("key")).alias("h1"), F.when(known, F.xxhash64(F.lit("2"), "key")).alias("h2"))


def _frequent(lines: DataFrame, min_docs: int, keep_first: bool) -> DataFrame:
    """doc, mark and pos of the lines that go."""
    in_doc = Window.partitionBy(*_HASH, *_DOC).orderBy("pos")  # the ranges below are clustered by these: no further shuffle
    dealt = lines.where(F.col("h1").isNotNull()).repartitionByRange(*_HASH, *_DOC)
    # rows with one id and one text share their positions: each of them has its own first
    firsts = dealt.withColumn("first", (F.rank().over(in_doc) == 1).cast("long"))
    ranged = written(firsts.withColumn("_pid", F.spark_partition_id()), "line-ranges")
    h = F.struct(*_HASH)
    ends = ranged.groupBy("_pid").agg(F.array(F.min(h), F.max(h)).alias("ends")).select("_pid", F.inline("ends")).distinct()
    over = F.broadcast(ends.select(*_HASH).distinct())  # two rows a range at most
    totals = ranged.join(over, _HASH).groupBy(*_HASH).agg(F.sum("first").alias("total"), F.min("_pid").alias("first_pid"))
    own = Window.partitionBy("_pid", *_HASH)
    counted = ranged.withColumn("n", F.sum("first").over(own))
    if keep_first:
        counted = counted.withColumn("place", F.row_number().over(own.orderBy(*_DOC, "pos")))
    counted = counted.join(F.broadcast(totals), _HASH, "left")
    go = F.coalesce("total", "n") >= min_docs
    if keep_first:
        go = go & ~((F.col("place") == 1) & (F.col("_pid") == F.coalesce("first_pid", "_pid")))
    return counted.where(go).select(*_DOC, "pos")


def _varint(x: Column) -> Column:
    """Hex of a number below 2**35: groups of 7 bits, the highest first."""
    x = x.cast("long")

    def groups(n: int) -> Column:
        out = x.bitwiseAND(127)
        for i in range(1, n):
            out = out + F.shiftleft(F.shiftright(x, 7 * i).bitwiseAND(127) + 128, 8 * i)
        return F.lpad(F.hex(out), 2 * n, "0")

    out = F.when(x < 1 << 7, groups(1))
    for n in (2, 3, 4):
        out = out.when(x < 1 << 7 * n, groups(n))
    return out.otherwise(groups(5))


def _encoded(dropped: Column) -> Column:
    """The bitmap of sorted positions of dropped lines."""
    pairs = F.zip_with(dropped, F.concat(F.array(F.lit(-2)), dropped), lambda p, q: F.struct(p.alias("at"), q.alias("before")))
    begins = F.filter(pairs, lambda z: z["at"] - z["before"] > 1)
    # a run of dropped lines ends at the last one before the next begin
    end = F.struct(F.lit(None).cast("int").alias("at"), F.try_element_at(dropped, F.lit(-1)).alias("before"))
    ends = F.slice(F.concat(begins, F.array(end)), F.lit(2), F.size(begins))
    runs = F.zip_with(begins, ends, lambda b, e: F.concat(_varint(b["at"] - F.greatest(b["before"], F.lit(-1)) - 1), _varint(e["before"] - b["at"] + 1)))
    return F.unhex(F.array_join(runs, ""))


def runs(keep: Column) -> Column:
    """Lengths of the alternating runs that a bitmap holds, kept lines first."""
    numbers = F.regexp_extract_all(F.hex(keep), F.lit("(?:[89A-F][0-9A-F])*[0-7][0-9A-F]"), 0)

    def value(h: Column) -> Column:
        v = F.conv(h, 16, 10).cast("long")
        out = v.bitwiseAND(127)
        for i in range(1, 5):
            out = out + F.shiftleft(F.shiftright(v, 8 * i).bitwiseAND(127), 7 * i)
        return out.cast("int")

    return F.transform(numbers, value)


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = False) -> DataFrame:
    """doc, mark, n_lines, n_dropped and keep (the bitmap) of each document.

    All lines of a key that ``min_docs`` documents hold go; with ``keep_first`` the
    first of them, by doc_id and position, stays.
    """
    lines = written(line_hashes(docs), "line-hashes")
    gone = _frequent(lines, min_docs, keep_first).withColumn("n_lines", F.lit(None).cast("int"))
    sizes = lines.groupBy(*_DOC).agg((F.max("pos") + 1).alias("n_lines")).select(*_DOC, F.lit(None).cast("int").alias("pos"), "n_lines")
    each = gone.unionByName(sizes).groupBy(*_DOC).agg(F.max("n_lines").cast("long").alias("n_lines"), F.array_sort(F.collect_set("pos")).alias("dropped"))
    return each.select(*_DOC, "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.when(F.size("dropped") > 0, _encoded(F.col("dropped"))).otherwise(F.lit(b"")).alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with the kept lines as ``text`` (null texts stay null unless lines are dropped), and ``_n_lines`` and ``_n_dropped``."""
    b = bitmaps.select(F.col("doc").alias("_doc"), F.col("mark").alias("_mark"), F.col("n_lines").alias("_n_lines"), F.col("n_dropped").alias("_n_dropped"), F.col("keep").alias("_keep"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64(_text()) == F.col("_mark"))
    found = docs.join(b.hint("shuffle_hash"), same)
    flags = F.flatten(F.transform(runs(F.col("_keep")), lambda r, i: F.array_repeat(i % 2 == 0, r)))
    marked = F.zip_with(_lines_of(_text()), flags, lambda line, stays: F.struct(line.alias("line"), F.coalesce(stays, F.lit(True)).alias("stays")))
    kept = F.array_join(F.transform(F.filter(marked, lambda z: z["stays"]), lambda z: z["line"]), "\n")
    return found.withColumn("text", F.when(F.col("_n_dropped") == 0, F.col("text")).otherwise(kept)).drop("_doc", "_mark", "_keep")


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = False) -> DataFrame:
    """``docs`` without the lines that many documents hold."""
    return apply_bitmaps(docs, keep_bitmaps(docs, min_docs, keep_first)).select(*docs.columns)


LINE_DEDUP_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, r, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key AS gone FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= {MIN_DOCS})
SELECT doc_id, count(*) AS n_lines, count(gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE gone IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON key = gone GROUP BY r, doc_id
"""
