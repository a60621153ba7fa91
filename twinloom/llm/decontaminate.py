"""Benchmark decontamination (DataFrame functions only).

A benchmark item gives windows: every 13 consecutive words, or all its words if
it has fewer. The hashes of the windows' first words form the set that is probed
at every word of every training text: a bit set of bounded size, broadcast with
the tasks, which a row's own words are filtered by before they become rows. Probes
that hit carry their words along and are then verified word by word against the
windows with that hash. A larger benchmark lets more probes through, never fewer.

Edge cases: null and empty texts have no words and are never contaminated; an
empty benchmark leaves every count at 0; null item ids still mark words, but are
not named; repeated items count once an id; rows that repeat are judged each for
itself; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinloom.llm.common import words
from twinloom.storage import written

WINDOW = 13
#: A probe takes so many of a window's first words at most; shorter windows have probes of their own length.
PROBE = 6
#: The bit set has BITS_PER_KEY bits a window or more, but so many bytes at most (multiples of 4096; each holds 7 bits, to be read as ASCII).
BITS_PER_KEY = 28
MIN_BYTES, MAX_BYTES = 2**16, 2**21
#: Windows of so many bytes at most, as measured, are broadcast to the probes that hit; else those are shuffled, with the same result.
BROADCAST_BYTES = 32 * 2**20
#: Spark's bitmaps hold so many bits each.
_BITMAP = 32768
#: A word, in either case, and what separates it from the next.
_PIECE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
_LEADING = r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"


def windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """(win, items): each distinct window as an array of words, with the ids of the items it occurs in."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n, F.lit(0)) + 1)
    each = w.where(F.size("w") > 0).select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, n))).alias("win"))
    return each.groupBy("win").agg(F.collect_set("item").alias("items"))


def bit_set(keys: DataFrame, n_keys: int) -> bytes:
    """The bits of the keys, between MIN_BYTES and MAX_BYTES, put together from Spark's bitmaps of 4 KB each."""
    size = MIN_BYTES
    while size < MAX_BYTES and size * 7 < n_keys * BITS_PER_KEY:
        size *= 2
    bit = F.pmod("key", F.lit(size * 7))
    at = F.floor(bit / 7) * 8 + bit % 7 + 1  # bitmaps count from 1
    maps = keys.groupBy(F.bitmap_bucket_number(at).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    whole = bytearray(size)
    for r in maps.collect():  # MAX_BYTES in all
        whole[(r.n - 1) * _BITMAP // 8 : r.n * _BITMAP // 8] = r.bits
    return bytes(whole)


def in_bit_set(key: Column, bits: bytes) -> Column:
    bit = F.pmod(key, F.lit(len(bits) * 7))
    byte = F.substring(F.lit(bits), F.floor(bit / 7).cast("int") + 1, 1).cast("string")
    return F.getbit(F.ascii(byte), (bit % 7).cast("int")) == 1


def _probe(m: int, n: int, bits: bytes) -> Column:
    """The places in ``w`` whose next m words are in the bit set, with n words each."""
    hit = F.transform(
        F.sequence(F.lit(1), F.size("w") - (m - 1)),
        lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice("w", i, m)).alias("key")),
    )
    hit = F.filter(hit, lambda x: in_bit_set(x["key"], bits))
    return F.transform(
        hit, lambda x: F.struct(F.lit(m).alias("m"), x["at"].alias("at"), x["key"].alias("key"), F.slice("w", x["at"], n).alias("win"))
    )


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """doc_id, text_key, n_words, spans and items for each row of ``docs``.

    ``spans`` are the word ranges (s, e) of verified occurrences, sorted and
    merged; ``items`` are the ids, as sorted strings, of the items that occur.
    """
    wins = written(windows(benchmark, n).withColumn("m", F.least(F.size("win"), F.lit(PROBE))), "windows")
    keyed = wins.withColumn("key", F.expr("xxhash64(slice(win, 1, m))"))
    n_bytes = F.sum(F.aggregate("win", F.lit(64).cast("long"), lambda acc, x: acc + 8 + F.octet_length(x)) + F.aggregate("items", F.lit(0).cast("long"), lambda acc, x: acc + 8 + F.octet_length(x)))
    size = keyed.agg(F.count("*").alias("n"), n_bytes.alias("bytes"), F.collect_set("m").alias("m")).first()
    probes = size.m  # PROBE values at most
    side_hint = F.broadcast if (size.bytes or 0) <= BROADCAST_BYTES else (lambda df: df.hint("merge"))
    bits = bit_set(keyed, size.n)

    none = F.array().cast("array<struct<m:int,at:int,key:bigint,win:array<string>>>")
    found = [none]
    for m in sorted(probes):
        found.append(F.when(F.size("w") >= m, _probe(m, n, bits)).otherwise(none))

    read = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), words(F.col("text")).alias("w"))
    found_in = read.select(
        F.monotonically_increasing_id().alias("uid"),
        "doc_id",
        "text_key",
        F.size("w").cast("long").alias("n_words"),
        F.concat(*found).alias("hits"),
    )
    probed = found_in.select(
        "uid",
        "doc_id",
        "text_key",
        "n_words",
        F.explode_outer("hits").alias("hit"),
    )
    side = keyed.select(F.col("m").alias("wm"), F.col("key").alias("wkey"), F.col("win").alias("wwin"), "items")
    match = (
        (F.col("hit.m") == F.col("wm"))
        & (F.col("hit.key") == F.col("wkey"))
        & (F.slice(F.col("hit.win"), 1, F.size("wwin")) == F.col("wwin"))
    )
    joined = probed.join(side_hint(side), match, "left")
    span = F.struct((F.col("hit.at") - 1).alias("s"), (F.col("hit.at") - 1 + F.size("wwin")).alias("e"))
    return joined.groupBy("uid", "doc_id", "text_key", "n_words").agg(
        merged(F.collect_set(F.when(F.col("wwin").isNotNull(), span))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    ).drop("uid")


def merged(spans: Column) -> Column:
    """Sorted ranges of which none overlap or touch."""

    def add(acc: Column, x: Column) -> Column:
        last = acc["last"]
        joins = last.isNotNull() & (last["e"] >= x["s"])
        longer = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))
        return F.struct(
            F.when(joins | last.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(last))).alias("done"),
            F.when(joins, longer).otherwise(x).alias("last"),
        )

    kind = "struct<s:int,e:int>"
    start = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("last"))
    return F.aggregate(
        F.array_sort(spans),
        start,
        add,
        lambda acc: F.when(acc["last"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["last"]))),
    )


def judged(hits: DataFrame) -> DataFrame:
    """``hits`` with n_hit, n_items, items_sha256 and contaminated (5 % of the words or more)."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["e"] - x["s"])
    return hits.withColumns(
        {
            "n_hit": n_hit,
            "n_items": F.size("items").cast("long"),
            "items_sha256": F.sha2(F.array_join("items", ",").cast("binary"), 256),
        }
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents") -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) with their benchmark passages cut out."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    verdicts = judged(find_hits(docs, benchmark)).where("contaminated")
    keys = verdicts.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("spans").alias("_spans"))
    keys = keys.dropDuplicates(["_id", "_key"])
    same = F.col("_id").eqNullSafe(docs["doc_id"]) & (F.col("_key") == text_key(docs["text"]))
    if remove == "documents":
        return docs.join(keys, same, "left_anti")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    text = F.col("_row.text")
    both = packed.join(keys, F.col("_id").eqNullSafe(F.col("_row.doc_id")) & (F.col("_key") == text_key(text)), "left")
    pieces = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))
    kept = F.filter(pieces, lambda _, i: ~F.exists("_spans", lambda x: (x["s"] <= i) & (i < x["e"])))
    cut = F.concat(F.regexp_extract(text, _LEADING, 0), F.array_join(kept, ""))
    new_text = F.when(F.col("_spans").isNull(), text).otherwise(cut)
    return both.select(F.col("_row").withField("text", new_text).alias("_row")).select("_row.*")


DIGEST = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]

DECONTAMINATE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
i AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS p FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, array_to_string(w[p:p+12], ' ') AS k, least(len(w), 13) AS n FROM i),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
hit AS (
  SELECT DISTINCT pos.doc_id, pos.p, win.n, win.item_id
  FROM pos, lens, win
  WHERE pos.p + lens.n - 1 <= len(pos.w) AND win.n = lens.n AND win.k = array_to_string(pos.w[pos.p:pos.p + lens.n - 1], ' ')),
words AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
