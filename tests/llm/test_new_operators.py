"""Line dedup, vector codes and fill-in-middle: against plain Python, on odd tables and on hot keys."""

import hashlib
import random
from collections import Counter

import pytest
from conftest import SF, duck, rows
from pyspark.sql import functions as F

from twinloom.llm import fill_in_middle, line_dedup, vector_codes

ODD = "doc_id long, text string, lang string, pos int, line string, row string, doc string, mark string, output string, w int"
ODD_ROWS = [
    (None, None, None, 1, "r", "r", "d", "m", "o", 1), (None, "a\nb", "en", 1, "r", "r", "d", "m", "o", 1), (None, "a\nb", "en", 1, "r", "r", "d", "m", "o", 1), (1, "", "en", None, None, None, None, None, None, None),
    (2, "\n\n", "en", 1, "r", "r", "d", "m", "o", 1), (3, " A \t\nb\n<P>", "en", 1, "r", "r", "d", "m", "o", 1), (3, "c", "en", 1, "r", "r", "d", "m", "o", 1), (4, "a\na\nA\nz", "en", 1, "r", "r", "d", "m", "o", 1),
    (5, "\n".join(f"l{i}" if i % 3 else "B" for i in range(30_000)), "en", 1, "r", "r", "d", "m", "o", 1), (6, "w" * 300_000, "en", 1, "r", "r", "d", "m", "o", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD_ROWS, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], ODD)


def _key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def _kept(texts, min_docs, keep_first=False):
    docs = [(t or "").split("\n") for t in texts]
    count = Counter(k for d in docs for k in {_key(x) for x in d} if k)
    seen, out = set(), []
    for d in docs:
        mine = []
        for x in d:
            k = _key(x)
            go = bool(k) and count[k] >= min_docs
            if go and keep_first and k not in seen:
                seen.add(k)
                go = False
            if not go:
                mine.append(x)
        out.append("\n".join(mine))
    return out


@pytest.mark.parametrize("keep_first", [False, True])
def test_lines_as_in_plain_python(spark, keep_first):
    random.seed(5)
    pool = [f"line {i}" for i in range(40)] + ["", " ", " wide ", "ÄB", "äb", "x" * 500]
    texts = ["\n".join(random.choice([str.upper, str.lower, lambda s: f" {s}\t\r"])(x) for x in random.choices(pool, k=random.randint(0, 30))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    for least in (2, 30, 60):
        found = {r.doc_id: r.text for r in line_dedup.line_dedup(df, least, keep_first).collect()}
        assert [found[i] for i in range(120)] == _kept(texts, least, keep_first)


def test_lines_of_odd_tables(spark, odd, empty):
    expected = _kept([r[1] for r in ODD_ROWS], 3)
    found = line_dedup.line_dedup(odd, 3)
    assert found.columns == odd.columns
    texts = [(r[0], r[1] if (r[1] or "") == e else e) for r, e in zip(ODD_ROWS, expected)]
    assert sorted(((r.doc_id, r.text) for r in found.collect()), key=repr) == sorted(texts, key=repr)
    assert line_dedup.line_dedup(empty).count() == 0 and line_dedup.keep_bitmaps(empty).count() == 0


def test_a_line_that_half_of_all_documents_hold_is_split(spark):
    """The hot line lies in several ranges; the counts of the ranges are added up."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("hot\nown "), "id")).otherwise(F.concat(F.lit("own "), F.col("id"))).alias("text"))
        ranged = line_dedup.line_hashes(df).where("h1 is not null").repartitionByRange(8, "h1", "h2", "doc", "mark").withColumn("p", F.spark_partition_id())
        hot = ranged.groupBy("h1").agg(F.countDistinct("p").alias("p"), F.count("*").alias("n")).where("n > 1").collect()
        assert [r.n for r in hot] == [2000] and hot[0].p > 2
        for least, gone in ((2000, 2000), (2001, 0)):
            assert line_dedup.keep_bitmaps(df, least).agg(F.sum("n_dropped")).first()[0] == gone
        assert line_dedup.keep_bitmaps(df, 2000, keep_first=True).agg(F.sum("n_dropped")).first()[0] == 1999
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_bitmaps_are_read_back(spark):
    random.seed(2)
    sets = [sorted(random.sample(range(n), random.randint(1, min(n, 400)))) for n in (1, 2, 5, 100, 1000, 3_000_000) for _ in range(20)]
    df = spark.createDataFrame([(s,) for s in sets], "d array<int>")
    for r in df.select("d", line_dedup._encoded(F.col("d")).alias("k")).withColumn("r", line_dedup.runs(F.col("k"))).collect():
        at, found = 0, []
        for i, n in enumerate(r.r):
            found += range(at, at + n) if i % 2 else []
            at += n
        assert found == r.d and len(r.k) <= 8 * len(r.d)
    numbers = spark.createDataFrame([(x,) for b in range(35) for x in (2**b - 1, 2**b)], "x long")
    for r in numbers.select("x", F.hex(F.unhex(line_dedup._varint(F.col("x")))).alias("h")).collect():
        value = 0
        for b in bytes.fromhex(r.h):
            value = value << 7 | b & 127
        assert value == r.x


def _codes(vectors, parts=8, entries=16, rounds=6):
    width = len(vectors[0]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for v in vectors]
    books = [[cut[i][p] for i in range(min(entries, len(cut)))] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in cut:
                groups.setdefault(near(v[p], books[p])[1], []).append(v[p])
            books[p] = [tuple(sum(c) // len(groups[i]) for c in zip(*groups[i])) if i in groups else e for i, e in enumerate(books[p])]
    found = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
    return ["".join(f"{i:02x}" for _, i in f) for f in found], [sum(d for d, _ in f) for f in found], books


def test_vector_codes_are_those_of_plain_rounds(spark):
    random.seed(4)
    small = [[random.randint(-3, 3) / 4096 for _ in range(16)] for _ in range(300)]  # many equal parts
    small += [small[0]] * 150
    large = [[random.choice([-1, 1]) * random.random() * 2.0**30 for _ in range(8)] for _ in range(60)]
    for data in (small, large):
        df = spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(data)], "vec_id long, embedding array<double>, label int")
        ints = [[int(x * 4096 // 1) for x in v] for v in data]
        code, error, books = _codes(ints)
        got = vector_codes.compress(df)
        assert got.codebooks == [[list(e) for e in b] for b in books]
        assert sorted((r.vec_id, r.code, r.error) for r in got.codes.collect()) == [(i, c, min(e, 2**63 - 1)) for i, (c, e) in enumerate(zip(code, error))]


def test_vector_codes_of_odd_tables(spark):
    kind = "vec_id long, embedding array<float>, label string, row int, code int, part int, w int, p int"
    v = [float(i) for i in range(16)]
    rows_ = [(1, v), (1, v), (None, v[::-1]), (2, None), (3, v[:8] + [None] * 8), (4, [float("nan")] + v[1:]), (5, [float("inf")] + v[1:]), (6, []), (7, v[:8]), (8, v[:15]), (9, [x + 0.3 for x in v])]
    df = spark.createDataFrame([(i, e, None if n % 2 else "l", 1, 1, 1, 1, 1) for n, (i, e) in enumerate(rows_)], kind)
    out = vector_codes.with_label_errors(vector_codes.compress(df).codes).collect()
    assert sorted((r.vec_id for r in out), key=repr) == [1, 1, 9, None]
    total = Counter()
    for r in out:
        total[r.label] += r.error
    assert all(r.label_error == total[r.label] for r in out)
    none = vector_codes.compress(df.where("false"))
    assert vector_codes.with_label_errors(none.codes).count() == 0 and none.codebooks_sha256 == hashlib.sha256(b"").hexdigest()


def test_a_common_vector_is_not_joined_in_one_task(spark):
    """Parts of more than a thousandth of all rows take the broadcast way, in the same result."""
    random.seed(9)
    data = [[0.5] * 8 if i % 2 else [random.random() for _ in range(8)] for i in range(3000)]
    df = spark.createDataFrame([(i, v, None) for i, v in enumerate(data)], "vec_id long, embedding array<double>, label int")
    code, error, _ = _codes([[int(x * 4096 // 1) for x in v] for v in data])
    out = vector_codes.with_label_errors(vector_codes.compress(df).codes)
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in out.collect()) == [(i, c, e, sum(error)) for i, (c, e) in enumerate(zip(code, error))]


TEXTS = ["", "a", "ab\r\nc", "日本語のテキスト " * 40, "é" * 200, "\U0001f469‍\U0001f469 " * 50, "x" * 64, "x" * 65, "y" * 128, "z" * 140_000, "has <M> in it", "<", "<P", "ends <", "\0\n\r " * 30]


def test_units_are_code_points():
    units = fill_in_middle.Units()
    for text in TEXTS:
        index = units.index(text)
        assert units.count(text, index) == len(text)
        for rank in {0, 1, 63, 64, 65, 127, 128, 70_000, len(text) // 2, len(text)}:
            if rank <= len(text):
                assert units.offset(text, index, rank) == rank
    flat = fill_in_middle.Units(fill_in_middle.CODE_POINT + "{1}")
    assert [flat.count(t, flat.index(t)) for t in TEXTS] == [len(t) for t in TEXTS]


def test_middles_of_odd_texts(spark, odd, empty):
    df = spark.createDataFrame([(i, t) for i in range(40) for t in TEXTS[:9] + TEXTS[10:]], "doc_id long, text string")
    for table in (df, odd):
        made = fill_in_middle.fill_in_middle(table)
        back = made.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
        assert sorted(((r.doc_id, r.back) for r in back), key=repr) == sorted(((r.doc_id, r.text or "") for r in table.collect()), key=repr)
        frame = table.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"})
        frame["text"] = frame.text.astype(object).where(frame.text.notna(), None)
        digest = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"))
        assert rows(digest.toPandas()) == rows(duck(fill_in_middle.FILL_IN_MIDDLE_SQL, {"documents": frame}).drop(columns="restored_sha256"))
    forms = Counter(r.form for r in fill_in_middle.fill_in_middle(spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))).collect())
    assert 230 < forms["plain"] < 370 and 440 < forms["spm"] < 640
    assert fill_in_middle.fill_in_middle(empty).count() == 0


def test_units_of_words(spark):
    """Other units than code points: cuts lie between words, and the text is found again."""
    df = spark.createDataFrame([(i, "one two  three\nfour " * (i % 5)) for i in range(60)], "doc_id long, text string")
    made = fill_in_middle.fill_in_middle(df, unit=r"\s*\S+").withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).join(df, "doc_id").collect()
    for r in made:
        assert r.back == r.text
        if r.form != "plain":
            assert r.n == 4 * (r.doc_id % 5) + 1 and (r.prefix_chars == 0 or not r.text[r.prefix_chars - 1].isspace() or r.prefix_chars == len(r.text))


def test_queries_at_the_small_scale(spark):
    from twinloom.llm.queries import QUERIES

    for name in ("op11_line_dedup", "op13_fill_in_middle"):
        assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_personal_data_among_digits_of_other_scripts(spark):
    """Digits that are no ASCII digits, in every place of a number, are no numbers and stop nothing."""
    from twinloom.llm import pii

    model = pii.train(spark.read.parquet(f"{SF}/documents.parquet"))
    texts = [f"see {s} here, mail a@b.c" for d in "²³¹٣१①Ⅳ𝟗" for s in (f"1.2.3.{d}", f"{d}.{d}.{d}.{d}", f"+1 {d}55 123 4567", f"4111 1111 1111 11{d}1", f"({d}12) 555-2485")]
    found = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert len(found) == len(texts) and all(r.n_email == 1 and r.n_ip == 0 for r in found)
