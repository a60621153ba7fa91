"""Texts rearranged so that a model learns to fill in their middle.

The Split pre-tokenizer of the tokenizers library, which is not trained, matches
units from left to right and keeps each match as a piece of its own (isolated); the
pieces' offsets count code points. The number of offsets is the number of units,
and the offsets of two ranks, drawn from a hash of the id, are where prefix, middle
and suffix meet.

A piece costs the library about a microsecond, so that a piece for every code point
of a large corpus is slow. For code points the offsets have two levels: blocks of
64 code points, matched by the same pre-tokenizer, and the code points of the few
blocks in which a rank lies. Other units, given as a pattern, have one level.

Texts that are empty, hold one of the marks, or are drawn to be, stay plain. All
parts can be found again: a mark does not occur in a text that is rearranged, and
no part can form one across its edge.

Edge cases: null counts as empty; a null id is hashed as no digits; rows that
repeat give the same rows; texts are taken in slices, so that a long text needs
memory for its own characters and one slice of pieces; columns other than id and
text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

#: Any code point, line ends too.
CODE_POINT = r"[\s\S]"
BLOCK = 64
#: Code points that are split at once; a multiple of BLOCK.
SLICE = 1 << 16
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: Shares in hundredths: texts that stay plain, and of the others those with the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Rows that are in Python's memory at once, and characters of a batch of results.
ROWS, CHARS = 256, 4_000_000
RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _isolated(pattern: str) -> Split:
    return Split(Regex(pattern), "isolated")


class Units:
    """The offsets of the units of texts."""

    def __init__(self, pattern: str = CODE_POINT):
        self.one = _isolated(pattern)
        self.block = _isolated(f"{CODE_POINT}{{1,{BLOCK}}}") if pattern == CODE_POINT else None

    def _offsets(self, text: str) -> list[int]:
        """Where the pieces of a text end."""
        return [end for _, (_, end) in self.one.pre_tokenize_str(text)]

    def index(self, text: str) -> list[tuple[int, int]]:
        """(begin, end) of the blocks, in code points; without blocks, of the units."""
        if self.block is None:
            return [at for _, at in self.one.pre_tokenize_str(text)]
        out, base = [], 0
        while part := text[base : base + SLICE]:
            out += [(base + a, base + b) for _, (a, b) in self.block.pre_tokenize_str(part)]
            base += SLICE
        return out

    def count(self, text: str, index: list[tuple[int, int]]) -> int:
        """The number of units."""
        if self.block is None or not index:
            return len(index)
        begin, end = index[-1]  # all blocks but the last are full
        return (len(index) - 1) * BLOCK + len(self._offsets(text[begin:end]))

    def offset(self, text: str, index: list[tuple[int, int]], rank: int) -> int:
        """Where the first ``rank`` units end."""
        if not rank:
            return 0
        if self.block is None:
            return index[rank - 1][1]
        begin, end = index[(rank - 1) // BLOCK]
        return begin + self._offsets(text[begin:end])[(rank - 1) % BLOCK]


def draws(doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from the id."""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(h[i : i + 8], 16) for i in (0, 8, 16, 24))


def rearranged(doc_id: int | None, text: str, units: Units, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST):
    """n, form, prefix_chars, middle_chars and output of a text."""
    index = units.index(text)
    n = units.count(text, index)
    h1, h2, h3, h4 = draws(doc_id)
    if not text or any(m in text for m in MARKS) or h3 % 100 >= 100 - plain:
        return n, "plain", None, None, text
    a, b = (units.offset(text, index, r) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
    parts = {PREFIX: text[:a], SUFFIX: text[b:], MIDDLE: text[a:b]}
    form, order = ("spm", (SUFFIX, PREFIX, MIDDLE)) if h4 % 100 < suffix_first else ("psm", (PREFIX, SUFFIX, MIDDLE))
    return n, form, a, b - a, "".join(m + parts[m] for m in order)


def fill_in_middle(docs: DataFrame, unit: str = CODE_POINT, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (code points; null if plain) and output, a row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(unit)
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
        rows, chars = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                    rows.append((doc_id, *rearranged(doc_id, text.as_py() or "", units, plain, suffix_first)))
                    chars += len(rows[-1][-1])
                    if chars >= CHARS:
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, chars = [], 0
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)


def restored(output: Column, form: Column) -> Column:
    """The text, from output and form alone."""
    middle = F.substring_index(output, MIDDLE, -1)
    head = F.substring_index(output, MIDDLE, 1)

    def both(first: str, second: str) -> tuple[Column, Column]:
        return F.replace(F.substring_index(head, second, 1), F.lit(first), F.lit("")), F.substring_index(head, second, -1)

    prefix, suffix = both(PREFIX, SUFFIX)
    suffix2, prefix2 = both(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle, suffix2)).otherwise(output)


_H = "('0x' || substr(h, {}, 8))::BIGINT"
FILL_IN_MIDDLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
r AS (SELECT *, {_H.format(1)} % (n + 1) AS x, {_H.format(9)} % (n + 1) AS y, t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_H.format(17)} % 100 >= {100 - PLAIN} AS plain,
  {_H.format(25)} % 100 < {SUFFIX_FIRST} AS turned FROM d),
p AS (SELECT *, substr(t, 1, least(x, y)) AS a, substr(t, least(x, y) + 1, greatest(x, y) - least(x, y)) AS m, substr(t, greatest(x, y) + 1) AS s FROM r)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN turned THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN least(x, y) END AS prefix_chars, CASE WHEN NOT plain THEN greatest(x, y) - least(x, y) END AS middle_chars,
  sha256(CASE WHEN plain THEN t WHEN turned THEN '<S>' || s || '<P>' || a || '<M>' || m ELSE '<P>' || a || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
