"""A fitted twin model: what a table's columns are like, and how a row becomes a twin's row.

Every column is a standard normal score, by its distribution function for numbers and
by a place within the category's share for categories; a column with nulls has a
second score that says whether it is null. The model holds quantile knots, shares of
categories and the Cholesky factor of the scores' correlation, and no row. It is
written as JSON, so that twins are made again without fitting.

Random numbers are words of SHA-256 over seed, block and key: three words a score.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from twinloom.functions.rng import normal_cdf_array, normal_quantile_array
from twinloom.functions.surrogate import surrogates
from twinloom.operators.profile import as_double

#: 32-bit words of a digest, and words that a score uses: a place, and two for its noise.
WORDS, USED = 8, 3
EDGE = 1e-9


def hash_blocks(seed: int, rid: Column, scores: int) -> list[Column]:
    """Digests that hold the random words of so many scores."""
    return [F.unhex(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit("twin"), F.lit(str(b)), rid).cast("binary"), 256)) for b in range(-(-USED * scores // WORDS))]


def word_sql(seed: int, key: str, word: int) -> str:
    """A uniform number in (0, 1) of a row, as SQL."""
    digest = f"sha256(concat_ws('|', '{seed}', 'twin', '{word // WORDS}', ({key})::VARCHAR))"
    return f"((('0x' || substr({digest}, {8 * (word % WORDS) + 1}, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)"


@dataclass
class Fitted:
    """One column. ``nulls`` is the share of nulls; ``values`` are categories as texts, in order, and ``through`` their running shares."""

    name: str
    type: str
    kind: str  # continuous, categorical, copied, surrogate
    nulls: float = 0.0
    knots: list[float] | None = None
    values: list[str] | None = None
    through: list[float] | None = None

    @property
    def scores(self) -> list[str]:
        return [] if self.kind in ("copied", "surrogate") else [self.name, *([self.name + " is null"] if self.nulls else [])]


@dataclass
class Model:
    keys: list[str]
    seed: int
    k: int
    mix_prob: float
    n_rows: int
    columns: list[Fitted]
    lower: list[list[float]] = field(default_factory=list)

    @property
    def retained(self) -> float:
        return retained(self.mix_prob, self.k)

    @property
    def scored(self) -> list[Fitted]:
        return [c for c in self.columns if c.scores]

    @property
    def n_scores(self) -> int:
        return sum(len(c.scores) for c in self.columns)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Model:
        raw = json.loads(text)
        return cls(**{**raw, "columns": [Fitted(**c) for c in raw["columns"]]})


def retained(mix_prob: float, k: int) -> float:
    """What k passes leave of a row's own score: 1 keeps its rank, 0 is a fresh draw."""
    return (1 - mix_prob**2) ** (k / 2)


def row_key(keys: list[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in keys])


def encoded(df: DataFrame, model: Model, digests: bool = True) -> list[Column]:
    """What scoring takes of a table: digests, then the scored columns, numbers as doubles and categories as texts."""
    blocks = [b.alias(f"_h{i}") for i, b in enumerate(hash_blocks(model.seed, row_key(model.keys), model.n_scores))] if digests else []
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return blocks + [(as_double(c.name, kinds[c.name]) if c.kind == "continuous" else F.col(f"`{c.name}`").cast("string")).alias(f"_c{i}") for i, c in enumerate(model.scored)]


def _uniforms(batch: pa.RecordBatch, blocks: int) -> np.ndarray:
    """Rows times words."""
    words = [np.frombuffer(b"".join(batch.column(i).to_pylist()), ">u4").reshape(-1, WORDS) for i in range(blocks)]
    return (np.concatenate(words, axis=1) + 0.5) / 2.0**32 if words else np.zeros((batch.num_rows, 0))


def share_below(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """The place of numbers among the knots, within (0, 1)."""
    n = len(knots) - 1
    i = np.clip(np.searchsorted(knots, x, side="right"), 1, n)
    low, high = knots[i - 1], knots[i]
    with np.errstate(divide="ignore", invalid="ignore"):
        inside = np.where(high > low, (x - low) / (high - low), 0.5)
    return (i - 1 + np.clip(inside, 0.0, 1.0) + 0.5) / (n + 1)


def at_share(u: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """The piecewise linear function through the knots, at u in (0, 1)."""
    p = np.clip(u, 0.0, 1.0) * (len(knots) - 1)
    i = np.minimum(np.floor(p), len(knots) - 2).astype(np.int64)
    return knots[i] + (p - i) * (knots[i + 1] - knots[i])


class Scorer:
    """Scores of the rows of batches that begin with what :func:`encoded` gives."""

    def __init__(self, model: Model):
        self.model, self.blocks = model, -(-USED * model.n_scores // WORDS)

    def __call__(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(normal scores, uniform words), rows times scores and words."""
        words, out = _uniforms(batch, self.blocks), []
        for i, c in enumerate(self.model.scored):
            x, place = batch.column(self.blocks + i), words[:, USED * len(out)]
            if c.kind == "continuous":
                v = np.asarray(x.fill_null(np.nan), dtype=np.float64)
                u = share_below(np.where(np.isnan(v), 0.0, v), np.array(c.knots))
            else:
                at = np.asarray(pc.index_in(x, value_set=pa.array(c.values, pa.string()), skip_nulls=True).fill_null(-1))
                ends = np.array([0.0, *c.through])
                u = np.where(at < 0, 0.5, ends[at] + place * (ends[at + 1] - ends[at]))  # a value that the fit did not see lies in the middle
            missing = np.asarray(pc.is_null(x))
            out.append(np.where(missing, place, u))
            if c.nulls:
                other = words[:, USED * len(out)]
                out.append(np.where(missing, other * c.nulls, c.nulls + other * (1 - c.nulls)))
        u = np.column_stack(out) if out else np.zeros((batch.num_rows, 0))
        return normal_quantile_array(np.clip(u, EDGE, 1 - EDGE)), words


def _decoded(c: Fitted, u: np.ndarray) -> pa.Array:
    if c.kind == "continuous":
        return pa.array(at_share(u, np.array(c.knots)))
    return pa.array(c.values, pa.string()).take(pa.array(np.searchsorted(np.array(c.through[:-1]), u, side="right")))


def _maker(model: Model, schema: pa.Schema, kept: int):
    """Batches of scored columns, then ``kept`` columns that pass, then texts: the twin's values, and surrogates of the texts."""
    texts = [c.name for c in model.columns if c.kind == "surrogate"]

    def made(z: np.ndarray, words: np.ndarray) -> list[pa.Array]:
        rho, lower = model.retained, np.array(model.lower)
        noise = np.sqrt(-2 * np.log(words[:, 1 :: USED][:, : z.shape[1]])) * np.cos(2 * np.pi * words[:, 2 :: USED][:, : z.shape[1]])
        u = normal_cdf_array(rho * z + math.sqrt(1 - rho * rho) * (noise @ lower.T))
        out, at = [], 0
        for c in model.scored:
            value = _decoded(c, u[:, at])
            if c.nulls:
                value = pc.if_else(pa.array(u[:, at + 1] >= c.nulls), value, pa.scalar(None, value.type))
            at += len(c.scores)
            out.append(value)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            out = made(*scorer(batch)) if model.scored else []
            first = batch.num_columns - kept - len(texts)
            out += [batch.column(first + i) for i in range(kept)]
            out += [surrogates(batch.column(first + kept + i), f"{model.seed}|{name}") for i, name in enumerate(texts)]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) if x.type != f.type else x for x, f in zip(out, schema)], schema=schema)

    return run


def _restored(x: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.IntegralType):
        return F.round(x).cast(kind)
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date(F.round(x).cast("int"))
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(F.round(x * 1_000_000).cast("long"))
    if isinstance(kind, T.TimestampNTZType):
        return F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(secs=F.round(x, 6).cast("decimal(18,6)"))
    return x.cast(kind)


def twin_of(df: DataFrame, model: Model, keep_key: bool = True) -> DataFrame:
    """A twin's row for each row of ``df``, which has the model's columns: the table it was fitted to, or new rows of it."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    whole = [*(model.keys if keep_key else []), *[c.name for c in model.columns if c.kind == "copied"]]
    passed = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(whole)]
    others = [c for c in model.columns if c.kind == "surrogate"]
    given = df.select(*encoded(df, model), *passed, *[F.col(f"`{c.name}`").alias(f"_s{i}") for i, c in enumerate(others)])
    fields = [T.StructField(f"_c{i}", T.DoubleType() if c.kind == "continuous" else T.StringType()) for i, c in enumerate(model.scored)]
    fields += [T.StructField(f"_k{i}", kinds[c]) for i, c in enumerate(whole)] + [T.StructField(f"_s{i}", T.StringType()) for i in range(len(others))]
    made = given
    if model.scored or others:
        schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields])
        made = given.mapInArrow(_maker(model, schema, len(passed)), T.StructType(fields))
    at = {c.name: F.col(f"_c{i}") for i, c in enumerate(model.scored)}
    out = [F.col(f"_k{i}").alias(c) for i, c in enumerate(model.keys)] if keep_key else []
    for c in model.columns:
        if c.kind == "copied":
            value = F.col(f"_k{whole.index(c.name, len(model.keys) if keep_key else 0)}")
        elif c.kind == "surrogate":
            value = F.col(f"_s{others.index(c)}")
        else:
            value = _restored(at[c.name], kinds[c.name]) if c.kind == "continuous" else at[c.name].cast(kinds[c.name])
        out.append(value.alias(c.name))
    return made.select(*out)
