"""Language-model scores from a hierarchical Pitman-Yor model of word pairs.

Every token that is followed by another is a context with a restaurant of its
own; its customers are the tokens that follow it in training texts, and its
tables send customers to the parent restaurant that all contexts share, whose
parent is uniform over the vocabulary and one unknown word. No word is left out
or merged with others. Seatings are sampled by Gibbs: in a sweep all customers of
a pair are seated anew given the tables of all others as the sweep before left
them (a pair that occurs once has one table, whatever the others do), and the
next round goes on from there. The predictive probability of a word is averaged
over the samples; it is linear in the numbers of tables, so those are averaged.

The work is dealt by hashes. Texts become blocks of about BLOCK_TOKENS tokens;
a block sends each of its distinct pairs with its count to the pair's bucket,
and its distinct words to the word's bucket. Pairs of one context share a
bucket, but those of a very frequent context are spread over all. In a round
every pair bucket samples its restaurants given the parent's probabilities, and
sends tables by word to the word buckets, which sample the parent's seating and
answer; between rounds all is written to the shared folder. A bucket sees what
other buckets hold of the parent (and of a spread context) as it was after the
last round. Messages are arrays, and an answer is in the order of its question.
The driver sees totals, and the words that are more than a bucket's worth of
tokens (fewer of them than buckets).

Tokens are runs of characters other than ASCII white space, with A-Z in lower
case, and one end a text. Edge cases: a null or empty text is its end alone; a
null id is not held out; rows that repeat count and are scored each; without
training texts N and V are 0 and unknown words have the uniform probability;
an empty table gives an empty result; other columns are not looked at. Words are
counted under 64-bit hashes.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinloom.llm.common import id_remainder
from twinloom.llm.seating import Seating, discount_of
from twinloom.storage import release, written

#: Tokens a block of texts, pairs (each block's counted) a pair bucket, and words (likewise) a word bucket hold, about.
BLOCK_TOKENS = 1_000_000
#: Bytes a token takes with its space, about.
TOKEN_BYTES = 6
PAIR_BUCKET = 1_000_000
WORD_BUCKET = 1_000_000
#: Exchanges of table counts with the parent, sweeps before samples are taken in each, and samples.
ROUNDS, BURN_IN, SAMPLES = 2, 3, 6
STRENGTH = 1.0
#: Local ids of the start and the end of a text, which head each block's words.
START, END = 0, 1
_MARKS = [b"\x00start", b"\x00end"]  # no token holds these: they are told apart by their ids and hashed under other names
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _encoded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The tokens of all texts as numbers of their distinct words, how many each text has, and those words."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    lengths, flat = np.asarray(parts.value_lengths()), parts.flatten().dictionary_encode()
    words, codes = flat.dictionary.cast(pa.binary()).to_pylist(), np.asarray(flat.indices).astype(np.int64)
    if b"" in words:  # before and after white space at the ends
        none = words.index(b"")
        kept = codes != none
        lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[kept], minlength=len(lengths))
        codes = codes[kept] - (codes[kept] > none)
        words.pop(none)
    return codes, lengths.astype(np.int64), words


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Runs of rows whose texts, of which the last one may be long, have about ``most`` bytes together."""
    held, room = [], most
    for batch in batches:
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(2)), 0), dtype=np.int64) + TOKEN_BYTES)
        lo = done = 0
        while lo < len(size):
            hi = min(len(size), 1 + int(np.searchsorted(size, done + room)))
            held.append(batch.slice(lo, hi - lo))
            room -= int(size[hi - 1]) - done
            lo, done = hi, int(size[hi - 1])
            if room <= 0:
                yield pa.Table.from_batches(held)
                held, room = [], most
    if held:
        yield pa.Table.from_batches(held)


def _hash(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


_START_HASH, _END_HASH = (np.uint64(xxhash.xxh64_intdigest(m, seed=1)) for m in _MARKS)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _GOLDEN
    return x ^ (x >> np.uint64(29))


def pack(*arrays) -> bytes:
    return pickle.dumps(arrays, protocol=5)


def unpack(data: bytes) -> tuple:
    return pickle.loads(data)


def _planes(ids: np.ndarray) -> bytes:
    """Ids byte by byte, lowest bytes first: most high bytes are zero and take no space when compressed."""
    return ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _ids(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


BLOCKS = "block long, n_docs long, n_train long, n_tokens long, n_words long, n_pairs long, docs binary, words binary, tokens binary"


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to blocks: documents (id, held out, length), words (hash, count in training texts) by frequency, token numbers."""
    number = TaskContext.get().partitionId() << 32
    for texts in _runs(batches, TOKEN_BYTES * BLOCK_TOKENS):
        made, lengths, words = _encoded(texts.column(2).combine_chunks())
        held, n = np.asarray(texts.column(1).to_pylist(), bool), len(words) + 2
        seen = np.bincount(made, minlength=n - 2)
        order = np.concatenate([[START, END], 2 + np.argsort(-seen, kind="stable")])
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        made = rank[made + 2]
        train = np.bincount(made[np.repeat(~held, lengths)], minlength=n)
        train[[START, END]] = (~held).sum()
        hashes = np.concatenate([np.array([_START_HASH, _END_HASH], np.uint64), _hash(words)])[order]
        pairs = np.sort(_following(made, lengths, n))
        yield pa.RecordBatch.from_pydict({
            "block": [number], "n_docs": [len(held)], "n_train": [int((~held).sum())], "n_tokens": [int(lengths[~held].sum() + (~held).sum())], "n_words": [n],
            "n_pairs": [1 + int((pairs[1:] != pairs[:-1]).sum())], "docs": [pack(texts.column(0).to_pylist(), held, lengths)], "words": [pack(hashes, train)], "tokens": [_planes(made)],
        })
        number += 1


def _following(flat: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Each token's pair (previous * n + next), tokens and ends in order."""
    ends = np.cumsum(lengths + 1)
    total = int(ends[-1]) if len(ends) else 0
    following = np.full(total, END, np.int64)
    inside = np.ones(total, bool)
    inside[ends - 1] = False
    following[inside] = flat
    previous = np.full(total, START, np.int64)
    previous[1:] = following[:-1]
    previous[ends[:-1]] = START
    return previous * n + following


def _pairs(flat: np.ndarray, lengths: np.ndarray, held: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (previous * n + next), each token's pair, each pair's count in training texts; tokens and ends in order."""
    keys, which = np.unique(_following(flat, lengths, n), return_inverse=True)
    count = np.bincount(which, weights=np.repeat(~held, lengths + 1), minlength=len(keys)).astype(np.int64)
    return keys, which, count


def _dealt(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that gathers rows by bucket, and where each bucket begins and ends in it."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _pair_buckets(u: np.ndarray, w: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    key = _mix(u)
    if len(hot):
        key = np.where(np.isin(u, hot), _mix(key + w), key)
    return (_mix(key) % np.uint64(buckets)).astype(np.int64)


def _word_buckets(w: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(w ^ _GOLDEN) % np.uint64(buckets)).astype(np.int64)


MESSAGE = "to long, kind long, sender long, data binary"
#: Kinds of messages to word buckets: a block's words, a pair bucket's tables by word and by context.
WORDS, TABLES, CONTEXTS = 0, 1, 2


def _message(to: int, kind: int, sender: int, *arrays) -> dict:
    return {"to": to, "kind": kind, "sender": sender, "data": pack(*arrays)}


def _batched(rows: Iterator[dict], like: list[str], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r["data"])
        if size > most or len(held) >= 5000:
            yield pa.RecordBatch.from_pydict({k: [x[k] for x in held] for k in like})
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pydict({k: [x[k] for x in held] for k in like})


_LIKE = ["to", "kind", "sender", "data"]


def _send_words(buckets: int):
    """(word bucket, block): the block's words, with their training counts."""

    def rows(batches):
        for batch in batches:
            for block, words in zip(batch.column("block").to_pylist(), batch.column("words").to_pylist()):
                h, n = unpack(words)
                order, cut = _dealt(_word_buckets(h, buckets), buckets)
                for b in range(buckets):
                    if cut[b] < cut[b + 1]:
                        at = order[cut[b] : cut[b + 1]]
                        yield _message(b, WORDS, block, h[at], n[at])

    return lambda batches: _batched(rows(batches), _LIKE)


def _send_pairs(buckets: int, hot: np.ndarray):
    """(pair bucket, block): the block's pairs as contexts, how many pairs each has, followers, training counts."""

    def rows(batches):
        for batch in batches:
            for r in batch.to_pylist():
                h, _ = unpack(r["words"])
                _, held, lengths = unpack(r["docs"])
                keys, _, count = _pairs(_ids(r["tokens"]), lengths, held, len(h))
                u, w = h[keys // len(h)], h[keys % len(h)]
                order, cut = _dealt(_pair_buckets(u, w, hot, buckets), buckets)
                for b in range(buckets):
                    if cut[b] < cut[b + 1]:
                        at = order[cut[b] : cut[b + 1]]
                        starts = np.flatnonzero(np.concatenate([[True], u[at][1:] != u[at][:-1]]))
                        yield _message(b, 0, r["block"], u[at][starts], np.diff(np.append(starts, len(at))).astype(np.uint32), w[at], count[at].astype(np.uint32))

    return lambda batches: _batched(rows(batches), _LIKE)


def _words_of(t: pa.Table) -> pa.Table:
    """A word bucket's words with their training counts; the hot ones are named."""
    h, n = (np.concatenate(x) for x in zip(*(unpack(d) for d in t.column("data").to_pylist())))
    words, which = np.unique(h, return_inverse=True)
    c = np.bincount(which, weights=n, minlength=len(words)).astype(np.int64)
    token = words != _START_HASH
    return pa.table({"to": t.column("to")[:1], "v": [int((c[token] > 0).sum())], "n": [int(c[token].sum())], "hot": pa.array([words[c > PAIR_BUCKET].view(np.int64).tolist()], pa.list_(pa.int64())), "data": [pack(words, c)]})


STATE = "to long, kind long, sender long, ones long, twos long, data binary"
#: Kinds of rows of a pair bucket: its restaurants, and where a block's pairs are among them.
RESTAURANTS, PLACES = 0, 1


def _open(t: pa.Table) -> pa.Table:
    """A pair bucket's restaurants from what all blocks sent: pairs that occur twice or more, and counts of those that occur once."""
    senders = t.column("sender").to_pylist()
    parts = [unpack(d) for d in t.column("data").to_pylist()]
    u = np.concatenate([np.repeat(a, k) for a, k, _, _ in parts])
    w = np.concatenate([x[2] for x in parts])
    _, first, which = np.unique(_mix(_mix(u) + w), return_index=True, return_inverse=True)
    c = np.bincount(which, weights=np.concatenate([x[3] for x in parts]), minlength=len(first)).astype(np.int64)
    u, w = u[first], w[first]
    many = np.flatnonzero(c > 1)
    contexts, ctx = np.unique(u[c > 0], return_inverse=True)
    total = np.bincount(ctx, weights=c[c > 0], minlength=len(contexts)).astype(np.int64)
    lone = np.bincount(ctx[c[c > 0] == 1], minlength=len(contexts))
    lone_w, lone_n = np.unique(w[c == 1], return_counts=True)
    to = t.column("to")[0].as_py()
    rows = [{"kind": RESTAURANTS, "sender": -1, "ones": int((c == 1).sum()), "twos": int((c == 2).sum()), "data": pack(contexts, total, lone, np.searchsorted(contexts, u[many]), w[many], c[many], None, lone_w, lone_n)}]
    place = np.zeros(len(c), np.int64)
    place[many] = np.arange(len(many))
    at = 0
    for sender, x in zip(senders, parts):
        mine = which[at : at + len(x[2])]
        at += len(x[2])
        code = np.minimum(c[mine], 2).astype(np.uint8)
        rows.append({"kind": PLACES, "sender": sender, "ones": 0, "twos": 0, "data": pack(code, place[mine[code == 2]].astype(np.uint32))})
    return pa.table({"to": [to] * len(rows), **{k: [r[k] for r in rows] for k in ("kind", "sender", "ones", "twos", "data")}})


def _ask(words: np.ndarray, tables: np.ndarray, buckets: int, sender: int, kind: int) -> Iterator[dict]:
    order, cut = _dealt(_word_buckets(words, buckets), buckets)
    for b in range(buckets):
        if cut[b] < cut[b + 1]:
            at = order[cut[b] : cut[b + 1]]
            yield _message(b, kind, sender, words[at], tables[at])


def _dishes(state: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of a pair bucket, tables of each, and each pair's word."""
    _, _, _, _, w, c, tables, lone_w, lone_n = state
    words, which = np.unique(np.concatenate([w, lone_w]), return_inverse=True)
    own = np.ones(len(w)) if tables is None else tables
    return words, np.bincount(which, weights=np.concatenate([own, lone_n]), minlength=len(words)).astype(np.int64), which[: len(w)]


def _send_tables(buckets: int):
    def rows(batches):
        for batch in batches:
            for to, data in zip(batch.column("to").to_pylist(), batch.column("data").to_pylist()):
                words, tables, _ = _dishes(unpack(data)[:9])
                yield from _ask(words, tables, buckets, to, TABLES)

    return lambda batches: _batched(rows(batches), _LIKE)


def _send_contexts(buckets: int):
    """(word bucket, pair bucket): mean tables of each context."""

    def rows(batches):
        for batch in batches:
            for to, data in zip(batch.column("to").to_pylist(), batch.column("data").to_pylist()):
                state = unpack(data)
                yield from _ask(state[0], state[9], buckets, to, CONTEXTS)

    return lambda batches: _batched(rows(batches), _LIKE)


REPLY = "to long, kind long, sender long, customers long, tables double, ones long, twos long, data binary"


def _parent(vocabulary: int, before: float, discount: float, seed: int, final: bool):
    """A word bucket's part of the parent restaurant: its seating given the tables of all contexts, and answers."""

    def run(t: pa.Table) -> pa.Table:
        to = t.column("to")[0].as_py()
        kinds, senders, parts = t.column("kind").to_pylist(), t.column("sender").to_pylist(), [unpack(d) for d in t.column("data").to_pylist()]
        words = np.unique(np.concatenate([p[0] for p in parts]))
        places = [np.searchsorted(words, p[0]) for p in parts]

        def total(kind: int) -> np.ndarray:
            out = np.zeros(len(words))
            for k, p, at in zip(kinds, parts, places):
                if k == kind:
                    np.add.at(out, at, p[1])
            return out

        customers, samples = total(TABLES).astype(np.int64), SAMPLES if final else 1
        served = np.flatnonzero(customers > 0)
        rng = np.random.default_rng([seed, to])
        mean = np.zeros(len(words))
        if before:
            base = np.float64(discount * before + STRENGTH) / (vocabulary + 1)
            seats = Seating(customers[served], discount, rng)
            for sweep in range(BURN_IN + samples):
                seats.sweep(np.full(len(served), base), np.zeros(len(served)))
                if sweep >= BURN_IN:
                    mean[served] += seats.tables / samples
        else:
            mean[served] = 1.0
        rows = [{"to": -1, "kind": TABLES, "sender": to, "customers": int(customers.sum()), "tables": float(mean.sum()), "ones": int((customers == 1).sum()), "twos": int((customers == 2).sum()), "data": b""}]
        none = {"customers": 0, "tables": 0.0, "ones": 0, "twos": 0}
        counts, contexts = (total(WORDS), total(CONTEXTS)) if final else (None, None)
        for k, sender, at in zip(kinds, senders, places):
            if final and k == WORDS:
                rows.append({"to": sender, "kind": WORDS, "sender": to, **none, "data": pack(counts[at].astype(np.int64), contexts[at], customers[at], mean[at])})
            elif not final and k == TABLES:
                rows.append({"to": sender, "kind": TABLES, "sender": to, **none, "data": pack(customers[at], mean[at])})
        return pa.table({k: [r[k] for r in rows] for k in rows[0]})

    return run


class Parent:
    """Probabilities that the parent restaurant gives, from customers and tables by word."""

    def __init__(self, customers: int, tables: float, discount: float, vocabulary: int):
        self.discount, self.total = discount, STRENGTH + customers
        self.back = (STRENGTH + discount * tables) / (vocabulary + 1)

    def __call__(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return (customers - self.discount * tables + self.back) / self.total


def _sample(parent: Parent, discount: float, spread: dict[int, float | None], pair_buckets: int, buckets: int, samples: int, seed: int):
    """A round of a pair bucket: sweeps over its restaurants, given the parent's answers. ``spread``: tables of contexts that all buckets share (None: not yet known)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        to = left.column("to")[0].as_py()
        contexts, total, lone, ctx, w, c, tables, lone_w, lone_n = state = unpack(left.column("data")[0].as_py())[:9]
        words, _, which = _dishes(state)
        p = np.zeros(len(words))
        order, cut = _dealt(_word_buckets(words, buckets), buckets)
        for sender, data in zip(right.column("sender").to_pylist(), right.column("data").to_pylist()):
            p[order[cut[sender] : cut[sender + 1]]] = parent(*unpack(data))
        p = p[which]
        seats = Seating(c, discount, np.random.default_rng([seed, to]), tables)
        elsewhere = np.zeros(len(contexts))
        if spread:
            hashed = contexts.view(np.int64).tolist()
            own = np.bincount(ctx, weights=seats.tables, minlength=len(contexts)) + lone
            elsewhere = np.array([0.0 if x not in spread else y * (pair_buckets - 1) if spread[x] is None else max(0.0, spread[x] - y) for x, y in zip(hashed, own)])
        mean, of_context = np.zeros(len(c)), np.zeros(len(contexts))
        for sweep in range(BURN_IN + samples):
            others = (elsewhere + lone + np.bincount(ctx, weights=seats.tables, minlength=len(contexts)))[ctx] - seats.tables
            seats.sweep((STRENGTH + discount * others) * p, discount * p)
            if sweep >= BURN_IN:
                mean += seats.tables / samples
                of_context += (lone + np.bincount(ctx, weights=seats.tables, minlength=len(contexts))) / samples
        new = pack(contexts, total, lone, ctx, w, c, seats.tables.astype(np.uint32), lone_w, lone_n, of_context)
        hot = [(x, float(y)) for x, y in zip(contexts.view(np.int64).tolist(), of_context) if x in spread] if spread else []
        return pa.table({"to": [to], "hot": pa.array([[{"word": a, "tables": b} for a, b in hot]], SPREAD), "data": [new], "weight": [pack((c - discount * mean).astype(np.float32))]})

    return run


SPREAD = pa.list_(pa.struct([("word", pa.int64()), ("tables", pa.float64())]))


def _answer_pairs(t: pa.Table) -> pa.Table:
    """For each block what its pairs in this bucket weigh: how often each occurs (2: more), and customers less discounts where that is 2."""
    rows = list(zip(*(t.column(k).to_pylist() for k in ("kind", "sender", "data"))))
    weight = next(unpack(d)[0] for k, _, d in rows if k == RESTAURANTS)
    out = []
    for k, sender, data in rows:
        if k == PLACES:
            code, place = unpack(data)
            out.append({"to": sender, "kind": PLACES, "sender": t.column("to")[0].as_py(), "data": pack(code, weight[place])})
    return pa.table({k: pa.array([r[k] for r in out], pa.binary() if k == "data" else pa.int64()) for k in _LIKE})


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(n: int, v: int, parent: Parent, discount: float, pair_buckets: int, word_buckets: int, hot: np.ndarray):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        r = left.to_pylist()[0]
        h, _ = unpack(r["words"])
        ids, held, lengths = unpack(r["docs"])
        keys, which, _ = _pairs(_ids(r["tokens"]), lengths, held, len(h))
        a, b = keys // len(h), keys % len(h)
        c, tables, p = np.zeros(len(h)), np.zeros(len(h)), np.zeros(len(h))
        code, weight = np.zeros(len(keys), np.uint8), np.zeros(len(keys))
        by_word, cut_word = _dealt(_word_buckets(h, word_buckets), word_buckets)
        by_pair, cut_pair = _dealt(_pair_buckets(h[a], h[b], hot, pair_buckets), pair_buckets)
        for kind, sender, data in zip(*(right.column(k).to_pylist() for k in ("kind", "sender", "data"))):
            if kind == WORDS:
                at = by_word[cut_word[sender] : cut_word[sender + 1]]
                c[at], tables[at], x, y = unpack(data)
                p[at] = parent(x, y)
            else:
                at = by_pair[cut_pair[sender] : cut_pair[sender + 1]]
                code[at], many = unpack(data)
                weight[at[code[at] == 2]] = many
        weight[code == 1] = 1 - discount
        value = np.log10((weight + (STRENGTH + discount * tables[a]) * p[b]) / (STRENGTH + c[a]))
        base = np.log10((c[b] + 1) / (n + v + 1))
        ends = np.cumsum(lengths + 1)
        starts = ends - lengths - 1
        add = lambda x: np.add.reduceat(x[which].astype(np.float64), starts) if len(ends) else np.zeros(0)
        return pa.table(
            {"doc_id": pa.array(ids, pa.int64()), "held_out": held, "n_tokens": lengths + 1, "n_known": add(c[b] > 0).astype(np.int64),
             "train_tokens": np.full(len(ids), n, np.int64), "base_score": add(base), "score": add(value)}
        )

    return run


def score(docs: DataFrame, folds: int = 7, held_fold: int = 2, seed: int = 11) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs``."""
    spark = docs.sparkSession
    held = (id_remainder(F.col("doc_id"), folds) == held_fold).alias("held_out")
    blocks = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, "text").mapInArrow(_to_blocks, BLOCKS), "blocks")
    sizes = blocks.agg(*[F.coalesce(F.sum(k), F.lit(0)) for k in ("n_words", "n_pairs")]).first()
    word_buckets, pair_buckets = (max(1, -(-int(x) // y)) for x, y in zip(sizes, (WORD_BUCKET, PAIR_BUCKET)))

    asked = lambda: blocks.select("block", "words").mapInArrow(_send_words(word_buckets), MESSAGE)
    words = written(asked().groupBy("to").applyInArrow(_words_of, "to long, v long, n long, hot array<long>, data binary"), "words")
    v, n = words.agg(F.coalesce(F.sum("v"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    hot = np.array([r.h for r in words.select(F.explode("hot").alias("h")).collect()], np.int64).view(np.uint64)  # fewer than pair buckets
    release(words)

    sent = blocks.select("block", "docs", "words", "tokens").mapInArrow(_send_pairs(pair_buckets, hot), MESSAGE)
    opened = written(sent.groupBy("to").applyInArrow(_open, STATE), "restaurants")
    release()
    ones, twos = opened.agg(F.coalesce(F.sum("ones"), F.lit(0)), F.coalesce(F.sum("twos"), F.lit(0))).first()
    discount, above, tables = discount_of(ones, twos), 0.5, 0.0
    state = opened.where(F.col("kind") == RESTAURANTS).select("to", "data")
    room, spread = None, dict.fromkeys(hot.view(np.int64).tolist())
    for k in range(ROUNDS):
        sent = state.mapInArrow(_send_tables(word_buckets), MESSAGE)
        replies = written(sent.groupBy("to").applyInArrow(_parent(v, tables, above, seed + k, False), REPLY), "replies")
        own = replies.where("`to` = -1").agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in ("customers", "tables", "ones", "twos")]).first()
        if k == 0:
            above = discount_of(own[2], own[3])
        tables = float(own[1])
        parent = Parent(own[0], tables, above, v)
        told = replies.where("`to` >= 0").select("to", "sender", "data")
        sampled = state.groupBy("to").cogroup(told.groupBy("to")).applyInArrow(
            _sample(parent, discount, spread, pair_buckets, word_buckets, SAMPLES if k == ROUNDS - 1 else 1, seed + k), "to long, hot array<struct<word:long,tables:double>>, data binary, weight binary"
        )
        room, last = written(sampled, "restaurants"), room
        if spread:
            own = room.select(F.explode("hot").alias("h")).groupBy("h.word").agg(F.sum("h.tables").alias("t")).collect()  # the hot words
            spread = {r.word: r.t for r in own}
        release(replies, *([last] if last else []))
        state = room.select("to", "data")

    sent = asked().unionByName(state.mapInArrow(_send_tables(word_buckets), MESSAGE)).unionByName(state.mapInArrow(_send_contexts(word_buckets), MESSAGE))
    replies = written(sent.groupBy("to").applyInArrow(_parent(v, tables, above, seed + ROUNDS, True), REPLY), "replies")
    release()
    own = replies.where("`to` = -1").agg(F.coalesce(F.sum("customers"), F.lit(0)), F.coalesce(F.sum("tables"), F.lit(0.0))).first()
    parent = Parent(own[0], float(own[1]), above, v)
    places = opened.where(F.col("kind") == PLACES).select("to", "kind", "sender", "data")
    rooms = room.select("to", F.lit(RESTAURANTS).cast("long").alias("kind"), F.lit(-1).cast("long").alias("sender"), F.col("weight").alias("data"))
    pairs = places.unionByName(rooms).groupBy("to").applyInArrow(_answer_pairs, MESSAGE)
    told = written(replies.where("`to` >= 0").select("to", "kind", "sender", "data").unionByName(pairs), "answers")
    release(opened, room, replies)
    return (
        blocks.select("block", "docs", "words", "tokens")
        .groupBy("block")
        .cogroup(told.groupBy("to"))
        .applyInArrow(_score(n, v, parent, discount, pair_buckets, word_buckets, hot), SCORES)
    )
