"""Toxicity scores: Levenshtein automata over a lexicon trie, with context windows.

The lexicon is learned from labelled texts: words, and stems with many endings,
that occur in toxic texts far more than in others. A token is run through the
product of the lexicon's trie and a Levenshtein automaton, built state by state
as tokens need it, which finds the least number of edits to any entry in one walk
over the token's letters. Entries of five letters and more tolerate edits; a word
that several clean texts hold is no misspelling. Around each hit a window of
tokens tells quotation (between quotation marks, or after a verb of saying) from
abuse. The hits of a text, by kind, edits and context, are the features of a
logistic model fitted to the labels; it sees the text and nothing else. Labels
seldom show misspelled or quoted abuse: toxic texts are also learned from with
their hits misspelled, and clean ones with a quoted hit put in.

Edge cases: null and empty texts have no hits and get the score of such texts;
rows without a label are not learned from, an id labelled twice is toxic if one
label says so; without any toxic label every text gets a score below 0.3; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinloom.llm.common import id_remainder
from twinloom.llm.ngram_join import _sketch, shingles
from twinloom.storage import written

#: Labelled texts that the classifier is fitted to (about; chosen by a hash of the id).
MAX_TRAIN = 20_000
#: Copies among them are found by sets of minimum hashes of shingles: sets, and hashes in each (4 bytes a hash).
BANDS, BAND = 4, 3
#: How many times likelier (by a cautious estimate) an entry of the lexicon is in toxic texts.
MIN_RATIO = 15
STEM_LENGTHS = range(3, 11)
#: What one and two edits leave of a weight.
EDITED = (0.95, 0.85)
#: Clean texts from which a word is known as no misspelling, and what a made-up example weighs.
KNOWN_TEXTS, MADE_UP = 2, 0.5
WINDOW = 6
THRESHOLD = 0.3
#: Characters that stand for letters in disguised words.
DISGUISES = str.maketrans("0134578@$!", "oieastba" + "si")
#: Verbs of saying, in the languages at hand.
SAYING = frozenset("said says wrote quoted called asked replied dit écrit disait sagte schrieb nannte dijo escribió llamó".split())
OPENING, CLOSING = "\"“«„‘'", "\"”»“’'"

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_SPLIT = re.compile(r"[\s,;:()\[\]{}<>/\\|]+")


def fold(text: str | None) -> list[str]:
    """The tokens of a text in lower case, still with marks at their edges."""
    return [t for t in _SPLIT.split((text or "").lower()) if t]


def bare(token: str) -> str:
    return token if token.isalpha() else _EDGE.sub("", token)


def edits_for(entry: str, stem: bool) -> int:
    """Edits that an entry tolerates: short ones would meet ordinary words."""
    n = len(entry) - (2 if stem else 0)
    return 0 if n < 5 else 1 if n < 9 else 2


class Automaton:
    """The trie of a lexicon times Levenshtein automata, determinised as tokens are read.

    A state is the set of (trie node, edits so far) that the letters read allow;
    nodes that tolerate fewer edits than spent are dropped.
    """

    MAX_STATES = 100_000

    def __init__(self, entries: list[tuple[str, bool, float]]):
        """``entries``: (text, whether it is a stem, weight)."""
        self.entries = sorted(entries)
        self.edits = [edits_for(w, stem) for w, stem, _ in self.entries]
        self.child: list[dict[str, int]] = [{}]
        self.allow = [0]
        self.word = [-1]  # the entry that ends at a node
        self.stem = [-1]
        for number, (word, stem, _) in enumerate(self.entries):
            k, at = self.edits[number], 0
            self.allow[0] = max(self.allow[0], k)
            for ch in word:
                if ch not in self.child[at]:
                    self.child[at][ch] = len(self.child)
                    self.child.append({})
                    self.allow.append(0)
                    self.word.append(-1)
                    self.stem.append(-1)
                at = self.child[at][ch]
                self.allow[at] = max(self.allow[at], k)
            (self.stem if stem else self.word)[at] = number
        self._reset()

    def __getstate__(self):
        return {"entries": self.entries}

    def __setstate__(self, state):
        self.__init__(state["entries"])

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[dict[int, int]] = []
        self.next: list[dict[str, int]] = []
        self.stem_best: list[tuple[int, float, int]] = []
        self.word_best: list[tuple[int, float, int]] = []
        self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        todo = list(nodes.items())
        while todo:  # letters of the entry that the token lacks
            node, e = todo.pop()
            if nodes[node] < e:
                continue
            for child in self.child[node].values():
                if e < self.allow[child] and e + 1 < nodes.get(child, 9):
                    nodes[child] = e + 1
                    todo.append((child, e + 1))
        key = frozenset(nodes.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(nodes)
            self.next.append({})
            self.word_best.append(self._best(nodes, self.word))
            self.stem_best.append(self._best(nodes, self.stem))
        return self.ids[key]

    def _best(self, nodes: dict[int, int], at: list[int]) -> tuple[int, float, int]:
        """(edits, -weight, entry) of the nearest entry that ends in a state."""
        ended = ((e, at[n]) for n, e in nodes.items() if at[n] >= 0)
        return min(((e, -self.entries[i][2], i) for e, i in ended if e <= self.edits[i]), default=(9, 0.0, -1))

    def _step(self, state: int, ch: str) -> int:
        out: dict[int, int] = {}
        for node, e in self.sets[state].items():
            same = self.child[node].get(ch)
            if same is not None and e < out.get(same, 9) and e <= self.allow[same]:
                out[same] = e
            if e < self.allow[node] and e + 1 < out.get(node, 9):
                out[node] = e + 1  # a letter that the entry lacks
            for child in self.child[node].values():
                if e < self.allow[child] and e + 1 < out.get(child, 9):
                    out[child] = e + 1  # another letter
        self.next[state][ch] = found = self._state(out) if out else -1
        return found

    def match(self, token: str) -> tuple[int, int] | None:
        """(edits, entry) of the nearest entry, or None."""
        if len(self.sets) > self.MAX_STATES:
            self._reset()
        state, best = 0, (9, 0.0, -1)
        for ch in token:
            last = state
            state = self.next[last].get(ch, -2)
            if state == -2:
                state = self._step(last, ch)
            if state < 0:
                break
            best = min(best, self.stem_best[state])
        if state >= 0:
            best = min(best, self.word_best[state])
        return (best[0], best[2]) if best[0] < 9 else None


class Features:
    """What a text's hits say: the strongest weights of words and stems, edited and quoted ones, and how dense they are.

    Misspelled hits count nearly as much as exact ones; the features of edits let the labels correct that.
    """

    SIZE = 9

    def __init__(self, automaton: Automaton, known: frozenset[str] = frozenset()):
        """``known``: words that are near an entry but no misspellings of it."""
        self.automaton, self.known = automaton, known
        self.clean: set[str] = set()
        self.hits: dict[str, tuple[int, int]] = {}

    def __getstate__(self):
        return {"automaton": self.automaton, "known": self.known}

    def __setstate__(self, state):
        self.__init__(state["automaton"], state["known"])

    def _find(self, token: str) -> None:
        found = None
        word = bare(token)
        if word and word not in self.known:
            found = self.automaton.match(word)
            if found is None and not word.isalpha():
                plain = word.translate(DISGUISES)
                if plain.isalpha() and plain != word and any(c.isalpha() for c in word):
                    found = self.automaton.match(plain)
        if found is None:
            self.clean.add(token)
        else:
            self.hits[token] = found

    def hit(self, token: str) -> tuple[int, int] | None:
        """(edits, entry) of a token of :func:`fold`, or None."""
        if token not in self.clean and token not in self.hits:
            self._find(token)
        return self.hits.get(token)

    @staticmethod
    def _quoted(tokens: list[str], i: int) -> bool:
        around = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
        here = i - max(0, i - WINDOW)
        before, after = around[: here + 1], around[here:]
        opened = any(t[0] in OPENING for t in before)
        closed = any(t.rstrip(".!?")[-1:] in CLOSING and t.rstrip(".!?") for t in after)
        said = any(bare(t) in SAYING for t in around[:here])
        return (opened and closed) or (said and (opened or closed))

    def __call__(self, text: str | None) -> np.ndarray:
        out = np.zeros(self.SIZE)
        tokens = fold(text)
        distinct = set(tokens)
        if len(self.clean) > 500_000:
            self.clean.clear()
        for t in distinct.difference(self.clean):
            if t not in self.hits:
                self._find(t)
        found = distinct.difference(self.clean)
        if not found:
            return out
        plain: dict[int, float] = {}
        hits = 0
        for i, t in enumerate(tokens):
            if t in found:
                edits, entry = self.hits[t]
                _, stem, weight = self.automaton.entries[entry]
                if self._quoted(tokens, i):
                    out[6] = max(out[6], weight)
                    continue
                hits += 1
                if edits:
                    out[3 + edits] = max(out[3 + edits], weight)
                    weight *= EDITED[edits - 1]
                plain[entry] = max(plain.get(entry, 0.0), weight)
        for stem in (False, True):
            own = sorted((w for k, w in plain.items() if self.automaton.entries[k][1] == stem), reverse=True)[:2]
            out[2 * stem : 2 * stem + len(own)] = own
        out[7] = np.log1p(hits)
        out[8] = np.log1p(100 * hits / len(tokens))
        return out


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with their texts' bands of minimum hashes."""
    for batch in batches:
        sketches = [_sketch(shingles(t)) for t in batch.column("text").to_pylist()]
        bands = {f"band{b}": pa.array([s[4 * BAND * b : 4 * BAND * (b + 1)] for s in sketches], pa.binary()) for b in range(BANDS)}
        yield pa.record_batch(dict(zip(batch.schema.names, batch.columns)) | bands)


def without_copies(sample: DataFrame) -> DataFrame:
    """``sample`` (doc_id, text, toxic) with one row, the smallest id, of those of one label that agree in all hashes of a band.

    Of two texts that share 80 % of their shingles one goes with a chance of 94 %, of two that share 10 % with 0.4 %.
    """
    names = ["doc_id", "text", "toxic", *(f"band{b}" for b in range(BANDS))]
    rows = sample.select(*names[:3]).mapInArrow(_banded, "doc_id long, text string, toxic boolean, " + ", ".join(f"{b} binary" for b in names[3:]))
    for band in names[3:]:
        first = F.min_by(F.struct(*names), F.struct("doc_id", F.xxhash64("text")))
        rows = rows.groupBy(F.col("toxic").alias("_toxic"), F.col(band).alias("_band")).agg(first.alias("r")).select("r.*")
    return rows.select(*names[:3])


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, whole, toxic, other): in how many texts words and stems occur."""
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}

    def flush():
        terms = list(set(counts[0]) | set(counts[1]))
        yield pa.record_batch(
            {"term": pa.array([t[0] for t in terms], pa.string()), "whole": pa.array([t[1] for t in terms], pa.bool_()),
             "toxic": pa.array([counts[1][t] for t in terms], pa.int64()), "other": pa.array([counts[0][t] for t in terms], pa.int64())}
        )
        counts[0].clear()
        counts[1].clear()

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = {w for w in map(bare, set(fold(text))) if 3 <= len(w) <= 30}
            stems = {(w[:k], False) for w in words for k in STEM_LENGTHS if len(w) > k}
            counts[int(toxic)].update(stems)
            counts[int(toxic)].update((w, True) for w in words)
            if len(counts[0]) + len(counts[1]) > 1_000_000:
                yield from flush()
    yield from flush()


def _lexicon(terms: list) -> list[tuple[str, bool, float]]:
    """Entries (text, is a stem, weight) from the terms that stand out.

    A stem is one if no single word explains its texts; of nested stems the
    shortest stands, lengthened while it loses no texts.
    """
    whole = {r.term: r for r in terms if r.whole}
    stems = {r.term: r for r in terms if not r.whole}
    best: Counter = Counter()
    for w, r in whole.items():
        for k in STEM_LENGTHS:
            best[w[:k]] = max(best[w[:k]], r.toxic)
    roots: list[str] = []
    for s in sorted(stems, key=lambda s: (len(s), s)):
        if stems[s].toxic > 1.3 * best[s] and not any(s.startswith(r) for r in roots):
            roots.append(s)
    out = []
    for s in roots:
        longer = [q for q in stems if q.startswith(s) and stems[q].toxic >= 0.95 * stems[s].toxic]
        q = max(longer, key=lambda q: (len(q), q))
        out.append((q, True, stems[q].weight))
    chosen = [s for s, _, _ in out]
    return out + [(w, False, r.weight) for w, r in whole.items() if not any(w.startswith(s) for s in chosen)]


def misspelled(word: str, edits: int, rng: random.Random) -> str:
    """``word`` after random edits: another letter, a letter twice, a letter less."""
    for _ in range(edits):
        i = rng.randrange(1, max(2, len(word)))
        what = rng.randrange(3)
        word = word[:i] + (rng.choice("abcdefghijklmnopqrstuvwxyz") if what == 0 else word[i - 1] + word[i : i + 1] if what == 1 else "") + word[i + 1 :]
    return word


def examples(text: str | None, toxic: bool, features: Features, rng: random.Random) -> Iterator[tuple[str, bool, float]]:
    """(text, label, weight): a labelled text, and what is made up from it."""
    yield text or "", toxic, 1.0
    entries = features.automaton.entries
    tokens = fold(text)
    if toxic:
        found = [features.hit(t) for t in tokens]
        edits = [features.automaton.edits[f[1]] if f and not f[0] else 0 for f in found]
        if any(edits):
            yield " ".join(misspelled(t, rng.randint(1, e), rng) if e else t for t, e in zip(tokens, edits)), True, MADE_UP
    elif entries and rng.random() < 0.1:
        word = rng.choice(entries)[0]
        at = rng.randrange(len(tokens) + 1)
        yield " ".join([*tokens[:at], "said", f'"{word}"', *tokens[at:]]), False, MADE_UP


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), 0.5)
    ridge[-1] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x.T * (weight * (p * (1 - p) + 1e-9))) @ x + np.diag(ridge), grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """The lexicon, words that only look like its entries, and the weights of the features."""

    def __init__(self, entries: list[tuple[str, bool, float]], weights: np.ndarray, known: frozenset[str] = frozenset()):
        self.entries, self.weights, self.known = entries, weights, known

    def scorer(self):
        features, weights = Features(Automaton(self.entries), self.known), self.weights

        def score(text: str | None) -> float:
            z = float(np.clip(features(text) @ weights[:-1] + weights[-1], -30, 30))
            return 1 / (1 + np.exp(-z))

        return score


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, held_fold: int | None = 2, max_train: int = MAX_TRAIN) -> Model:
    """Fits the lexicon and the weights to about ``max_train`` labelled texts outside the held-out fold, less their copies."""
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if held_fold is not None:
        marks = marks.where(id_remainder(F.col("doc_id"), folds) != held_fold)
    n = marks.count()
    if n > max_train:
        marks = marks.where(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1_000_000)) < int(1_000_000 * max_train / n))
    few = F.broadcast(marks)  # max_train rows
    sample = docs.select("doc_id", "text").join(few, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.col("toxic") > 0).alias("toxic"))
    sample = without_copies(sample).select("text", "toxic")  # copies of one text would make its rare words stand out
    sample = sample.persist()
    try:
        size = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
        toxic, other = size.get(True, 0), size.get(False, 0)
        if not toxic:
            return Model([], np.concatenate([np.zeros(Features.SIZE), [-3.0]]))
        terms = sample.mapInArrow(_term_counts, "term string, whole boolean, toxic long, other long").groupBy("term", "whole")
        terms = written(terms.agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")), "terms")
        sure = F.greatest(F.col("toxic") - F.sqrt("toxic"), F.lit(0.0)) / toxic  # a standard error less
        most = (F.col("other") + F.sqrt(F.col("other") + 1)) / max(1, other)  # and one more
        strong = terms.withColumn("ratio", sure / most).where(F.col("ratio") >= MIN_RATIO)
        strong = strong.select("term", "whole", "toxic", F.least(F.ln("ratio"), F.lit(7.0)).alias("weight"))
        entries = _lexicon(strong.orderBy(F.col("weight").desc(), "term", "whole").collect())  # terms of max_train texts
        automaton = Automaton(entries)

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([(automaton.match(w) or (0, 0))[0] > 0 for w in batch.column(0).to_pylist()], pa.bool_()))

        plain = terms.where(F.col("whole") & (F.col("other") >= KNOWN_TEXTS)).select("term")
        known = frozenset(r.term for r in plain.mapInArrow(near, "term string").collect())

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            f = Features(automaton, known)
            for batch in batches:
                rows = []
                for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    rng = random.Random(zlib.crc32((text or "").encode("utf-8", "surrogatepass")))
                    rows += [(f(t).tolist(), y, w) for t, y, w in examples(text, toxic, f, rng)]
                x, y, w = zip(*rows) if rows else ((), (), ())
                yield pa.record_batch({"x": pa.array(x, pa.list_(pa.float64())), "toxic": pa.array(y, pa.bool_()), "weight": pa.array(w, pa.float64())})

        rows = sample.mapInArrow(features, "x array<double>, toxic boolean, weight double").collect()  # max_train short rows, and made-up ones
    finally:
        sample.unpersist()
    x, y = np.array([r.x for r in rows]), np.array([r.toxic for r in rows], dtype=np.float64)
    return Model(entries, _fit(x, y, np.array([r.weight for r in rows])), known)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = model.scorer()
        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column(0), "score": [one(t) for t in batch.column(1).to_pylist()]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = model.scorer()
        at = names.index("text")
        for batch in batches:
            yield batch.filter(pa.array([one(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
