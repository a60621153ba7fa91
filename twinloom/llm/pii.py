"""Personal data by fixed patterns and a skip-chain conditional random field.

Emails, addresses of machines, card and phone numbers are found by patterns.
The random field labels all tokens with a digit or an at sign. Neighbours share
a chain potential. Tokens with the same letters, digits or last seven digits of
a run of numbers, however far apart, share skip potentials with one hidden
variable of what they have in common, so that a number written without its
country code, say, gets the label of the full one elsewhere in the text. Loopy
message passing, repeated until no message changes, gives the tokens' label
probabilities; the patterns' own finds are its evidence and always stay.

The weights of features, chain and skip edges are fitted together, by the
likelihood of each token's label given its neighbours', on texts that the
patterns have marked. To each of them lines are added that the patterns do not
find: its own finds in another writing (personal data), and as many numbers and
names of the same shapes drawn at random (not personal data), so that the shape
alone does not decide.

Edge cases: null and empty texts have no spans; a text without digits and at
signs has none either; rows that repeat are searched each; other columns are not
looked at; if the corpus has nothing to learn from, only the patterns count.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
#: Texts with a digit or an at sign that the field is trained on (about; chosen by a hash of the id).
MAX_TRAIN = 2_000
#: Messages are passed until none changes by more, or (on graphs that do not settle) so many times.
SETTLED, ROUNDS = 1e-4, 200
#: Probability from which a token gets a label that no pattern gave it.
SURE = 0.9
EVIDENCE = 8.0
RIDGE = 0.05
#: A key of fewer letters and digits says nothing about sameness; a run of numbers is known by its last SUFFIX digits.
KEY_LENGTH = 6
SUFFIX = 7

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_LIKELY = re.compile(r"[0-9@]")
_EDGES = re.compile(r"^[^\w+(]+|[^\w)]+$")

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, least = text.find("@"), 0
    while at >= 0:
        start = at
        while start > least and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            least = m.end()
        at = text.find("@", max(at + 1, least))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """What the patterns find, by kind and then by start; end is exclusive."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)]
    if not _LIKELY.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


class Tokens:
    """The tokens of a text that may be personal data: places, features, base labels, chain and skip edges."""

    def __init__(self, text: str, spans: list[Span]):
        self.text = text
        places = [(m.start(), m.end()) for m in _TOKEN.finditer(text) if _LIKELY.search(m[0])]
        self.start = np.array([a for a, _ in places], dtype=np.int64)
        self.end = np.array([b for _, b in places], dtype=np.int64)
        n = len(places)
        self.base = np.zeros(n, np.int64)
        for kind, a, b in spans:
            i, j = np.searchsorted(self.end, a, side="right"), np.searchsorted(self.start, b, side="left")
            self.base[i:j] = np.where(self.base[i:j] == 0, LABELS.index(kind), self.base[i:j])
        words = [text[a:b] for a, b in places]
        self.x = np.stack([self._features(w) for w in words]) if n else np.zeros((0, self.SIZE))
        near = np.flatnonzero(self.start[1:] - self.end[:-1] <= 1) if n else np.zeros(0, np.int64)
        self.chain = np.column_stack([near, near + 1])
        shared: dict[str, list[int]] = {}
        run = ""
        for i, w in enumerate(words):
            run = (run if i and self.start[i] - self.end[i - 1] <= 1 else "") + _digits(w)
            for key in self._keys(w) | ({"s" + run[-SUFFIX:]} if len(run) >= SUFFIX else set()):
                shared.setdefault(key, []).append(i)
        hubs = {tuple(at) for at in shared.values() if len(at) > 1}  # several keys of the same tokens are one
        #: (token, number of the hidden variable it shares)
        self.skip = np.array([(i, k) for k, at in enumerate(sorted(hubs)) for i in at], dtype=np.int64).reshape(-1, 2)
        self.hubs = len(hubs)

    SIZE = 17

    @staticmethod
    def _keys(word: str) -> set[str]:
        letters = "".join(c for c in word.lower() if c.isalnum())
        digits = _digits(word)
        out = {"w" + letters} if len(letters) >= KEY_LENGTH else set()
        if len(digits) >= KEY_LENGTH:
            out.add("d" + digits)
        if "@" in word:
            out.add("l" + word.lower().split("@")[0].strip("<(\"'"))
        return out

    @staticmethod
    def _features(word: str) -> np.ndarray:
        d = _digits(word)
        letters = sum(c.isalpha() for c in word)
        parts = word.strip(".,;:()[]<>\"'").split(".")
        four = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 for p in parts)  # other scripts have digits that are no numbers
        n = len(d)
        return np.array(
            [1, "@" in word, "@" in word and "." in word.rsplit("@", 1)[-1], four, four and all(int(p) <= 255 for p in parts),
             n == 0, 1 <= n <= 2, n == 3, 4 <= n <= 6, n == 7, 8 <= n <= 12, n >= 13, n >= 13 and n <= 19 and luhn(d),
             word[0] == "+", word[0] == "(" or ")" in word, "-" in word, letters > 0], dtype=np.float64
        )


class Model:
    """Weights of a token's features by label, and log potentials of chain and skip edges."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip

    def marginals(self, t: Tokens) -> np.ndarray:
        """Label probabilities by loopy message passing."""
        k = len(LABELS)
        score = t.x @ self.unary
        given = t.base > 0
        score[given] = 0.0
        score[given, t.base[given]] = EVIDENCE
        n = len(score)
        edges = np.concatenate([t.chain, t.skip + [0, n]])
        if not len(edges):
            return _softmax(score)
        score = np.concatenate([score, np.zeros((t.hubs, k))])
        pot = np.concatenate([np.repeat(self.chain[None], len(t.chain), 0), np.repeat(self.skip[None], len(t.skip), 0)])
        a = np.concatenate([edges[:, 0], edges[:, 1]])
        b = np.concatenate([edges[:, 1], edges[:, 0]])
        pot = np.concatenate([pot, pot.transpose(0, 2, 1)])
        m = len(edges)
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        msg = np.zeros((2 * m, k))
        for _ in range(ROUNDS):
            belief = score.copy()
            np.add.at(belief, b, msg)
            out = (belief[a] - msg[back])[:, :, None] + pot
            top = out.max(axis=1, keepdims=True)
            new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
            new -= new.max(axis=1, keepdims=True)
            change, msg = np.abs(new - msg).max(), 0.4 * msg + 0.6 * new
            if change < SETTLED:
                break
        belief = score.copy()
        np.add.at(belief, b, msg)
        return _softmax(belief[:n])

    def added(self, t: Tokens, spans: list[Span]) -> list[Span]:
        """Spans of tokens that got a label only here: runs of neighbours with one label."""
        p = self.marginals(t)
        best = p.argmax(axis=1)
        fresh = (t.base == 0) & (best > 0) & (p.max(axis=1) >= SURE)
        out: list[Span] = []
        i = 0
        while i < len(best):
            if not fresh[i]:
                i += 1
                continue
            j = i + 1
            while j < len(best) and fresh[j] and best[j] == best[i] and t.start[j] - t.end[j - 1] <= 1:
                j += 1
            a, b = int(t.start[i]), int(t.end[j - 1])
            piece = t.text[a:b]
            left = _EDGES.match(piece)
            a += left.end() if left and left.start() == 0 and left.end() < len(piece) else 0
            b -= len(t.text[a:b]) - len(_EDGES.sub("", t.text[a:b]))
            kind = LABELS[best[i]]
            if a < b and not any(k == kind and x < b and a < y for k, x, y in spans):
                out.append((kind, a, b))
            i = j
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def other_writing(kind: str, find: str) -> str | None:
    """A find as the patterns would not see it: a phone number without its country code, a card number with dots, an email without its domain's end."""
    if kind == "phone":
        rest = find.lstrip("+")
        cut = next((i for i, c in enumerate(rest) if not "0" <= c <= "9"), 1 if len(rest) < 12 else 2)
        return rest[cut:].lstrip(" .-") or None
    if kind == "card":
        d = _digits(find)
        return ".".join(d[i : i + 4] for i in range(0, len(d), 4))
    if kind == "email":
        return find[: find.index(".", find.index("@"))]
    return None


def with_other_writings(text: str, rng: random.Random) -> tuple[str, list[Span], list[Span]]:
    """A text with its finds in other writings, and with random ones of the same shapes; with the spans of both."""
    own, strange = [], []
    for kind, a, b in base_spans(text):
        if again := other_writing(kind, text[a:b]):
            like = re.sub("[0-9]", lambda _: str(rng.randrange(10)), again)
            like = re.sub("[a-z]", lambda _: rng.choice("abcdefghijklmnopqrstuvwxyz"), like)
            own.append((kind, again))
            if kind != "email":  # a random name before an at sign is an email too
                strange.append((kind, like))
    lines = [(True, *x) for x in own] + [(False, *x) for x in strange]
    rng.shuffle(lines)
    good: list[Span] = []
    bad: list[Span] = []
    for mine, kind, line in lines:
        text += " then "
        (good if mine else bad).append((kind, len(text), len(text) + len(line)))
        text += line
    return text + " end", good, bad


def _training_rows(text: str, seed: int) -> Iterator[tuple[bytes, int]]:
    """(what a token's label may hang on, label) for the tokens of a text with other writings."""
    text, good, _ = with_other_writings(text, random.Random(seed))
    t = Tokens(text, base_spans(text) + good)
    n, k = len(t.base), len(LABELS)
    seen = np.zeros((n, 3 * k), np.int64)
    for i, j in t.chain.tolist():
        seen[j, t.base[i]] += 1
        seen[i, k + t.base[j]] += 1
    totals = np.zeros((t.hubs, k), np.int64)
    np.add.at(totals, (t.skip[:, 1], t.base[t.skip[:, 0]]), 1)
    for i, h in t.skip.tolist():
        others = totals[h].copy()
        others[t.base[i]] -= 1
        seen[i, 2 * k + (int(others[1:].argmax()) + 1 if others[1:].any() else 0)] += 1
    for i in range(n):
        yield np.concatenate([t.x[i], np.minimum(seen[i], 9)]).astype(np.int8).tobytes(), int(t.base[i])


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often what a label may hang on goes with each label."""
    for batch in batches:
        rows: dict[tuple[bytes, int], int] = {}
        for text in batch.column(0).to_pylist():
            for key in _training_rows(text or "", zlib.crc32((text or "").encode("utf-8", "surrogatepass"))):
                rows[key] = rows.get(key, 0) + 1
        if rows:
            keys, labels = zip(*rows)
            yield pa.record_batch({"key": pa.array(keys, pa.binary()), "label": pa.array(labels, pa.int64()), "n": pa.array(rows.values(), pa.int64())})


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge multinomial logistic regression: steps of Newton's method on each label in turn."""
    k = len(LABELS)
    w = np.zeros((x.shape[1], k))
    ridge = RIDGE * np.eye(x.shape[1])
    for _ in range(30):
        for j in range(1, k):
            p = _softmax(x @ w)[:, j]
            grad = x.T @ (weight * (p - (y == j))) + RIDGE * w[:, j]
            hess = (x.T * (weight * (p * (1 - p) + 1e-6))) @ x + ridge
            w[:, j] -= np.clip(np.linalg.solve(hess, grad), -3, 3)
    return w


def train(docs: DataFrame, max_train: int = MAX_TRAIN) -> Model | None:
    """Fits the field to about ``max_train`` texts that have a digit or an at sign."""
    likely = docs.where(F.col("text").rlike("[0-9@]")).select("doc_id", "text")
    n = likely.count()
    if not n:
        return None
    share = min(1.0, max_train / n)
    sample = likely.where(F.pmod(F.xxhash64("doc_id", F.lit("pii")), F.lit(1_000_000)) < int(share * 1_000_000)).select("text")
    stats = sample.mapInArrow(_statistics, "key binary, label long, n long").groupBy("key", "label").agg(F.sum("n").alias("n")).orderBy("key", "label").collect()
    if not any(r.label for r in stats):
        return None
    k = len(LABELS)
    x = np.array([np.frombuffer(bytes(r.key), np.int8) for r in stats], dtype=np.float64)
    w = _fit(x, np.array([r.label for r in stats]), np.array([r.n for r in stats], dtype=np.float64))
    unary, before, after, skip = np.split(w, [Tokens.SIZE, Tokens.SIZE + k, Tokens.SIZE + 2 * k])
    return Model(unary, (before + after.T) / 2, skip.T)


def _joined(spans: list[Span]) -> str:
    ordered = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered)


def find(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, counts of base spans by kind, their sha256, and all spans, of each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sums, every = [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                spans = base
                if model is not None and _LIKELY.search(text):
                    spans = base + model.added(Tokens(text, base), base)
                counts.append([sum(k == kind for k, _, _ in base) for kind in KINDS])
                sums.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                every.append(_joined(spans))
            columns = {f"n_{kind}": pa.array([c[i] for c in counts], pa.int64()) for i, kind in enumerate(KINDS)}
            yield pa.record_batch({"doc_id": batch.column(0), **columns, "base_sha256": pa.array(sums, pa.string()), "spans": pa.array(every, pa.string())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )


def redact(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets."""
    names = docs.columns

    def clean(text: str | None) -> str | None:
        if not text or not _LIKELY.search(text):
            return text
        base = base_spans(text)
        spans = sorted((a, b, k) for k, a, b in base + (model.added(Tokens(text, base), base) if model else []))
        out, at = [], 0
        for a, b, kind in spans:
            if a >= at:
                out += [text[at:a], f"<{kind}>"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            yield batch.set_column(at, batch.schema.field(at), pa.array([clean(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
