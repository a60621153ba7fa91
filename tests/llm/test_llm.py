"""The operators against SQL, brute force, round trips and held-out labels, and on odd tables."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF, duck, rows
from pyspark.sql import functions as F

from twinloom.llm import decontaminate, html_text, mixing, ngram_join, pii, pitman_yor, seating, secrets, tokens, topk, toxicity
from twinloom.llm.queries import ORACLE_SQL, QUERIES, TOKENIZER

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, row string, path string"
LONG = " ".join(f"w{i}" for i in range(20_000))
ODD = [
    (None, None, None, None, None, 1, "r", "p"), (1, "", "en", "a", 0, 1, "r", "p"), (2, LONG, "en", "a", 9, 1, "r", "p"), (3, LONG, "en", None, 9, 1, "r", "p"),
    (3, LONG, "en", None, 9, 1, "r", "p"), (4, "one two", "en", "b", 7, None, None, None), (5, "you idiot! +1 (988) 555-2485 password=ab12cd34ef56ab78", "en", "b", 5, 1, "r", "p"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck(ORACLE_SQL[name]))


def _classes(texts, threshold=0.8):
    sets = [set(ngram_join.shingles(t).tolist()) for t in texts]
    group, links = list(range(len(sets))), [0] * len(sets)
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return group, links


def test_ngram_join_is_brute_force(spark, docs):
    p = docs.toPandas().sort_values("doc_id")
    group, links = _classes(p.text)
    ids = p.doc_id.tolist()
    expected = sorted((ids[i], ids[g], n) for i, (g, n) in enumerate(zip(group, links)))
    assert sorted(map(tuple, ngram_join.jaccard_classes(docs).collect())) == expected


def test_ngram_join_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAF", 16)
    monkeypatch.setattr(ngram_join, "BLOCK", 12)
    base = [f"t{i}" for i in range(200)]
    texts = [" ".join(base[:k] + ["x"] + base[k + 1 :]) for k in range(60)] + ["alone " * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    group, links = _classes(texts)
    assert sorted(map(tuple, ngram_join.jaccard_classes(df).collect())) == [(i, g, n) for i, (g, n) in enumerate(zip(group, links))]


def test_ngram_join_at_a_lower_threshold(spark):
    rng = np.random.default_rng(8)
    texts = []
    for g in range(30):
        base = [f"g{g}w{i}" for i in range(120)]
        texts += [" ".join(w if rng.random() > 0.04 else f"x{rng.integers(1e9)}" for w in base) for _ in range(4)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    group, links = _classes(texts, 0.5)
    assert sum(links) > 100
    assert sorted(map(tuple, ngram_join.jaccard_classes(df, 0.5).collect())) == [(i, g, n) for i, (g, n) in enumerate(zip(group, links))]


def test_ngram_join_of_texts_with_common_parts(spark, monkeypatch):
    # a third of each text is one passage: buckets are split beyond the first levels, and the copies among them are found
    monkeypatch.setattr(ngram_join, "LEAF", 8)
    monkeypatch.setattr(ngram_join, "BLOCK", 6)
    rng = np.random.default_rng(1)
    common = " ".join(f"c{i}" for i in range(60))
    texts = [common + " " + " ".join(f"w{x}" for x in rng.integers(0, 10**6, 90)) for _ in range(250)]
    texts += [t.rsplit(" ", 3)[0] for t in texts[:40]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    group, links = _classes(texts)
    assert sum(links) == 80
    assert sorted(map(tuple, ngram_join.jaccard_classes(df).collect())) == [(i, g, n) for i, (g, n) in enumerate(zip(group, links))]


def test_ngram_join_pivots_lose_no_class(spark, monkeypatch):
    """Buckets that do not come apart: what is linked to no pivot still meets all others."""
    monkeypatch.setattr(ngram_join, "LEAF", 16)
    rng = np.random.default_rng(5)
    agreed = ngram_join.agree_for(0.8)
    rows, leaves, expected = [], [], []
    # paths: one cloud, a chain of sets that drift away from their start, two clouds and loners
    for path, steps in ((1, [0]), (2, range(0, 300, 2)), (3, [0, 64])):
        start = rng.integers(0, 2**32, 64, dtype=np.uint64).astype("<u4")
        other = rng.integers(0, 2**32, (512,), dtype=np.uint64).astype("<u4")
        made = []
        for k in range(150):
            m = np.concatenate([start, other])[(shift := list(steps)[k % len(steps)]) : shift + 64].copy()
            if path != 2:
                at = rng.choice(64, 10 if k % 25 else 60, replace=False)
                m[at] = rng.integers(0, 2**32, len(at), dtype=np.uint64)
            made.append(m if path != 2 else np.roll(m, shift))
        m = np.stack(made)
        nodes = 1000 * path + np.arange(len(m))
        label = nodes[_classes_of((m[:, None] == m[None, :]).sum(axis=2) >= agreed)]
        expected += [(int(n), int(c)) for n, c in zip(nodes, label)]
        rows += [(int(n), bytearray(x.tobytes())) for n, x in zip(nodes, m)]
        leaves += [(path, int(n), len(m)) for n in nodes]
    sets = spark.createDataFrame(rows, "node long, sketch binary")
    links = ngram_join.near_links(spark.createDataFrame(leaves, "path long, node long, n long"), sets, agreed)
    found = {r.id: r.comp for r in ngram_join.connected_components(links).collect()}
    assert {(n, found.get(n, n)) for n, _ in expected} == set(expected)
    assert 3 < len({c for _, c in expected}) < 60


def test_ngram_join_splits_a_group_of_near_copies_twice(spark, monkeypatch):
    """It does not come apart, so further splits would only repeat its rows; these grow as the group does."""
    monkeypatch.setattr(ngram_join, "LEAF", 16)
    made, write = [], ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, name: (out := write(df, name), name == "buckets" and made.append(out.count()))[0])
    rng, runs = random.Random(4), ngram_join.runs_for(0.999)
    base = [f"w{i}" for i in range(600)]
    copies = [" ".join(w if i != at else "x" for i, w in enumerate(base)) for at in rng.sample(range(600), 200)]
    sets = spark.createDataFrame([(i, ngram_join._sketch(ngram_join.shingles(t))) for i, t in enumerate(copies)], "node long, sketch binary")
    total = []
    for n in (100, 200):
        made.clear()
        leaves = ngram_join.candidate_leaves(sets.where(F.col("node") < n), 0.999, 0.8)
        links = ngram_join.near_links(leaves, sets, ngram_join.agree_for(0.8))
        assert {r.comp for r in ngram_join.connected_components(links).collect()} == {0}
        assert leaves.select("node").distinct().count() == n
        total.append(sum(made))
    assert total[1] <= 2 * runs * 200 and total[1] <= 2.2 * total[0]


def test_connected_components_of_odd_graphs(spark):
    r = random.Random(3)
    some = r.sample(range(900), 300)
    graphs = {
        "chain": [(i, i + 1) for i in range(300)], "star": [(i, 5000) for i in range(200)], "shuffled": list(zip(some, some[1:])),
        "random": [(r.randrange(400), r.randrange(400)) for _ in range(250)], "loop": [(3, 3)], "none": [],
    }
    for name, edges in graphs.items():
        of: dict[int, int] = {}
        for a, b in edges:
            if a != b:
                a, b = of.setdefault(a, a), of.setdefault(b, b)
                of = {k: min(a, b) if v in (a, b) else v for k, v in of.items()}
        found = ngram_join.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert {r.id: r.comp for r in found} == of and len(found) == len(of), name


def _classes_of(linked):
    labels = np.arange(len(linked))
    while True:
        new = np.where(linked, labels[None, :], len(linked)).min(axis=1)
        if (new == labels).all():
            return labels
        labels = new


def test_ngram_join_runs():
    assert ngram_join.runs_for(0.999) >= ngram_join.runs_for(0.99) > 1
    assert ngram_join.runs_for(0.9, 1.0) == 1


def test_ngram_join_on_odd_tables(spark, odd, empty):
    found = sorted(map(tuple, ngram_join.jaccard_classes(odd).collect()), key=repr)
    assert found == sorted([(None, None, 0), (1, 1, 0), (2, 2, 2), (3, 2, 2), (3, 2, 2), (4, 4, 0), (5, 5, 0)], key=repr)
    assert ngram_join.jaccard_classes(empty).count() == 0
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([None, 1, 2, 4, 5], key=repr)
    assert ngram_join.one_of_each(empty).count() == 0


def test_one_row_of_each_class_stays(spark):
    text, near, other = (" ".join(f"{x}{i}" for i in range(100)) for x in "ttu")
    near = near.replace("t99", "v")
    rows_ = [(1, text, "a"), (1, text, "b"), (2, text, "c"), (5, text, "d"), (None, text, "e"), (5, other, "f"), (None, other, "g"), (None, "only here", "h"), (None, "only here", "i"),
             (None, None, "j"), (None, None, "k"), (7, " ", "l"), (7, " ", "l"), (9, near, "m"), (1, other + " end", "n")]
    kept = ngram_join.one_of_each(spark.createDataFrame(rows_, "doc_id long, text string, `other.one` string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.text and r.text.strip() and r.doc_id) == [(1, text), (1, other + " end")]
    assert sorted(r[2] for r in kept if not r.text or not r.text.strip()) == ["j", "k", "l", "l"]
    assert [(r.doc_id, r.text) for r in kept if r.text == "only here"] == [(None, "only here")] and len(kept) == 7


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = "".join(c for c in m[0] if c in "0123456789")
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 13 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}
            if good[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_base_is_the_patterns(spark, docs, odd, empty):
    odd_texts = ["a@b@c.d.e x@y.z.", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.04", "+1 (2) 3-4-5-6-7-8-9 +1234 +", "4111 1111-1111 1111 4111111111111112", "é@x.y +44.20.7946.0958", ""]
    for text in [r.text for r in docs.select("text").collect()] + odd_texts:
        assert pii.base_spans(text) == _plain(text)
    found = pii.find(docs, pii.train(docs)).toPandas()
    texts = dict(docs.select("doc_id", "text").collect())
    for r in found.itertuples():
        base = [f"{k}:{a}:{b}" for k, a, b in _plain(texts[r.doc_id])]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(r.spans.split(",")) | {""}
    assert pii.find(odd, pii.train(odd)).count() == len(ODD) and pii.train(empty) is None and pii.find(empty, None).count() == 0


def test_pii_field_labels_repeats(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = pii.train(docs)
    text = "Call +1 (988) 555-2485 now, later (988) 555-2485 again"
    base = pii.base_spans(text)
    assert model.added(pii.Tokens(text, base), base) == [("phone", 34, 48)]
    assert pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first().text == "Call <phone> now, later <phone> again"


def test_pii_field_finds_other_writings_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = pii.train(docs.where("doc_id % 2 = 0"))
    found = {True: [], False: []}
    for r in docs.where("doc_id % 2 = 1 and text like '%@%' or text like '%+%'").select("text").collect():
        text, good, bad = pii.with_other_writings(r.text, random.Random(1))
        base = pii.base_spans(text)
        added = model.added(pii.Tokens(text, base), base)
        for mine, spans in ((True, good), (False, bad)):
            found[mine] += [any(k == kind and a < end and start < b for k, a, b in added) for kind, start, end in spans]
    assert len(found[True]) > 100 and np.mean(found[True]) > 0.9 and len(found[False]) > 50 and np.mean(found[False]) < 0.05


def test_pii_field_reaches_all_repeats_and_is_linear(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = pii.train(docs)
    text = "Call +1 (988) 555-2485 now" + ", then as before (988) 555-2485 again" * 40
    base = pii.base_spans(text)
    assert len(model.added(pii.Tokens(text, base), base)) == 40
    began = time.time()
    for long in ("a" * 2_000_000, "漢" * 500_000 + "1", "9" * 300_000, "a@" * 100_000, "+1 (" * 100_000):
        pii.base_spans(long)
        pii.Tokens(long, [])
    assert time.time() - began < 20


def test_html(spark):
    page = "<title>T</title><style>.ad{display:none}</style><h1>Hi &amp; you</h1><p>One<p>two<div class=ad>no</div><ul><li>a<li>b<ol start=3><li>x</ol></ul><table><tr><th>Name<th>n<tr><td>kiwi fruit<td>12</table><pre> a\n  b</pre>x<br>y<span hidden>no</span><script>no</script>"
    assert html_text.render(page) == "Hi & you\n\nOne\n\ntwo\n\n- a\n- b\n  3. x\n\nName       | n\nkiwi fruit | 12\n\n a\n  b\n\nx\ny"
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<div>" * 5000 + "deep"), (4, "<p a='unclosed"), (4, "plain  text")], "page_id long, html string")
    assert [r.text for r in html_text.extract_text(df).collect()][:3] == [None, "", "deep"]


def test_html_of_drawings_formulas_and_spans():
    formula = "<p>So <math><semantics><mrow><mi>E</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></mrow><annotation>tex</annotation></semantics></math> holds"
    drawing = "<svg>no<title>no</title><defs><text>no</text></defs><defs/><g><path d='M0'/><text>Input</text><text>Out <tspan>put</tspan></text></g><desc>no</desc></svg>after"
    assert html_text.render(formula) == "So E=1 2 holds"
    assert html_text.render(drawing) == "Input\nOut put\nafter"
    table = "<table><tbody><tr><td rowspan=2>a<td>b<td rowspan=0>c<tr><td>d<tr><td>e<td>f<tbody><tr><td>g<td>h<td>i</table>"
    assert html_text.render(table) == "a | b | c\n  | d\ne | f\ng | h | i"


def test_decontamination_on_odd_tables(spark, odd, empty):
    bench = spark.createDataFrame([(1, " ".join(f"W{i}" for i in range(50, 70))), (2, "ONE two"), (2, "one, two"), (3, None), (None, "one two")], "item_id long, text string")
    found = {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.judged(decontaminate.find_hits(odd, bench)).collect()}
    assert (2, 20000, 20, 1, False) in found and (4, 2, 2, 1, True) in found and (None, 0, 0, 0, False) in found
    assert decontaminate.find_hits(odd, bench).count() == len(ODD)
    assert decontaminate.decontaminate(odd, bench).count() == len(ODD) - 1
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(odd, bench, "spans").collect()}
    assert cut[4] == "" and cut[5] == ODD[-1][1]
    assert decontaminate.find_hits(odd, bench.where("item_id > 9")).where("size(spans) > 0").count() == 0 and decontaminate.find_hits(empty, bench).count() == 0


def test_decontamination_without_broadcast(spark, docs, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = decontaminate.judged(decontaminate.find_hits(docs, bench)).select(*decontaminate.DIGEST).toPandas()
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 10)
    monkeypatch.setattr(decontaminate, "MIN_BYTES", 4096)
    monkeypatch.setattr(decontaminate, "MAX_BYTES", 4096)  # a bit set that lets most probes through
    assert rows(decontaminate.judged(decontaminate.find_hits(docs, bench)).select(*decontaminate.DIGEST).toPandas()) == rows(whole)


def test_scores(docs, odd, empty):
    p = docs.toPandas()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, t in zip(p.doc_id, p.text) if not held(i) for w in [*pitman_yor.tokens(t), None])
    n, v = sum(count.values()), len(count)
    texts = dict(zip(p.doc_id, p.text))
    found = pitman_yor.score(docs).collect()
    assert len(found) == len(p)
    for r in found:
        words = [*pitman_yor.tokens(texts[r.doc_id]), None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(words), sum(count[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words))
    out = [r for r in found if r.held_out]  # a tenth of the unigram model's perplexity, or less on texts with copies
    assert sum(r.score for r in out) / sum(r.n_tokens for r in out) > sum(r.base_score for r in out) / sum(r.n_tokens for r in out) + 0.3
    assert pitman_yor.score(odd).count() == len(ODD) and pitman_yor.score(empty).count() == 0


def _one_by_one(texts, base, discount, above, sweeps=200, burn=100):
    """Pair probabilities by a plain sampler: every customer of every restaurant stands up and is seated anew, one after the other."""
    rng = np.random.default_rng(3)
    rooms, order = {}, []  # context -> dish -> sizes of tables

    def p(w, room):
        own = rooms.get(room, {})
        c, t, n, k = sum(own.get(w, [])), len(own.get(w, [])), sum(map(sum, own.values())), sum(map(len, own.values()))
        d = above if room is None else discount
        return (c - d * t + (1 + d * k) * (base if room is None else p(w, None))) / (1 + n)

    def sit(w, room):
        own, d = rooms.setdefault(room, {}), above if room is None else discount
        k = sum(map(len, own.values()))
        weights = [s - d for s in own.get(w, [])] + [(1 + d * k) * (base if room is None else p(w, None))]
        at = rng.choice(len(weights), p=np.array(weights) / sum(weights))
        if at == len(own.get(w, [])):
            own.setdefault(w, []).append(0)
            if room is not None:
                sit(w, None)
        own[w][at] += 1

    def stand(w, room):
        sizes = rooms[room][w]
        at = rng.choice(len(sizes), p=np.array(sizes) / sum(sizes))
        sizes[at] -= 1
        if not sizes[at]:
            sizes.pop(at)
            if room is not None:
                stand(w, None)

    for words in texts:
        order += zip(["<", *words], [*words, ">"])
    for u, w in order:
        sit(w, u)
    seen = sorted({w for _, w in order}) + ["?"]
    total = {}
    for sweep in range(sweeps):
        for u, w in order:
            stand(w, u)
            sit(w, u)
        if sweep >= burn:
            for u in [*{u for u, _ in order}, "?"]:
                for w in seen:
                    total[u, w] = total.get((u, w), 0) + p(w, u) / (sweeps - burn)
    return total


def test_scores_are_those_of_a_plain_sampler(spark, monkeypatch):
    rng = np.random.default_rng(0)
    words = [f"w{min(i, 30)}" for i in rng.geometric(0.12, 900)]
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 != 2][:18]
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    texts = {i: " ".join(words[50 * k : 50 * k + 50]) for k, i in enumerate(ids)} | {i: " ".join(words[7 * k : 7 * k + 60 : 2]) + " Neu" for k, i in enumerate(held)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    chains = {i: list(zip(["<", *t.lower().split()], [*t.lower().split(), ">"])) for i, t in texts.items()}
    pairs = Counter(x for i in ids for x in chains[i])
    discount = pitman_yor.discount_of(sum(n == 1 for n in pairs.values()), sum(n == 2 for n in pairs.values()))
    heads = Counter(w for _, w in pairs)
    above = pitman_yor.discount_of(sum(n == 1 for n in heads.values()), sum(n == 2 for n in heads.values()))
    plain = _one_by_one([texts[i].lower().split() for i in ids], 1 / (len(heads) + 1), discount, above)
    known = {u for u, _ in plain}
    expected = {i: sum(math.log10(plain[u if u in known else "?", w if (u, w) in plain or w in heads else "?"]) for u, w in c) for i, c in chains.items()}
    for bucket in (2_000_000, 60):  # and with many blocks, buckets and spread contexts
        monkeypatch.setattr(pitman_yor, "PAIR_BUCKET", bucket)
        monkeypatch.setattr(pitman_yor, "WORD_BUCKET", bucket)
        monkeypatch.setattr(pitman_yor, "BLOCK_TOKENS", bucket)
        found = {r.doc_id: r.score for r in pitman_yor.score(df).collect()}
        assert found == {i: pytest.approx(x, rel=0.02) for i, x in expected.items()}


def _log_stirling(discount, most):
    """log S(c, t) by the recursion S(c + 1, t) = S(c, t - 1) + (c - d t) S(c, t), for c up to ``most``."""
    row, rows = np.full(most + 2, -np.inf), {}
    row[1] = 0.0
    for c in range(1, most):
        t = np.arange(1, c + 2)
        row[1 : c + 2] = np.logaddexp(row[: c + 1], np.log(np.maximum(c - discount * t, 1e-300)) + row[1 : c + 2])
        rows[c + 1] = row[1 : c + 2].copy()
    return rows


@pytest.mark.parametrize("discount", [0.05, 0.3, 0.5, 0.62, 0.8])
def test_stirling_numbers_of_many_customers(discount):
    rows = _log_stirling(discount, 1500)
    s = seating.Stirling(discount)
    for c in (129, 400, 1500):
        t = np.arange(1, c + 1)
        off = s.of_many(np.full(c, c), t) - rows[c]
        assert np.abs(off).max() < 0.06 and np.abs(off[:4]).max() < 1e-6
    assert np.allclose(s.table[seating.EXACT, 1:], rows[seating.EXACT])


def test_seating_has_the_exact_distribution():
    d, first, step = 0.6, 0.8, 0.05
    rows = _log_stirling(d, 600)
    for c, copies, sweeps in ((2, 4000, 1), (3, 4000, 1), (40, 3000, 1), (128, 2000, 1), (600, 1500, 40)):
        s = seating.Seating(np.full(copies, c), d, np.random.default_rng(c))
        for _ in range(sweeps):
            s.sweep(np.full(copies, first), np.full(copies, step))
        weight = rows[c] + np.log(first + step * np.arange(c)).cumsum()
        chance = np.exp(weight - weight.max()) / np.exp(weight - weight.max()).sum()
        mean = (chance * np.arange(1, c + 1)).sum()
        spread = math.sqrt((chance * (np.arange(1, c + 1) - mean) ** 2).sum())
        assert s.tables.mean() == pytest.approx(mean, abs=5 * spread / math.sqrt(copies))
        assert s.tables.std() == pytest.approx(spread, rel=0.1) and 1 <= s.tables.min() and s.tables.max() <= c
    # a seating is carried on; a constant weight of new tables, and dishes of none, one and very many customers
    s = seating.Seating(np.array([0, 1, 10**9]), d, np.random.default_rng(3), np.array([0, 1, 1000]))
    for _ in range(200):
        s.sweep(np.full(3, 0.01), np.zeros(3))
    assert s.tables[:2].tolist() == [0, 1] and 1 <= s.tables[2] < 10**6


def test_blocks_hold_the_tokens_of_their_texts():
    texts = ["", None, "  a B\tc ", "\x0b x\x0c y\n\n", "Ä ä\x85z \x1c q\x1dr", " a b" * 50, "a"]
    codes, lengths, words = pitman_yor._encoded(pa.array(texts))
    flat = iter(words[k] for k in codes)
    assert [[next(flat) for _ in range(n)] for n in lengths] == [pitman_yor.tokens(t) for t in texts]
    rows = pa.record_batch({"doc_id": list(range(7)), "held": [False] * 7, "text": texts})
    for most in (1, 30, 10_000):
        runs = list(pitman_yor._runs(iter([rows.slice(0, 3), rows.slice(3)]), most))
        assert [x for r in runs for x in r.column(0).to_pylist()] == list(range(7)) and all(r.num_rows for r in runs)
    assert len(runs) == 1


def test_mixing_on_odd_tables(odd, empty):
    found = mixing.mix_digest(odd).collect()
    assert len(found) == len(ODD) and all(r.taken <= 3 * r.size for r in found)
    assert mixing.mix_rows(odd).columns == odd.columns and mixing.mix_digest(empty).count() == 0 and mixing.mix_rows(empty).count() == 0


def test_toxicity(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    held = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    found = {r.doc_id: r.score >= toxicity.THRESHOLD for r in toxicity.score(docs, model).collect()}
    right = [found[i] == bool(t) for i, t in held.items()]
    caught = [found[i] for i, t in held.items() if t]
    assert np.mean(right) > 0.95 and np.mean(caught) > 0.85
    assert toxicity.score(odd, model).count() == len(ODD) and toxicity.without_toxic(odd, model).columns == odd.columns
    none = toxicity.train(odd, labels.where("doc_id < 0"))
    assert {r.score < 0.3 for r in toxicity.score(odd, none).collect()} == {True} and toxicity.score(empty, none).count() == 0


def test_toxicity_of_misspelled_and_quoted_terms(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    held = docs.join(labels.select("doc_id", "toxic"), "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2").select("text", "toxic").collect()
    one, features, rng = model.scorer(), toxicity.Features(toxicity.Automaton(model.entries), model.known), random.Random(5)
    misspelled = [x for r in held if r.toxic for x, _, weight in toxicity.examples(r.text, True, features, rng) if weight < 1]
    quoted = [f'{r.text} he said "{rng.choice(model.entries)[0]}" then' for r in held if not r.toxic]
    assert len(misspelled) > 50 and np.mean([one(x) >= toxicity.THRESHOLD for x in misspelled]) > 0.9
    assert len(quoted) > 500 and np.mean([one(x) >= toxicity.THRESHOLD for x in quoted]) < 0.05
    assert one("you are an idixt") >= toxicity.THRESHOLD > one('he said "idiot" to her')


def test_toxicity_drops_copies_alone(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 60, 80)) for _ in range(200)]
    copies = [texts[0], texts[1].upper(), texts[2] + " more"]
    df = spark.createDataFrame([(i, t, i % 2 == 1) for i, t in enumerate(texts)] + [(1000 + i, t, i % 2 == 1) for i, t in enumerate(copies)], "doc_id long, text string, toxic boolean")
    assert sorted(r.doc_id for r in toxicity.without_copies(df).collect()) == list(range(200))


def test_automaton_is_edit_distance():
    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            d, last = [i] + [0] * len(b), d
            for j, y in enumerate(b, 1):
                d[j] = min(last[j] + 1, d[j - 1] + 1, last[j - 1] + (x != y))
        return d[-1]

    rng, words = np.random.default_rng(3), ["abcabcabca", "bacab", "abba", "ccabbaccab"]
    a = toxicity.Automaton([(w, False, 1.0) for w in words])
    for _ in range(3000):
        token = "".join(rng.choice(list("abc"), rng.integers(1, 13)))
        best = min((distance(token, w) for w in words if distance(token, w) <= toxicity.edits_for(w, False)), default=None)
        assert (m[0] if (m := a.match(token)) else None) == best


def test_elias_fano():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 255, 256, 257, 3000):
        v = np.sort(rng.integers(0, 10 ** rng.integers(1, 12), n))
        e = tokens.EliasFano.from_bytes(tokens.EliasFano.encode(v).to_bytes())
        assert e.decode().tolist() == v.tolist() and [e.select(i) for i in range(n)] == v.tolist()


def test_token_files(spark, docs, odd, empty, tmp_path):
    from tokenizers import Tokenizer

    tokenizer, start, expected = Tokenizer.from_file(TOKENIZER), 0, []
    extra = spark.createDataFrame([(-5, "A\x1fb <|endoftext|> Ünï x don't 3.14"), (-4, None)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(extra)
    for r in both.orderBy("doc_id").collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]
        expected.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    shards = tokens.write_tokens(both, TOKENIZER, f"file://{tmp_path}/shards")
    assert sorted(map(tuple, tokens.read_digest(shards).collect())) == expected
    shard = tokens.TokenShard(shards.first().path)
    assert [len(shard.ids(i)) for i in range(shard.n_docs)] == [len(x) for _, _, x in shard.documents(chunk=10)]
    assert tokens.read_digest(tokens.write_tokens(odd, TOKENIZER)).count() == len(ODD) and tokens.read_digest(tokens.write_tokens(empty, TOKENIZER)).count() == 0


def test_stops_after_letters_that_become_marks():
    encoder = tokens._Encoder(TOKENIZER)
    letters = [c for c in map(chr, range(0x110000)) if c.isalpha()]
    for text in ["TAKSİ.", "DENİZLİ, TAKSİ.", "\u0958.", "İ,", "été. İs,", *(f"a{c}. {c}," for c in letters)]:
        assert encoder.encode(text) == encoder._ids(text), ascii(text)


def test_parts_of_latin_pieces_need_no_whole_encoding(monkeypatch):
    whole, encoder = tokens._Encoder(TOKENIZER), tokens._Encoder(TOKENIZER)
    monkeypatch.setattr(encoder, "_ids", lambda piece: pytest.fail(f"{piece!r} was encoded as a text"))
    rng = random.Random(3)
    signs = [c for c in map(chr, range(33, 256)) if not c.isspace()] + ["'s", "'LL", "'d"] * 6
    pieces = [p for c in signs for p in (c, "a" + c, c + "a", c + c, c + "'s")] + ["".join(rng.choices(signs, k=rng.randint(1, 8))) for _ in range(3000)]
    for p in pieces:
        assert "<|" in p or encoder[p] == whole._ids(p), p


def test_ids_are_those_of_the_tokenizer():
    """Random texts over all kinds of letters, for a tokenizer that splits at spaces and for one that does not."""
    import public_tokenizers

    rng = random.Random(5)
    letters = "aZé\u0130\u0958\u0301ßΣ7३ .,'’-\t\n\u00a0\u2028中🙂<|>"
    for name, by_piece in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        encoder = tokens._Encoder(public_tokenizers.path(name))
        assert encoder.by_piece == by_piece
        for _ in range(5_000):
            text = "".join(rng.choices(letters, k=rng.randrange(12)))
            assert encoder.encode(text) == encoder._ids(text), ascii(text)


def test_top_k_on_odd_tables(spark):
    v = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("inf"), 1.0]), (5, [1.0, 2.0, 3.0]), (100, [-1.0, 0.5]), (100, [-1.0, 0.5]), (7, []), (8, [1.0, 2.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    found = [tuple(r) for r in topk.top_k(df, "vec_id", "embedding", k=3).orderBy("query_id", "rank").collect()]
    one = 1024 * 1024
    own = 1024**2 + 512**2  # of the two rows with id 100, each is the other's nearest
    one_hundred = [(100, 1, 100, own), (100, 2, 0, 0), (100, 3, 1, 0)]
    assert found == sorted([(0, 1, 1, 5 * one), (0, 2, 8, 5 * one), (0, 3, 100, 0), *one_hundred, *one_hundred])
    assert topk.top_k(df.where("vec_id < 0"), "vec_id", "embedding").count() == 0


def test_top_k_of_large_components_and_null_ids(spark):
    big = [(0, [1e10, -1e10]), (1, [1e10, 3.0]), (2, [-1e10, 1e10]), (3, [2.0, 1.0]), (None, [2.0, 1.0]), (4, [1e300, 0.0])]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    most = 2**63 - 1
    exact = 1024 * 1024 * 10**10
    found = [tuple(r)[1:] for r in topk.top_k(df, "vec_id", "embedding").orderBy("rank").collect()]
    assert found == [(1, 1, most), (2, 4, most), (3, None, exact), (4, 3, exact), (5, 2, -most)]
    small = df.where("embedding[0] < 1e9").union(spark.createDataFrame([(100, [1.0, 1.0])], "vec_id long, embedding array<double>"))
    sql = duck(ORACLE_SQL["op9_top_k"], {"embeddings": small.toPandas()})
    assert rows(topk.top_k(small, "vec_id", "embedding").toPandas()) == rows(sql)


def test_top_k_of_scores_near_the_limit_and_ids_beside_nulls(spark):
    """Scores up to 2**63 - 1 differ by one where they should, and large ids stay whole beside null ones."""
    a, b = 2**21, 2**21 + 1  # times 1024: 2**31 and a little more
    big = 2**60 + 1
    v = [(0, [float(a), 0.0]), (big, [float(a), 1.0]), (None, [float(a), 1.0]), (big + 2, [float(b), 0.0]), (5, [float(a) - 0.5 / 512, 0.0]), (6, [-float(a), 0.0]), (-(2**62), [float(a), 0.0])]
    found = topk.top_k(spark.createDataFrame(v, "vec_id long, embedding array<double>").coalesce(1), "vec_id", "embedding").orderBy("rank").collect()
    ints = [[int(x * 1024 // 1) for x in e] for _, e in v]
    score = [sum(x * y for x, y in zip(ints[0], e)) for e in ints]
    order = sorted(range(1, len(v)), key=lambda i: (-score[i], v[i][0] is not None, v[i][0] or 0))
    assert [(r.vec_id, r.score) for r in found] == [(v[i][0], score[i]) for i in order]
    assert max(score) > 2**62 and len(set(score)) >= 4


def test_top_k_by_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 2)
    rng = np.random.default_rng(2)
    m = rng.integers(-3, 4, (700, 3)).astype(float)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "vec_id long, embedding array<double>")
    s = (1024 * m).astype(int) @ (1024 * m).astype(int).T
    expected = [(q, r + 1, i, int(s[q, i])) for q in range(0, 700, 100) for r, i in enumerate(sorted((i for i in range(700) if i != q), key=lambda i: (-s[q, i], i))[:10])]
    assert sorted(map(tuple, topk.top_k(df, "vec_id", "embedding").collect())) == expected


def test_secret_scan(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = secrets.labelled_by_rule(secrets.candidates(docs)).persist()
    seen, held = found.where("doc_id % 4 <> 1"), found.where("doc_id % 4 = 1")
    forest = secrets.train(seen)
    p = forest.score(held).toPandas()
    assert len(p) > 100 and ((p.score >= secrets.THRESHOLD) == (p.label == 1)).mean() > 0.97
    scanned = secrets.scan(odd, forest).collect()
    assert [(r.doc_id, r.length, r.is_secret) for r in scanned if r.doc_id == 5] == [(5, 16, True)]
    assert secrets.scan(empty).count() == 0


def test_secret_scan_sees_every_run_of_a_token(spark):
    key, other = "wJalr7UtnFEMIK7MDENGbPxRfiCY", "ab12cd34ef56ab78"
    texts = [f"x access_token={other} y", f"AWS_SECRET_ACCESS_KEY={key}", f"clientSecret:{other}", f'{{"access_token":"{other}","plain":"{key}","client_secret":"{key}"}}', f"https://a.b/?page_of_results=abcdefghijkl&order_number={other}"]
    df = spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    found = secrets.labelled_by_rule(secrets.candidates(df)).collect()
    assert sorted((r.doc_id, r.value, r.label) for r in found) == sorted([(0, other, 1), (1, key, 1), (2, other, 1), (3, other, 1), (3, key, 0), (3, key, 1), (4, other, 0)])
    assert [(r.before, r.after) for r in found if r.doc_id == 0] == [("x access_token=", "y")]


def test_secret_scan_learns_from_rare_secrets(spark):
    hashed = [hashlib.md5(str(i).encode()).hexdigest() for i in range(6000)]
    texts = [f"commit sha {h} merged" for h in hashed[:5990]] + [f"now password={h[:20]} set" for h in hashed[5990:]]
    df = spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    found = secrets.labelled_by_rule(secrets.candidates(df))
    forest = secrets.train(found, max_train=100)
    assert forest.model is not None
    assert {(r.label, r.score >= secrets.THRESHOLD) for r in forest.score(found).collect()} == {(0, False), (1, True)}


def test_secret_candidates_are_those_of_a_plain_scan(spark, docs):
    extra = [(-1, 'a="Zm9vYmFyYmF6cXV4Mg==";b=abcdefghijkl;c=ABCDEFGHIJKL', None, "p", None), (-2, "  x\tlong_name_1234567890/then:value-0123456789ab  ", None, None, None), (-3, None, None, None, None)]
    every = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long"))
    expected = []
    for r in every.collect():
        tokens_ = re.split(r"[\x20\x09-\x0D]+", (r.text or "").strip(" \t\n\x0b\x0c\r"))
        for i, token in enumerate(tokens_):
            expected += [(r.doc_id, r.source, i, run) for run in re.findall(r"[A-Za-z0-9+/_-]{12,}", token) if re.search(r"[0-9]|[A-Z]{12}", run)]
    found = [(r.doc_id, r.path, r.word, r.value) for r in secrets.candidates(every).collect()]
    assert len(found) > 10 and sorted(found, key=repr) == sorted(expected, key=repr)


def test_secret_forest_on_planted_findings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = secrets.labelled_by_rule(secrets.candidates(docs)).persist()
    forest = secrets.train(found.where("doc_id % 4 <> 1"))
    held = forest.score(secrets.nameless(found.where("doc_id % 4 = 1"))).toPandas()  # the cue that gave the label is hidden
    assert ((held.score >= secrets.THRESHOLD) == (held.label == 1)).mean() > 0.9
    rng = random.Random(2)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    harmless = [f"see commit {some('0123456789abcdef', 40)} for more" for _ in range(50)] + [f"invoice {some('0123456789', 13)} was sent" for _ in range(50)]
    secret = [f"then api_key={some(alnum, 32)} was set" for _ in range(50)] + [f"password: {some(alnum, 20)}" for _ in range(50)]
    df = spark.createDataFrame([(i, t, "web") for i, t in enumerate(harmless + secret)], "doc_id long, text string, source string")
    marked = {r.doc_id for r in secrets.scan(df, forest).where("is_secret").collect()}
    assert len([i for i in marked if i < 100]) <= 5 and len([i for i in marked if i >= 100]) >= 90


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, docs = docs, corpus_pipeline.written(stage(spark, docs, "/root/testdata/sf0.01"), name)
        assert docs.columns == before.columns and docs.exceptAll(before).count() == 0
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.6 * sizes[0]
    assert len(set(r.class_id for r in ngram_join.jaccard_classes(docs).collect())) == docs.count()
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    assert mixed.columns == docs.columns
    assert corpus_pipeline.write_token_files(spark, mixed, "").count() == mixed.count()
