"""Attacks against plain Python on tables with nulls, ties and other layouts."""

import random

import pytest
from conftest import duck
from pyspark.sql import functions as F

from twinloom.operators import privacy
from twinloom.operators.profile import profile

COLS = ["x", "grade", "kind", "y"]
SCHEMA = "id string, x double, grade int, kind string, y double"


def _table(n, seed):
    r = random.Random(seed)
    hole = lambda v: None if r.random() < 0.1 else v
    return [(f"r{i:04d}", hole(r.randint(0, 20) / 4), hole(r.randint(1, 3)), hole(r.choice("abc")), hole(r.gauss(0, 1))) for i in range(n)]


@pytest.fixture(scope="module")
def tables(spark):
    real, twin = _table(300, 1), _table(900, 2)
    a, b = spark.createDataFrame(real, SCHEMA).repartition(3), spark.createDataFrame(twin, SCHEMA).repartition(7)
    return real, twin, a, b, profile(a, COLS)


def _distance(specs, columns, a, t):
    total = 0.0
    for s in specs:
        if s.name in columns:
            i = 1 + COLS.index(s.name)
            if a[i] is None or t[i] is None:
                total += float(a[i] is not t[i])
            else:
                total += abs(a[i] - t[i]) / (s.high - s.low) if s.kind == "continuous" else float(a[i] != t[i])
    return round(total, 9)


def _near(specs, columns, a, twin, k):
    return sorted((_distance(specs, columns, a, t), t[0]) for t in twin)[:k]


@pytest.mark.parametrize("k", [1, 3, 12, 2000])
def test_nearest(tables, k):
    real, twin, a, b, specs = tables
    found = {}
    for r in privacy.nearest(a.where("id < 'r0020'"), b, specs, "id", COLS, k).orderBy("a_id", "rank").collect():
        found.setdefault(r.a_id, []).append((pytest.approx(r.dist, abs=2e-9), r.t_id))
    expected = {x[0]: _near(specs, COLS, x, twin, k) for x in real[:20]}
    assert {i: [t for _, t in f] for i, f in found.items()} == {i: [t for _, t in e] for i, e in expected.items()}
    assert all(e == f for i in expected for e, f in zip([d for d, _ in expected[i]], [d for d, _ in found[i]]))


def test_samples_are_the_smallest_hashes(tables):
    _, _, a, _, _ = tables
    for n in (0, 5, 250, 400):
        both = privacy.attack_samples(a, "id", n, 4, ["one", "two"])
        assert [[r.id for r in rows] for rows in both] == [[r.id for r in privacy.attack_sample(a, "id", n, 4, s).collect()] for s in ("one", "two")]
    with pytest.raises(ValueError):
        privacy.attack_samples(a, "id", privacy.MAX_ATTACKS + 1, 4, ["one"])


def test_inference_of_all_replicates(tables):
    real, twin, a, b, specs = tables
    known, at = {s.name: s for s in specs}, {r[0]: r for r in twin}
    secrets = {0: ["x", "kind"], 1: ["grade"], 4: COLS}
    expected = []
    for rep, names in secrets.items():
        sample = {r.id for r in privacy.attack_sample(a, "id", 40, 6, f"infer:{rep}").collect()}
        for s in names:
            i, hits = 1 + COLS.index(s), 0
            for x in real:
                if x[0] in sample:
                    guess, truth = at[_near(specs, [c for c in COLS if c != s], x, twin, 1)[0][1]][i], x[i]
                    if guess is None or truth is None:
                        hits += guess is truth
                    else:
                        hits += abs(guess - truth) <= 0.05 * abs(truth) if known[s].kind == "continuous" else guess == truth
            expected.append((rep, s, hits, 40))
    assert sorted(map(tuple, privacy.inference(a, b, specs, "id", COLS, secrets, 40, 6).collect())) == sorted(expected)


def test_inference_reads_the_twin_once(tables):
    """One place in the plan takes the twin's rows, whatever the number of replicates and secrets."""
    _, _, a, b, specs = tables
    plan = privacy.inference(a, b, specs, "id", COLS, dict.fromkeys(range(10), COLS), 20, 6)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Cartesian" not in plan and "Join Cross" not in plan


def test_links(tables):
    real, twin, a, b, specs = tables
    sample = {r.id for r in privacy.attack_sample(a, "id", 60, 6, "link").collect()}
    for k in (1, 4):
        near = lambda x, columns: {t for _, t in _near(specs, columns, x, twin, k)}  # noqa: B023, E731
        expected = {x[0]: int(bool(near(x, COLS[:2]) & near(x, COLS[1:]))) for x in real if x[0] in sample}
        found = privacy.linkability(a, b, specs, "id", COLS[:2], COLS[1:], 60, k, 6)
        assert {r.a_id: r.hit for r in found.collect()} == expected


def test_matches_and_saturation(tables):
    real, twin, a, b, specs = tables
    middle = privacy.medians(a, specs, COLS)
    kinds = {s.name: s.kind for s in specs}

    def meets(p, r, columns):
        for c in columns:
            i = 1 + COLS.index(c)
            if p[i] is None or r[i] is None:
                return False
            if not (p[i] == r[i] if kinds[c] == "categorical" else r[i] >= p[i] if p[i] >= middle[c] else r[i] <= p[i]):
                return False
        return True

    sample = {r.id for r in privacy.attack_sample(b, "id", 200, 6, "single").collect()}
    for columns in (COLS, ["y"], ["kind"], ["grade", "x"]):
        expected = {p[0]: sum(meets(p, r, columns) for r in real) for p in twin if p[0] in sample}
        found = privacy.singling_out(a, b, specs, "id", columns, middle, 200, 6)
        assert {r.p_id: r.matches for r in found.collect()} == expected
        capped = privacy.singling_out(a, b, specs, "id", columns, middle, 200, 6, most=2)
        assert {r.p_id: r.matches for r in capped.collect()} == {i: min(n, 2) for i, n in expected.items()}


def test_empty_sides(tables):
    _, _, a, b, specs = tables
    none, some = b.where("false"), a.limit(5)
    assert privacy.nearest(some, none, specs, "id", COLS).count() == 0 and privacy.nearest(none, b, specs, "id", COLS).count() == 0
    assert [(r.hits, r.n) for r in privacy.inference(some, none, specs, "id", COLS, {0: ["x"]}, 5, 1).collect()] == [(None, 0)]
    assert privacy.linkability(some, none, specs, "id", ["x"], ["y"], 5, 1, 1).agg(F.sum("hit")).first()[0] == 0
    assert privacy.singling_out(none, some, specs, "id", ["x"], {"x": 1.0}, 5, 1).agg(F.sum("matches")).first()[0] == 0


def test_drawn_columns_are_those_of_sql():
    names = [f"column_{i}" for i in range(25)]
    for salt, n in (("aux", 6), ("single", 19), *((f"secret:{i}", 5) for i in range(10))):
        found = duck(f"SELECT unnest({names!r}) AS name ORDER BY md5(concat_ws('|', '42', '{salt}', name)) LIMIT {n}", {})
        assert privacy.draw(names, n, 42, salt) == found.name.tolist()
