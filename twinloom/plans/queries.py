"""Queries over the test tables, one an operator, and the same in SQL.

Where an operator needs a twin, a simple deterministic one is used that SQL can
make too: customers with shifted balances and some redrawn nations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom.functions.permutation import permutation_sql, round_keys
from twinloom.functions.rng import cdf_sql, hash_normal, hash_uniform, normal_quantile, normal_sql, quantile_sql, uniform_sql
from twinloom.functions.surrogate import surrogate_sql
from twinloom.operators import fidelity, privacy
from twinloom.operators.baseline import shuffle_columns
from twinloom.operators.evaluate import evaluate
from twinloom.operators.fidelity import rounded
from twinloom.operators.generate import KNOTS, at_quantile, category_at, cutpoints, fit, generate, mixed, quantile_knots, retained
from twinloom.operators.latent import contingency
from twinloom.operators.model import USED, twin_of, word_sql
from twinloom.operators.profile import ColumnSpec, profile, profile_table
from twinloom.operators.ranking import ranked
from twinloom.sources.io import read_model, write_model
from twinloom.storage import new_path, written

SEED = 42
KEY = "c_custkey"
COLS = ["c_nationkey", "c_acctbal", "c_mktsegment"]
NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
N_ATTACKS = 100


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _customer(spark, d):
    return _read(spark, d, "customer").select(KEY, *COLS)


def _twin(spark, d) -> DataFrame:
    u = lambda salt: hash_uniform(SEED, salt, F.col(KEY))
    return _customer(spark, d).select(
        KEY,
        F.when(u("pick") < 0.2, F.floor(u("nation") * 25)).otherwise(F.col("c_nationkey")).cast("int").alias("c_nationkey"),
        F.round(F.col("c_acctbal") + 2000 * (u("shift") - 0.5), 2).alias("c_acctbal"),
        "c_mktsegment",
    )


_U = lambda salt, key=KEY: uniform_sql(SEED, salt, key)
TWIN_SQL = f"""real AS (SELECT {KEY}, {', '.join(COLS)} FROM customer),
twin AS (SELECT {KEY}, (CASE WHEN {_U('pick')} < 0.2 THEN floor({_U('nation')} * 25) ELSE c_nationkey END)::INT AS c_nationkey,
  round(c_acctbal + 2000 * ({_U('shift')} - 0.5), 2) AS c_acctbal, c_mktsegment FROM customer)"""


def _shuffled_sql(table: str, key: str, columns: list[str], source: str) -> str:
    """Each value goes to the permuted rank of its row."""
    parts = [f"{table}_k AS (SELECT {key}, {', '.join(columns)}, row_number() OVER (ORDER BY {key}) - 1 AS r FROM {source})"]
    for c in columns:
        parts.append(permutation_sql(f"{table}_p_{c}", round_keys(SEED, f"shuffle:{c}"), f"{table}_k", f"(SELECT count(*) FROM {source})"))
        parts.append(f"{table}_{c} AS (SELECT y AS r, {c} FROM {table}_k JOIN {table}_p_{c} USING (r))")
    joins = " ".join(f"JOIN {table}_{c} USING (r)" for c in columns)
    return ", ".join(parts) + f", {table} AS (SELECT {key}, {', '.join(f'{table}_{c}.{c}' for c in columns)} FROM {table}_k {joins})"


SHUFFLED_SQL = _shuffled_sql("shuffled", KEY, COLS, "customer")


def _specs(spark, d) -> list[ColumnSpec]:
    return profile(_customer(spark, d), COLS)


RANGE_SQL = "rng AS (SELECT max(c_nationkey) - min(c_nationkey) AS wn, max(c_acctbal) - min(c_acctbal) AS wa FROM customer)"
_DIST = {
    "c_nationkey": "abs(a.c_nationkey::DOUBLE - t.c_nationkey::DOUBLE) / wn::DOUBLE",
    "c_acctbal": "abs(a.c_acctbal - t.c_acctbal) / wa",
    "c_mktsegment": "(a.c_mktsegment <> t.c_mktsegment)::INT::DOUBLE",
}


def _sample_sql(name: str, source: str, salt: str, n: int = N_ATTACKS) -> str:
    return f"{name} AS (SELECT * FROM {source} ORDER BY {_U(salt)}, {KEY} LIMIT {n})"


def _near_sql(name: str, attacks: str, twin: str, columns: list[str], k: int) -> str:
    dist = " + ".join(["0.0::DOUBLE", *[_DIST[c] for c in columns]])
    return f"""{name} AS (SELECT * FROM (SELECT a.{KEY} AS a_{KEY}, t.{KEY} AS t_{KEY}, round({dist}, 9) AS dist, {', '.join(f't.{c} AS t_{c}' for c in COLS)}, {', '.join(f'a.{c} AS a_{c}' for c in COLS)},
  row_number() OVER (PARTITION BY a.{KEY} ORDER BY round({dist}, 9), t.{KEY}) AS rank FROM {attacks} a, {twin} t, rng) WHERE rank <= {k})"""


def _single_sql(name: str, twin: str, columns: list[str]) -> str:
    tests = {
        "c_nationkey": "CASE WHEN p.c_nationkey >= mn THEN r.c_nationkey >= p.c_nationkey ELSE r.c_nationkey <= p.c_nationkey END",
        "c_acctbal": "CASE WHEN p.c_acctbal >= ma THEN r.c_acctbal >= p.c_acctbal ELSE r.c_acctbal <= p.c_acctbal END",
        "c_mktsegment": "r.c_mktsegment = p.c_mktsegment",
    }
    meets = " AND ".join(tests[c] for c in columns)
    return f"""{name}_p AS (SELECT * FROM {twin} ORDER BY {_U('single')}, {KEY} LIMIT {N_ATTACKS}),
{name} AS (SELECT p.{KEY} AS p_{KEY}, count(r.{KEY}) AS matches FROM {name}_p p CROSS JOIN med LEFT JOIN real r ON {meets} GROUP BY p.{KEY})"""


MEDIAN_SQL = "med AS (SELECT quantile_disc(c_nationkey, 0.5) AS mn, quantile_disc(c_acctbal, 0.5) AS ma FROM customer)"
PART_A, PART_B = ["c_nationkey", "c_mktsegment"], ["c_acctbal"]
SECRETS = {s: [c for c in COLS if c != s] for s in COLS}
_RIGHT = {
    "c_nationkey": "abs(t_c_nationkey - a_c_nationkey) <= 0.05::DOUBLE * abs(a_c_nationkey)",
    "c_acctbal": "abs(t_c_acctbal - a_c_acctbal) <= 0.05::DOUBLE * abs(a_c_acctbal)",
    "c_mktsegment": "t_c_mktsegment = a_c_mktsegment",
}


def _rates_sql(twin: str) -> str:
    near = [_near_sql(f"{twin}_a", "link", twin, PART_A, 1), _near_sql(f"{twin}_b", "link", twin, PART_B, 1)]
    near += [_near_sql(f"{twin}_i{i}", "infer", twin, rest, 1) for i, rest in enumerate(SECRETS.values())]
    infer = " UNION ALL ".join(f"SELECT avg(({_RIGHT[s]})::INT) AS x FROM {twin}_i{i}" for i, s in enumerate(SECRETS))
    return f"""{_single_sql(twin + '_s', twin, COLS)}, {', '.join(near)},
{twin}_rates AS (SELECT
  (SELECT avg((matches = 1)::INT) FROM {twin}_s) AS singling_out,
  (SELECT count(*) / {N_ATTACKS}.0::DOUBLE FROM {twin}_a a JOIN {twin}_b b ON a.a_{KEY} = b.a_{KEY} AND a.t_{KEY} = b.t_{KEY}) AS linkability,
  (SELECT avg(x) FROM ({infer})) AS inference)"""


ATTACKS_SQL = f"{TWIN_SQL}, {SHUFFLED_SQL}, {RANGE_SQL}, {MEDIAN_SQL}, {_sample_sql('link', 'real', 'link')}, {_sample_sql('infer', 'real', 'infer:0')}, {_rates_sql('twin')}, {_rates_sql('shuffled')}"


def _rates(spark, d, *twins: DataFrame) -> list[DataFrame]:
    """One row a twin: the success rates of the three attacks."""
    real, specs, out = _customer(spark, d), _specs(spark, d), []
    middle = privacy.medians(real, specs, COLS)
    samples = privacy.real_samples(real, specs, KEY, COLS, N_ATTACKS, SEED, [0])
    for twin in twins:
        twin = written(twin, "twin")
        s = privacy.singling_out(real, twin, specs, KEY, COLS, middle, N_ATTACKS, SEED)
        link = privacy.linkability(real, twin, specs, KEY, PART_A, PART_B, N_ATTACKS, 1, SEED, samples)
        inf = privacy.inference(real, twin, specs, KEY, COLS, {0: COLS}, N_ATTACKS, SEED, samples)
        out.append(
            s.agg(F.avg((F.col("matches") == 1).cast("double")).alias("singling_out"))
            .crossJoin(link.agg(F.avg(F.col("hit").cast("double")).alias("linkability")))
            .crossJoin(inf.agg(F.avg(F.col("hits") / F.col("n")).alias("inference")))
        )
    return out


def _shuffled(spark, d):
    return shuffle_columns(_customer(spark, d), KEY, COLS, SEED)


Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _profile_sql(table: str, columns: dict[str, str]) -> str:
    """columns: name -> number, string"""
    parts = []
    for c, kind in columns.items():
        x = f"{c}::DOUBLE" if kind == "number" else "NULL::DOUBLE"
        ndv = f"count(DISTINCT {c})"
        if kind == "string":
            what = f"CASE WHEN {ndv} <= 50 THEN 'categorical' ELSE 'identifier' END"
        else:
            what = f"CASE WHEN {ndv} <= 10 AND coalesce(bool_and({c} = floor({c})), true) THEN 'categorical' ELSE 'continuous' END"
        parts.append(
            f"SELECT '{c}' AS column_name, {what} AS kind, count(*) AS n, count(*) - count({c}) AS nulls, CASE WHEN {ndv} <= 50 THEN {ndv} ELSE -1 END AS ndv, "
            f"min({x}) AS low, max({x}) AS high, round(avg({x}), 4) AS mean, round(var_samp({x}), 2) AS variance FROM {table}"
        )
    return " UNION ALL ".join(parts)


_LINEITEM = {c: "number" for c in ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *NUMS]} | {"l_returnflag": "string", "l_linestatus": "string"}


@query("profile_columns", _profile_sql("lineitem", _LINEITEM))
def profile_columns(spark, d):
    return profile_table(_read(spark, d, "lineitem"), list(_LINEITEM)).fillna(-1, ["ndv"])


_CLASSIFY = {
    "part": {"p_partkey": "number", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "number", "p_retailprice": "number"},
    "labels": {"doc_id": "number", "quality": "number", "toxic": "number"},
    "customer": {"c_custkey": "number", "c_name": "string", "c_nationkey": "number", "c_acctbal": "number", "c_mktsegment": "string"},
}


@query("classify_columns", "SELECT column_name, kind FROM (" + " UNION ALL ".join(_profile_sql(t, c) for t, c in _CLASSIFY.items()) + ")")
def classify_columns(spark, d):
    rows = [(s.name, s.kind) for t, c in _CLASSIFY.items() for s in profile(_read(spark, d, t), list(c))]
    return spark.createDataFrame(rows, "column_name string, kind string")


@query("hash_uniform", f"SELECT event_id, {uniform_sql(SEED, 'u', 'event_id')} AS u FROM events")
def q_uniform(spark, d):
    return _read(spark, d, "events").select("event_id", hash_uniform(SEED, "u", F.col("event_id")).alias("u"))


@query("hash_normal", f"SELECT event_id, round({normal_sql(SEED, 'z', 'event_id')}, 9) AS z FROM events")
def q_normal(spark, d):
    return _read(spark, d, "events").select("event_id", rounded(hash_normal(SEED, "z", F.col("event_id")), 9).alias("z"))


_ROW = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query("row_id", f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (ORDER BY {', '.join(_ROW)}) - 1 AS rid FROM lineitem")
def row_id(spark, d):
    return ranked(_read(spark, d, "lineitem"), [F.col(c) for c in _ROW], "rid").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "rid")


@query("shuffle_column", "WITH RECURSIVE " + _shuffled_sql("s", "event_id", ["value"], "events") + " SELECT * FROM s")
def shuffle_column(spark, d):
    return shuffle_columns(_read(spark, d, "events"), "event_id", ["value"], SEED)


@query("shuffle_table", f"WITH RECURSIVE {SHUFFLED_SQL} SELECT * FROM shuffled")
def shuffle_table(spark, d):
    return _shuffled(spark, d)


_TWO = ["c_nationkey", "c_acctbal"]
_MOM = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, avg(r.{c}) AS m, var_samp(r.{c}) AS v, (SELECT avg({c}) FROM twin) AS tm, (SELECT var_samp({c}) FROM twin) AS tv FROM real r" for c in _TWO
)


@query("fidelity_mean", f"WITH {TWIN_SQL}, mom AS ({_MOM}) SELECT column_name, round(100 * greatest(0.0, 1 - abs(tm - m) / sqrt(v)), 6) AS score FROM mom")
def q_fid_mean(spark, d):
    return fidelity.fidelity_mean(_customer(spark, d), _twin(spark, d), _TWO).select("column_name", rounded("score").alias("score"))


@query("fidelity_variance", f"WITH {TWIN_SQL}, mom AS ({_MOM}) SELECT column_name, round(100 * least(v, tv) / greatest(v, tv), 6) AS score FROM mom")
def q_fid_var(spark, d):
    return fidelity.fidelity_variance(_customer(spark, d), _twin(spark, d), _TWO).select("column_name", rounded("score").alias("score"))


_PROD = [*NUMS, "prod"]
_PAIRS = [(a, b) for i, a in enumerate(_PROD) for b in _PROD[i + 1 :]]


def _lineitem_prod(spark, d):
    return _read(spark, d, "lineitem").select(*NUMS, (F.col("l_quantity") * F.col("l_extendedprice")).alias("prod"))


def _pairs_sql(f: str, name: str, digits: int) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round({f}({a}, {b}), {digits}) + 0.0 AS {name} FROM x" for a, b in _PAIRS)


_X = "WITH x AS (SELECT *, l_quantity * l_extendedprice AS prod FROM lineitem)"


@query("corr_matrix", f"{_X} {_pairs_sql('corr', 'corr', 6)}")
def corr_matrix(spark, d):
    return fidelity.pairwise(_lineitem_prod(spark, d), _PROD).select("a", "b", rounded("corr").alias("corr"))


@query("covar_matrix", f"{_X} {_pairs_sql('covar_samp', 'covar', 1)}")
def covar_matrix(spark, d):
    return fidelity.pairwise(_lineitem_prod(spark, d), _PROD, "covar").select("a", "b", rounded("covar", 1).alias("covar"))


_EV = "e AS (SELECT event_id, value AS v, value * value AS w, user_id AS u FROM events)"
_NOISY = f"t AS (SELECT event_id, v + 10 * ({uniform_sql(SEED, 'n', 'event_id')} - 0.5) AS v, w, u FROM e)"
_EVC = ["v", "w", "u"]


def _events(spark, d):
    return _read(spark, d, "events").select("event_id", F.col("value").alias("v"), (F.col("value") * F.col("value")).alias("w"), F.col("user_id").alias("u"))


def _noisy(spark, d):
    return _events(spark, d).withColumn("v", F.col("v") + 10 * (hash_uniform(SEED, "n", F.col("event_id")) - 0.5))


def _off(t: str) -> str:
    pairs = [("v", "w"), ("v", "u"), ("w", "u")]
    return "((" + " + ".join(f"abs((SELECT corr({a}, {b}) FROM e) - (SELECT corr({a}, {b}) FROM {t}))" for a, b in pairs) + ") / 3)"


@query("fidelity_correlation", f"WITH RECURSIVE {_EV}, {_NOISY}, {_shuffled_sql('s', 'event_id', _EVC, 'e')} SELECT round(100 * greatest(0.0, 1 - {_off('t')} / {_off('s')}), 6) AS score")
def q_fid_corr(spark, d):
    e = _events(spark, d)
    return fidelity.fidelity_correlation(e, _noisy(spark, d), shuffle_columns(e, "event_id", _EVC, SEED), _EVC).select(rounded("score").alias("score"))


def _ks_sql(column: str, real: str, twin: str) -> str:
    return f"""SELECT '{column}' AS column_name, max(abs(cr / nr::DOUBLE - ct / nt::DOUBLE)) AS ks FROM (
  SELECT sum(r) OVER (ORDER BY v) AS cr, sum(t) OVER (ORDER BY v) AS ct, sum(r) OVER () AS nr, sum(t) OVER () AS nt
  FROM (SELECT v, sum(r) AS r, sum(t) AS t FROM (SELECT {column}::DOUBLE AS v, 1 AS r, 0 AS t FROM {real} UNION ALL SELECT {column}::DOUBLE, 0, 1 FROM {twin}) WHERE v IS NOT NULL GROUP BY v))"""


@query("ks_column", f"WITH h AS (SELECT l_quantity FROM lineitem WHERE l_returnflag = 'A'), k AS ({_ks_sql('l_quantity', 'lineitem', 'h')}) SELECT column_name, round(ks, 9) AS ks FROM k")
def ks_column(spark, d):
    x = _read(spark, d, "lineitem")
    return fidelity.ks(x, x.where("l_returnflag = 'A'"), ["l_quantity"]).select("column_name", rounded("ks", 9).alias("ks"))


@query("fidelity_ks", f"WITH {TWIN_SQL}, k AS ({' UNION ALL '.join(_ks_sql(c, 'real', 'twin') for c in _TWO)}) SELECT column_name, round(100 * (1 - ks), 6) AS score FROM k")
def q_fid_ks(spark, d):
    return fidelity.fidelity_ks(_customer(spark, d), _twin(spark, d), _TWO).select("column_name", rounded("score").alias("score"))


@query("normal_scores", f"WITH r AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 0.5::DOUBLE) / (SELECT count(*) FROM orders) AS p FROM orders) SELECT o_orderkey, round({quantile_sql('p')}, 7) AS z FROM r")
def normal_scores(spark, d):
    orders = _read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    p = (F.col("r") + F.lit(0.5)) / F.lit(orders.count())
    x = ranked(orders, [F.col("o_totalprice"), F.col("o_orderkey")], "r").withColumn("p", p)
    return x.select("o_orderkey", rounded(normal_quantile(F.col("p")), 7).alias("z"))


_RHO = retained(0.75, 2)


@query("gaussian_mix_pass", f"SELECT event_id, round({_RHO!r}::DOUBLE * {normal_sql(SEED, 'x', 'event_id')} + {(1 - _RHO**2) ** 0.5!r}::DOUBLE * (0.6 * {normal_sql(SEED, 'e0', 'event_id')} + 0.8 * {normal_sql(SEED, 'e1', 'event_id')}), 8) AS z FROM events")
def gaussian_mix_pass(spark, d):
    key = F.col("event_id")
    noise = 0.6 * hash_normal(SEED, "e0", key) + 0.8 * hash_normal(SEED, "e1", key)
    return _read(spark, d, "events").select("event_id", rounded(mixed(hash_normal(SEED, "x", key), noise, 0.75, 2), 8).alias("z"))


_CUTS = "SELECT {c} AS value, count(*) AS n, sum(count(*)) OVER (ORDER BY {c}) AS through, sum(count(*)) OVER () AS total FROM {t} GROUP BY {c}"


@query("categorical_cutpoints", f"WITH c AS ({_CUTS.format(c='o_orderpriority', t='orders')}) SELECT value, (through - n)::DOUBLE / total AS low, through::DOUBLE / total AS high FROM c")
def categorical_cutpoints(spark, d):
    return spark.createDataFrame(cutpoints(_read(spark, d, "orders"), "o_orderpriority"), "value string, low double, high double")


@query("categorical_decode", f"WITH c AS ({_CUTS.format(c='o_orderstatus', t='orders')}), u AS (SELECT o_orderkey, {uniform_sql(SEED, 'd', 'o_orderkey')} AS u FROM orders) SELECT o_orderkey, value AS status FROM u JOIN c ON u >= (through - n)::DOUBLE / total AND u < through::DOUBLE / total")
def categorical_decode(spark, d):
    orders = _read(spark, d, "orders")
    cuts = cutpoints(orders, "o_orderstatus")
    return orders.select("o_orderkey", category_at(hash_uniform(SEED, "d", F.col("o_orderkey")), cuts).alias("status"))


_KN = 4
_KNOT_SQL = f"knots AS (SELECT [{', '.join(f'(quantile_disc(o_totalprice, {i / _KN}) + quantile_disc(o_totalprice, {(i + 1) / _KN})) / 2' for i in range(_KN))}] AS k FROM orders)"


def _knots(spark, d) -> list[float]:
    return quantile_knots(_read(spark, d, "orders"), {"x": F.col("o_totalprice")}, _KN)["x"]


@query("quantile_knots", f"WITH {_KNOT_SQL} SELECT i::INT AS i, round(k[i + 1], 6) AS knot FROM knots, range({_KN}) r(i)")
def q_knots(spark, d):
    return spark.createDataFrame([(i, round(x, 6)) for i, x in enumerate(_knots(spark, d))], "i int, knot double")


@query(
    "continuous_decode",
    f"WITH {_KNOT_SQL}, u AS (SELECT o_orderkey, {uniform_sql(SEED, 'c', 'o_orderkey')} * {_KN - 1} AS p FROM orders), v AS (SELECT *, least(floor(p), {_KN - 2})::INT AS i FROM u) "
    "SELECT o_orderkey, round(k[i + 1] + (p - i) * (k[i + 2] - k[i + 1]), 4) AS price FROM v, knots",
)
def continuous_decode(spark, d):
    return _read(spark, d, "orders").select("o_orderkey", rounded(at_quantile(hash_uniform(SEED, "c", F.col("o_orderkey")), _knots(spark, d)), 4).alias("price"))


_NUMBERS = ["c_nationkey", "c_acctbal"]


def _word(score: int, use: int) -> str:
    return word_sql(SEED, KEY, USED * score + use)


def _quantiles_sql(c: str) -> str:
    """Exact quantiles and the knots between them."""
    at = f"greatest(1, (i * (SELECT count(*) FROM customer) + {KNOTS - 1}) // {KNOTS})"
    return f"""q_{c} AS (SELECT list(v ORDER BY i) AS q FROM range({KNOTS + 1}) t(i) JOIN (SELECT {c}::DOUBLE AS v, row_number() OVER (ORDER BY {c}) AS r FROM customer) ON r = {at}),
k_{c} AS (SELECT list_transform(range(1, {KNOTS + 1}), lambda i: q[i] / 2 + q[i + 1] / 2) AS k FROM q_{c})"""


def _below_sql(c: str) -> str:
    """z_<c>: the normal score of each customer's number."""
    i = f"least(greatest(len(list_filter(k, lambda v: v <= x)), 1), {KNOTS - 1})"
    u = f"(i - 1 + CASE WHEN k[i + 1] > k[i] THEN least(greatest((x - k[i]) / (k[i + 1] - k[i]), 0.0), 1.0) ELSE 0.5 END + 0.5::DOUBLE) / {KNOTS}"
    return f"z_{c} AS (SELECT {KEY}, {quantile_sql('u')} AS z FROM (SELECT {KEY}, least(greatest({u}, 1e-9::DOUBLE), 1 - 1e-9::DOUBLE) AS u FROM (SELECT {KEY}, x, k, {i} AS i FROM (SELECT {KEY}, {c}::DOUBLE AS x, k FROM customer, k_{c}))))"


def _at_sql(u: str, c: str) -> str:
    return f"(SELECT k[i + 1] + (p - i) * (k[i + 2] - k[i + 1]) FROM (SELECT k, p, least(floor(p), {KNOTS - 2})::INT AS i FROM (SELECT k, {u} * {KNOTS - 1} AS p FROM k_{c})))"


_D = lambda a: f"CASE WHEN {a} IN (0, 1) THEN 0 ELSE exp(-pow({quantile_sql(a)}, 2) / 2) / sqrt(2 * pi()) END"
_NOISE = ", ".join(f"sqrt(-2 * ln({_word(i, 1)})) * cos(2 * pi() * {_word(i, 2)}) AS n{i}" for i in range(3))
_RETAINED = retained(0.75, 2)
_BLEND = lambda z, n: f"{_RETAINED!r}::DOUBLE * {z} + {(1 - _RETAINED**2) ** 0.5!r}::DOUBLE * ({n})"
#: The fit and the twin of customers: knots, shares, scores, correlations, their Cholesky factor, and the blend.
GENERATED_SQL = f"""{', '.join(_quantiles_sql(c) for c in _NUMBERS)}, {', '.join(_below_sql(c) for c in _NUMBERS)},
s AS (SELECT c_mktsegment AS value, (sum(count(*)) OVER (ORDER BY c_mktsegment) - count(*))::DOUBLE / sum(count(*)) OVER () AS low, (sum(count(*)) OVER (ORDER BY c_mktsegment))::DOUBLE / sum(count(*)) OVER () AS high FROM customer GROUP BY 1),
sl AS (SELECT list(value ORDER BY value) AS v, list(high ORDER BY value) AS t FROM s),
zs AS (SELECT {KEY}, a.z AS z0, b.z AS z1, least(greatest(low + {_word(2, 0)} * (high - low), 1e-9::DOUBLE), 1 - 1e-9::DOUBLE) AS u2, c_mktsegment
  FROM z_c_nationkey a JOIN z_c_acctbal b USING ({KEY}) JOIN customer USING ({KEY}) JOIN s ON value = c_mktsegment),
st AS (SELECT value, {_D('low')} - {_D('high')} AS step FROM s),
sg AS (SELECT value, any_value(step) AS step, sum(z0) AS s0, sum(z1) AS s1 FROM zs JOIN st ON value = c_mktsegment GROUP BY value),
r AS (SELECT (SELECT round(corr(z0, z1), 9) FROM zs) AS r01, round(sum(s0 * step) / (SELECT count(*) FROM zs) / sum(step * step), 9) AS r02, round(sum(s1 * step) / (SELECT count(*) FROM zs) / sum(step * step), 9) AS r12 FROM sg),
c AS (SELECT r01 AS c10, sqrt(1 - r01 * r01) AS c11, r02 AS c20, (r12 - r01 * r02) / sqrt(1 - r01 * r01) AS c21 FROM r),
m AS (SELECT {KEY}, {_BLEND('z0', 'n0')} AS m0, {_BLEND('z1', 'c10 * n0 + c11 * n1')} AS m1, {_BLEND('z2', 'c20 * n0 + c21 * n1 + sqrt(1 - c20 * c20 - c21 * c21) * n2')} AS m2
  FROM (SELECT *, {quantile_sql('u2')} AS z2, {_NOISE} FROM zs), c),
made AS (SELECT {KEY}, {cdf_sql('m0')} AS v0, {cdf_sql('m1')} AS v1, {cdf_sql('m2')} AS v2 FROM m),
generated AS (SELECT {KEY}, round({_at_sql('v0', 'c_nationkey')})::INT AS c_nationkey, {_at_sql('v1', 'c_acctbal')} AS c_acctbal, v[len(list_filter(t[1 : len(t) - 1], lambda x: x <= v2)) + 1] AS c_mktsegment FROM made, sl)"""


@query("generate_twin", f"WITH {GENERATED_SQL} SELECT {KEY}, c_nationkey, round(c_acctbal, 4) AS c_acctbal, c_mktsegment FROM generated")
def generate_twin(spark, d):
    return generate(_read(spark, d, "customer"), KEY, seed=SEED).df.withColumn("c_acctbal", rounded("c_acctbal", 4))


@query("twin_from_model", f"WITH {GENERATED_SQL} SELECT {KEY}, c_nationkey, round(c_acctbal, 4) AS c_acctbal, c_mktsegment FROM generated WHERE {KEY} % 3 = 0")
def twin_from_model(spark, d):
    """Twins of some of the rows, from a model that was written and read back."""
    customer = _read(spark, d, "customer")
    path = new_path(spark, "model")
    write_model(spark, fit(customer, KEY, seed=SEED), path)
    return twin_of(customer.where(F.col(KEY) % 3 == 0), read_model(spark, path)).withColumn("c_acctbal", rounded("c_acctbal", 4))


@query("surrogate_names", f"WITH {surrogate_sql('s', f'(SELECT {KEY}, c_name FROM customer)', 'c_name', f'{SEED}|c_name')} SELECT {KEY}, c_name FROM s")
def surrogate_names(spark, d):
    return generate(_read(spark, d, "customer"), KEY, seed=SEED, surrogates=True).df.select(KEY, "c_name")


_CATS = ["l_linenumber", "l_returnflag", "l_linestatus"]


@query("category_tables", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {a}::VARCHAR AS value_a, {b}::VARCHAR AS value_b, count(*) AS n FROM lineitem GROUP BY {a}, {b}" for i, a in enumerate(_CATS) for b in _CATS[i + 1 :]))
def category_tables(spark, d):
    return contingency(_read(spark, d, "lineitem"), _CATS)


@query("generate_twin_wide")
def generate_twin_wide(spark, d):
    x = _read(spark, d, "lineitem").withColumn("prod", F.col("l_quantity") * F.col("l_extendedprice"))
    keyed = x.withColumn("_key", F.concat_ws("|", *_ROW)).select("_key", *NUMS, "prod", "l_linenumber", "l_returnflag", "l_shipdate")
    return generate(keyed, "_key", seed=SEED, keep_key=False).df


@query("attack_sample", f"SELECT * FROM (SELECT {KEY}, {', '.join(COLS)} FROM customer) ORDER BY {_U('attack')}, {KEY} LIMIT 500")
def q_sample(spark, d):
    return privacy.attack_sample(_customer(spark, d), KEY, 500, SEED)


@query("singling_out_univariate", "SELECT count(*) FILTER (WHERE n = 1) AS unique_values, count(*) AS distinct_values FROM (SELECT c_acctbal, count(*) AS n FROM customer GROUP BY c_acctbal)")
def singling_out_univariate(spark, d):
    return privacy.uniques(_customer(spark, d), "c_acctbal")


@query("singling_out_multivariate", f"WITH {TWIN_SQL}, {MEDIAN_SQL}, {_single_sql('s', 'twin', COLS)} SELECT * FROM s")
def singling_out_multivariate(spark, d):
    real, specs = _customer(spark, d), _specs(spark, d)
    return privacy.singling_out(real, _twin(spark, d), specs, KEY, COLS, privacy.medians(real, specs, COLS), N_ATTACKS, SEED)


@query("singling_out_saturated", f"WITH {TWIN_SQL}, {MEDIAN_SQL}, {_single_sql('s', 'twin', COLS)} SELECT p_{KEY}, least(matches, 2) AS matches FROM s")
def singling_out_saturated(spark, d):
    """What the score needs: none, one or more."""
    real, specs = _customer(spark, d), _specs(spark, d)
    return privacy.singling_out(real, _twin(spark, d), specs, KEY, COLS, privacy.medians(real, specs, COLS), N_ATTACKS, SEED, most=2)


@query("gower_knn", f"WITH {TWIN_SQL}, {RANGE_SQL}, {_sample_sql('att', 'real', 'attack')}, {_near_sql('near', 'att', 'twin', COLS, 3)} SELECT a_{KEY}, rank::INT AS rank, dist, t_{KEY} FROM near")
def gower_knn(spark, d):
    real = _customer(spark, d)
    found = privacy.nearest(privacy.attack_sample(real, KEY, N_ATTACKS, SEED), _twin(spark, d), _specs(spark, d), KEY, COLS, k=3)
    return found.select("a_" + KEY, "rank", "dist", "t_" + KEY)


@query(
    "linkability_attack",
    f"WITH {TWIN_SQL}, {RANGE_SQL}, {_sample_sql('link', 'real', 'link')}, {_near_sql('na', 'link', 'twin', PART_A, 2)}, {_near_sql('nb', 'link', 'twin', PART_B, 2)} "
    f"SELECT {KEY} AS a_{KEY}, (EXISTS (SELECT 1 FROM na JOIN nb ON na.a_{KEY} = nb.a_{KEY} AND na.t_{KEY} = nb.t_{KEY} WHERE na.a_{KEY} = link.{KEY}))::INT AS hit FROM link",
)
def linkability_attack(spark, d):
    return privacy.linkability(_customer(spark, d), _twin(spark, d), _specs(spark, d), KEY, PART_A, PART_B, N_ATTACKS, 2, SEED)


def _infer_sql(rep: int) -> str:
    near = ", ".join(_near_sql(f"i{rep}_{i}", f"att{rep}", "twin", rest, 1) for i, rest in enumerate(SECRETS.values()))
    return f"{_sample_sql(f'att{rep}', 'real', f'infer:{rep}')}, {near}"


def _infer_rows(rep: int) -> str:
    return " UNION ALL ".join(f"SELECT {rep}::INT AS rep, '{s}' AS secret, sum(({_RIGHT[s]})::INT)::BIGINT AS hits, count(*) AS n FROM i{rep}_{i}" for i, s in enumerate(SECRETS))


@query("inference_attack", f"WITH {TWIN_SQL}, {RANGE_SQL}, {_infer_sql(0)} {_infer_rows(0)}")
def inference_attack(spark, d):
    return privacy.inference(_customer(spark, d), _twin(spark, d), _specs(spark, d), KEY, COLS, {0: COLS}, N_ATTACKS, SEED)


@query("inference_replicates", f"WITH {TWIN_SQL}, {RANGE_SQL}, {', '.join(_infer_sql(r) for r in range(3))}, x AS ({' UNION ALL '.join(_infer_rows(r) for r in range(3))}) SELECT secret, round(avg(hits / n::DOUBLE), 9) AS rate FROM x GROUP BY secret")
def inference_replicates(spark, d):
    real, twin, specs = _customer(spark, d), _twin(spark, d), _specs(spark, d)
    out = privacy.inference(real, twin, specs, KEY, COLS, dict.fromkeys(range(3), COLS), N_ATTACKS, SEED)
    return out.groupBy("secret").agg(rounded(F.avg(F.col("hits") / F.col("n")), 9).alias("rate"))


_THREE = ["singling_out", "linkability", "inference"]


@query("baseline_rates", f"WITH RECURSIVE {ATTACKS_SQL} SELECT {', '.join(f'round({c}, 9) AS {c}' for c in _THREE)} FROM shuffled_rates")
def baseline_rates(spark, d):
    return _rates(spark, d, _shuffled(spark, d))[0].select(*[rounded(c, 9).alias(c) for c in _THREE])


def _score_sql(c: str) -> str:
    return f"round(CASE WHEN b.{c} < 1 THEN 100 * (1 - greatest(0.0, least(1.0, (t.{c} - b.{c}) / (1 - b.{c})))) END, 6)"


def _scores(spark, d):
    t, b = _rates(spark, d, _twin(spark, d), _shuffled(spark, d))
    b = b.select(*[F.col(c).alias("b_" + c) for c in _THREE])
    return t.crossJoin(b).select(*[rounded(privacy.normalised(F.col(c), F.col("b_" + c))).alias(c) for c in _THREE])


@query("privacy_scores", f"WITH RECURSIVE {ATTACKS_SQL} SELECT {', '.join(f'{_score_sql(c)} AS {c}' for c in _THREE)} FROM twin_rates t, shuffled_rates b")
def privacy_scores(spark, d):
    return _scores(spark, d)


@query("privacy_composite", f"WITH RECURSIVE {ATTACKS_SQL}, s AS (SELECT {', '.join(f'{_score_sql(c)} AS {c}' for c in _THREE)} FROM twin_rates t, shuffled_rates b) SELECT round((singling_out + linkability + inference) / 3, 5) AS composite FROM s")
def privacy_composite(spark, d):
    return _scores(spark, d).select(rounded((F.col("singling_out") + F.col("linkability") + F.col("inference")) / 3, 5).alias("composite"))


_W = "h / n + 1.96 * 1.96 / (2 * n)", "1.96 * sqrt(h / n * (1 - h / n) / n + 1.96 * 1.96 / (4 * n * n))"


@query("wilson_interval", f"WITH x AS (SELECT c_mktsegment, count(*) FILTER (WHERE c_acctbal < 0)::DOUBLE AS h, count(*)::DOUBLE AS n FROM customer GROUP BY 1) SELECT c_mktsegment, round(({_W[0]} - {_W[1]}) / (1 + 1.96 * 1.96 / n), 9) AS low, round(({_W[0]} + {_W[1]}) / (1 + 1.96 * 1.96 / n), 9) AS high FROM x")
def wilson_interval(spark, d):
    x = _read(spark, d, "customer").groupBy("c_mktsegment").agg(F.count(F.when(F.col("c_acctbal") < 0, 1)).cast("double").alias("h"), F.count("*").cast("double").alias("n"))
    low, high = privacy.wilson(F.col("h"), F.col("n"))
    return x.select("c_mktsegment", rounded(low, 9).alias("low"), rounded(high, 9).alias("high"))


def _flat(df: DataFrame) -> DataFrame:
    scores = [rounded(f"fidelity.{c}", 5).alias(c) for c in ("mean", "variance", "correlation", "ks", "composite")]
    return df.select("seed", *scores, *[rounded(F.col("privacy")[c], 5).alias(c) for c in _THREE], rounded("privacy.composite", 5).alias("privacy_composite"))


_AUX, _WIDE, _REPS = privacy.draw(COLS, 3, SEED, "aux"), privacy.draw(COLS, 2, SEED, "single"), range(2)


def _report_rates_sql(twin: str) -> str:
    near = [_near_sql(f"{twin}_a", "link", twin, _AUX[:2], 1), _near_sql(f"{twin}_b", "link", twin, _AUX[2:], 1)]
    near += [_near_sql(f"{twin}_i{r}_{s}", f"infer{r}", twin, rest, 1) for r in _REPS for s, rest in SECRETS.items()]
    infer = " UNION ALL ".join(f"SELECT ({_RIGHT[s]})::INT AS x FROM {twin}_i{r}_{s}" for r in _REPS for s in SECRETS)
    return f"""{_single_sql(twin + '_s', twin, _WIDE)}, {', '.join(near)},
{twin}_rates AS (SELECT (SELECT avg((matches = 1)::INT) FROM {twin}_s) AS singling_out,
  (SELECT count(*) / {N_ATTACKS}.0::DOUBLE FROM {twin}_a a JOIN {twin}_b b ON a.a_{KEY} = b.a_{KEY} AND a.t_{KEY} = b.t_{KEY}) AS linkability, (SELECT avg(x) FROM ({infer})) AS inference)"""


def _report_sql(twin: str, more: str = "") -> str:
    """The report from tables ``real`` and ``twin``."""
    samples = ", ".join([_sample_sql("link", "real", "link"), *[_sample_sql(f"infer{r}", "real", f"infer:{r}") for r in _REPS]])
    mom = _MOM
    off = lambda t: f"abs((SELECT corr(c_nationkey, c_acctbal) FROM real) - (SELECT corr(c_nationkey, c_acctbal) FROM {t}))"
    score = lambda c: f"CASE WHEN b.{c} < 1 THEN 100 * (1 - greatest(0.0, least(1.0, (t.{c} - b.{c}) / (1 - b.{c})))) END"
    names = ["mean", "variance", "correlation", "ks", "composite", *_THREE, "privacy_composite"]
    return f"""WITH RECURSIVE {twin}, {SHUFFLED_SQL}, {RANGE_SQL}, {MEDIAN_SQL}, {samples}, {_report_rates_sql('twin')}, {_report_rates_sql('shuffled')}, mom AS ({mom}), ks AS ({' UNION ALL '.join(_ks_sql(c, 'real', 'twin') for c in _TWO)}),
f AS (SELECT (SELECT avg(100 * greatest(0.0, 1 - abs(tm - m) / sqrt(v))) FROM mom) AS mean, (SELECT avg(100 * least(v, tv) / greatest(v, tv)) FROM mom) AS variance,
  100 * greatest(0.0, 1 - {off('twin')} / {off('shuffled')}) AS correlation, (SELECT avg(100 * (1 - ks)) FROM ks) AS ks),
p AS (SELECT {', '.join(f'{score(c)} AS {c}' for c in _THREE)} FROM twin_rates t, shuffled_rates b),
z AS (SELECT *, (mean + variance + correlation + ks) / 4 AS composite, (singling_out + linkability + inference) / 3 AS privacy_composite FROM f, p)
SELECT {SEED}::BIGINT AS seed, {', '.join(f'round({c}, 5) AS {c}' for c in names)}{more} FROM z"""


@query("evaluate_report", _report_sql(TWIN_SQL))
def evaluate_report(spark, d):
    return _flat(evaluate(_customer(spark, d), _twin(spark, d), KEY, n_attacks=N_ATTACKS, n_reps=2, seed=SEED))


@query("evaluate_skip_privacy", f"WITH {TWIN_SQL}, mom AS ({_MOM}), k AS ({' UNION ALL '.join(_ks_sql(c, 'real', 'twin') for c in _TWO)}) SELECT (SELECT round(avg(100 * greatest(0.0, 1 - abs(tm - m) / sqrt(v))), 5) FROM mom) AS mean, (SELECT round(avg(100 * least(v, tv) / greatest(v, tv)), 5) FROM mom) AS variance, (SELECT round(avg(100 * (1 - ks)), 5) FROM k) AS ks, true AS privacy_skipped")
def evaluate_skip_privacy(spark, d):
    r = evaluate(_customer(spark, d), _twin(spark, d), KEY, skip_privacy=True, seed=SEED)
    return r.select(*[rounded(f"fidelity.{c}", 5).alias(c) for c in ("mean", "variance", "ks")], F.col("privacy").isNull().alias("privacy_skipped"))


_ORDERS_SQL = f"""real AS (SELECT o_totalprice AS price, epoch_us(o_orderdate) / 1e6 AS day FROM orders),
twin AS (SELECT o_totalprice * (0.9 + 0.2 * {_U('price', 'o_orderkey')}) AS price, epoch_us(o_orderdate + to_days((o_orderkey % 30)::INT)) / 1e6 AS day FROM orders)"""


def _orders_score(c: str) -> str:
    return f"SELECT 100 * greatest(0.0, 1 - abs(avg(t.{c}) - avg(r.{c})) / stddev_samp(r.{c})) AS m, 100 * least(var_samp(r.{c}), var_samp(t.{c})) / greatest(var_samp(r.{c}), var_samp(t.{c})) AS v FROM real r POSITIONAL JOIN twin t"


@query("evaluate_dates", f"WITH {_ORDERS_SQL} SELECT round(avg(m), 4) AS mean, round(avg(v), 4) AS variance FROM ({_orders_score('price')} UNION ALL {_orders_score('day')})")
def evaluate_dates(spark, d):
    """Fidelity of a twin of orders whose dates have moved by up to a month."""
    real = _read(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("day"))
    later = F.col("day") + F.make_dt_interval(days=(F.col("o_orderkey") % 30).cast("int"))
    twin = real.select("o_orderkey", (F.col("price") * (0.9 + 0.2 * hash_uniform(SEED, "price", F.col("o_orderkey")))).alias("price"), later.alias("day"))
    scores = evaluate(real, twin, "o_orderkey", skip_privacy=True, seed=SEED)
    return scores.select(*[rounded(f"fidelity.{c}", 4).alias(c) for c in ("mean", "variance")])


@query("provenance_row", f"SELECT {SEED}::BIGINT AS seed, 2 AS k, 0.75::DOUBLE AS mix_prob, count(*) AS n_rows, 3 AS n_cols FROM customer")
def provenance_row(spark, d):
    return generate(_read(spark, d, "customer"), KEY, seed=SEED).provenance.select("seed", "k", "mix_prob", "n_rows", "n_cols")


_CERTIFIED = f"{GENERATED_SQL}, real AS (SELECT {KEY}, {', '.join(COLS)} FROM customer), twin AS (SELECT {KEY}, {', '.join(COLS)} FROM generated)"


@query("certificate_data", _report_sql(_CERTIFIED, ", 2 AS k, 0.75::DOUBLE AS mix_prob, (SELECT count(*) FROM customer) AS n_rows, 3 AS n_cols"))
def certificate_data(spark, d):
    result = generate(_read(spark, d, "customer"), KEY, seed=SEED)
    return _flat(evaluate(_customer(spark, d), result.df, KEY, n_attacks=N_ATTACKS, n_reps=2, seed=SEED)).crossJoin(result.provenance.select("k", "mix_prob", "n_rows", "n_cols"))
