"""All scores of a twin in one row, and the certificate that shows them."""

from __future__ import annotations

import html
import secrets as random_source

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinloom.operators import fidelity, privacy
from twinloom.operators.baseline import shuffle_columns
from twinloom.operators.profile import ColumnSpec, as_numbers, profile
from twinloom.storage import delete, written

SINGLING_SHARE = 0.75
RESULT = (
    "seed long, fidelity struct<mean:double,variance:double,correlation:double,ks:double,composite:double>, "
    "privacy struct<singling_out:double,linkability:double,inference:double,composite:double>, "
    "intervals struct<singling_out:struct<low:double,high:double>,linkability:struct<low:double,high:double>,inference:struct<low:double,high:double>>"
)


def _usable(real: DataFrame, twin: DataFrame, key: str, columns: list[str] | None) -> list[ColumnSpec]:
    names = [c for c in (columns or real.columns) if c != key and c in twin.columns]
    return [s for s in profile(real, names) if s.kind != "identifier" and s.nulls < s.n]


def fidelity_scores(real: DataFrame, twin: DataFrame, shuffled: DataFrame, numbers: list[str]) -> dict[str, float | None]:
    """Means over the columns of the four metrics; null where a metric isn't defined."""
    if not numbers:
        return dict.fromkeys(("mean", "variance", "correlation", "ks"))
    mean = lambda df: df.agg(F.avg("score")).first()[0]
    out = {
        "mean": mean(fidelity.fidelity_mean(real, twin, numbers)),
        "variance": mean(fidelity.fidelity_variance(real, twin, numbers)),
        "correlation": fidelity.fidelity_correlation(real, twin, shuffled, numbers).first()[0] if len(numbers) > 1 else None,
        "ks": mean(fidelity.fidelity_ks(real, twin, numbers)),
    }
    return out


def _rate(outcomes: DataFrame, hits: Column, tries: Column) -> tuple[float | None, tuple[float | None, float | None]]:
    """Success rate of an attack, and the bounds of its Wilson interval."""
    low, high = privacy.wilson(F.sum(hits), F.nullif(F.sum(tries), F.lit(0)))
    row = outcomes.agg(F.try_divide(F.sum(hits), F.sum(tries)).alias("rate"), low.alias("low"), high.alias("high")).first()
    return row.rate, (row.low, row.high)


def attack_rates(real: DataFrame, twins: list[DataFrame], specs: list[ColumnSpec], key: str, seed: int, n_attacks: int, n_secrets: int, n_reps: int, n_neighbors: int, n_aux_cols: int) -> list[dict[str, tuple | None]]:
    """Success rates of the three attacks on each twin, each with its interval; null where an attack isn't defined.

    The attacked rows, medians and columns are drawn once and serve all twins.
    """
    names = [s.name for s in specs]
    out: list[dict[str, tuple | None]] = [dict.fromkeys(("singling_out", "linkability", "inference")) for _ in twins]
    if not names:
        return out
    wide = privacy.draw(names, max(1, round(SINGLING_SHARE * len(names))), seed, "single")
    middle = privacy.medians(real, specs, wide)
    secrets = {rep: privacy.draw(names, min(n_secrets, len(names)), seed, f"secret:{rep}") for rep in range(n_reps)}
    aux = privacy.draw(names, min(n_aux_cols, len(names)), seed, "aux")
    half = (len(aux) + 1) // 2
    samples = privacy.real_samples(real, specs, key, names, n_attacks, seed, list(secrets)) if len(names) > 1 else {}
    for rates, twin in zip(out, twins):
        found = privacy.singling_out(real, twin, specs, key, wide, middle, n_attacks, seed, most=2)
        rates["singling_out"] = _rate(found, (F.col("matches") == 1).cast("int"), F.lit(1))
        if len(names) > 1:
            hits = privacy.linkability(real, twin, specs, key, aux[:half], aux[half:] or aux[:1], n_attacks, n_neighbors, seed, samples)
            rates["linkability"] = _rate(hits, F.col("hit"), F.lit(1))
            # every replicate attacks equally many rows, so that this is the mean of the replicates' rates
            rates["inference"] = _rate(privacy.inference(real, twin, specs, key, names, secrets, n_attacks, seed, samples), F.col("hits"), F.col("n"))
    return out


def score(rate: float | None, base: float | None) -> float | None:
    if rate is None or base is None or base >= 1:
        return None
    return 100 * (1 - min(1.0, max(0.0, (rate - base) / (1 - base))))


def _mean(values) -> float | None:
    known = [v for v in values if v is not None]
    return sum(known) / len(known) if known else None


def evaluate(
    real: DataFrame, twin: DataFrame, key: str, columns: list[str] | None = None, skip_privacy: bool = False, n_attacks: int = 500, n_secrets: int = 5, n_reps: int = 10, n_neighbors: int = 1, n_aux_cols: int = 20, seed: int | None = None
) -> DataFrame:
    """One row: four fidelity and three privacy scores (0 to 100), privacy relative to a column-shuffled table.

    Dates and times are compared as numbers; NaN and infinity are missing values.
    ``intervals`` are the Wilson intervals of the attacks' success rates on the twin.
    """
    seed = random_source.randbits(32) if seed is None else seed
    specs = _usable(real, twin, key, columns)
    names = [s.name for s in specs]
    numbers = [s.name for s in specs if s.kind == "continuous" or s.type.typeName() not in ("string", "boolean")]
    real, twin = as_numbers(real.select(key, *names), key), as_numbers(twin.select(key, *names), key)
    twin = written(twin, "twin")  # read by every metric, made once
    shuffled = written(shuffle_columns(real, key, names, seed), "shuffled") if names else real
    f = fidelity_scores(real, twin, shuffled, numbers)
    f["composite"] = _mean(f.values())
    p = dict.fromkeys(("singling_out", "linkability", "inference", "composite"))
    if not skip_privacy:
        args = (specs, key, seed, n_attacks, n_secrets, n_reps, n_neighbors, n_aux_cols)
        rates, base = attack_rates(real, [twin, shuffled], *args)
        p = {m: score(rates[m] and rates[m][0], base[m] and base[m][0]) for m in rates}
        p["composite"] = _mean(p.values())
        intervals = {m: r and r[1] for m, r in rates.items()}
    delete(twin, *([shuffled] if names else []))
    return real.sparkSession.createDataFrame([(seed, f, None if skip_privacy else p, None if skip_privacy else intervals)], RESULT)


def certificate(scores: DataFrame, provenance: DataFrame, title: str = "Twin certificate") -> str:
    """A self-contained HTML page from the one row of scores and the one row of provenance."""
    s, p = scores.first(), provenance.first()

    def table(name: str, values: dict) -> str:
        cells = "".join(f"<tr><th>{html.escape(str(k))}</th><td>{html.escape('n/a' if v is None else f'{v:.2f}' if isinstance(v, float) else str(v))}</td></tr>" for k, v in values.items())
        return f"<h2>{html.escape(name)}</h2><table>{cells}</table>"

    body = table("Fidelity (0-100)", s.fidelity.asDict())
    body += table("Privacy (0-100; 100: no more leakage than a random permutation)", s.privacy.asDict()) if s.privacy else "<p>Privacy was not evaluated.</p>"
    body += table("Provenance", p.asDict())
    note = "<p>Scores describe these two tables and attacks; they are no formal privacy guarantee.</p>"
    style = "<style>body{font-family:sans-serif;margin:2em}th{text-align:left;padding-right:2em}</style>"
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title>{style}</head><body><h1>{html.escape(title)}</h1>{body}{note}</body></html>"


def certify(real: DataFrame, twin: DataFrame, provenance: DataFrame, key: str, seed: int | None = None, k: int | None = None, mix_prob: float | None = None, **options) -> str:
    """Evaluates and renders; ``seed``, ``k`` and ``mix_prob`` override what the provenance says."""
    for name, value in (("seed", seed), ("k", k), ("mix_prob", mix_prob)):
        if value is not None:
            provenance = provenance.withColumn(name, F.lit(value))
    return certificate(evaluate(real, twin, key, seed=provenance.first().seed, **options), provenance)
