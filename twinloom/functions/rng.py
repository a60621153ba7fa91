"""Random numbers as column expressions of a seed, a salt and a row's key.

They do not depend on partitioning, and SQL engines with md5 give the same.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_uniform(seed: int, salt: str, key: Column) -> Column:
    """Uniform in (0, 1): 32 bits of md5 over seed, salt and key, centred in their cell."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), key.cast("string")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / float(2**32)


def hash_normal(seed: int, salt: str, key: Column) -> Column:
    """Standard normal, by the Box-Muller transform of two uniforms."""
    radius = F.sqrt(-2 * F.ln(hash_uniform(seed, salt + ":r", key)))
    return radius * F.cos(2 * F.pi() * hash_uniform(seed, salt + ":a", key))


# Coefficients of Acklam's rational approximation to the inverse normal distribution function.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
# Abramowitz and Stegun 26.2.17.
_P = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
_LOW = 0.02425


def _horner(x, coefficients):
    out = coefficients[0]
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    q = F.sqrt(-2 * F.ln(p))
    r = F.sqrt(-2 * F.ln(1 - p))
    m = p - 0.5
    tail = lambda t: _horner(t, _C) / (_horner(t, _D) * t + 1)
    middle = m * _horner(m * m, _A) / (_horner(m * m, _B) * m * m + 1)
    return F.when(p < _LOW, tail(q)).when(p > 1 - _LOW, -tail(r)).otherwise(middle)


def normal_cdf(z: Column) -> Column:
    t = 1 / (1 + 0.2316419 * F.abs(z))
    upper = F.exp(-z * z / 2) * 0.3989422804014327 * t * _horner(t, _P[::-1])
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def normal_quantile_array(p: np.ndarray) -> np.ndarray:
    tail = lambda t: _horner(t, _C) / (_horner(t, _D) * t + 1)
    m = p - 0.5
    out = m * _horner(m * m, _A) / (_horner(m * m, _B) * m * m + 1)
    below, above = p < _LOW, p > 1 - _LOW  # a twentieth of all, as a rule
    out[below] = tail(np.sqrt(-2 * np.log(p[below])))
    out[above] = -tail(np.sqrt(-2 * np.log(1 - p[above])))
    return out


def normal_cdf_array(z: np.ndarray) -> np.ndarray:
    t = 1 / (1 + 0.2316419 * np.abs(z))
    upper = np.exp(-z * z / 2) * 0.3989422804014327 * t * _horner(t, _P[::-1])
    return np.where(z >= 0, 1 - upper, upper)


def _sql_horner(x: str, coefficients) -> str:
    out = f"({coefficients[0]!r})"
    for c in coefficients[1:]:
        out = f"({out} * {x} + ({c!r}))"
    return out


def uniform_sql(seed: int, salt: str, key: str) -> str:
    return f"((('0x' || substr(md5(concat_ws('|', '{seed}', '{salt}', ({key})::VARCHAR)), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)"


def normal_sql(seed: int, salt: str, key: str) -> str:
    return f"(sqrt(-2 * ln({uniform_sql(seed, salt + ':r', key)})) * cos(2 * pi() * {uniform_sql(seed, salt + ':a', key)}))"


def cdf_sql(z: str) -> str:
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    upper = f"(exp(-({z}) * ({z}) / 2) * 0.3989422804014327 * {t} * {_sql_horner(t, _P[::-1])})"
    return f"CASE WHEN {z} >= 0 THEN 1 - {upper} ELSE {upper} END"


def quantile_sql(p: str) -> str:
    tail = lambda t: f"({_sql_horner(t, _C)} / ({_sql_horner(t, _D)} * {t} + 1))"
    m = f"({p} - 0.5)"
    middle = f"({m} * {_sql_horner(f'({m} * {m})', _A)} / ({_sql_horner(f'({m} * {m})', _B)} * {m} * {m} + 1))"
    return f"CASE WHEN {p} < {_LOW} THEN {tail(f'sqrt(-2 * ln({p}))')} WHEN {p} > {1 - _LOW} THEN -{tail(f'sqrt(-2 * ln(1 - {p}))')} ELSE {middle} END"
