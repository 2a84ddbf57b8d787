"""Column functions: the normal distribution, seeded uniforms, clipping, vector measures."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TERMS = 45


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution function by its series at 0, exact to double precision for |z| <= 4; 0 or 1
    beyond 8. z should be a column, not an expression: it is used in every term."""
    z2 = z * z
    factors = [1.0]
    for k in range(1, TERMS + 1):
        factors.append(factors[-1] / (2 * k + 1))
    inner = F.lit(factors[-1])
    for c in reversed(factors[:-1]):
        inner = z2 * inner + c
    value = F.lit(0.5) + F.exp(z2 * F.lit(-0.5)) / F.lit(math.sqrt(2 * math.pi)) * z * inner
    return F.when(z > 8, 1.0).when(z < -8, 0.0).otherwise(value)


def normal_cdf_sql(z: str) -> str:
    inner = "1.0::DOUBLE"
    for k in range(TERMS, 0, -1):
        inner = f"(1.0::DOUBLE + {z} * {z} / {2 * k + 1}.0::DOUBLE * {inner})"
    return f"(CASE WHEN {z} > 8 THEN 1.0::DOUBLE WHEN {z} < -8 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE + exp({z} * {z} * -0.5::DOUBLE) / {math.sqrt(2 * math.pi)!r}::DOUBLE * {z} * {inner} END)"


def hash_uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the parts only."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def hash_uniform_sql(seed: int, *parts: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *[f"{p}::VARCHAR" for p in parts]])
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def euclidean(x: Column, p: Column) -> Column:
    """The Frobenius norm of x - p, both flat arrays."""
    return F.sqrt(_sum(F.zip_with(x, p, lambda a, b: (a - b) * (a - b))))


def mean_abs_diff(x: Column, p: Column) -> Column:
    return _sum(F.zip_with(x, p, lambda a, b: F.abs(a - b))) / F.size(x)


def cosine_distance(x: Column, p: Column) -> Column:
    """1 - cosine; null if either is zero."""
    dot = _sum(F.zip_with(x, p, lambda a, b: a * b))
    return 1 - F.try_divide(dot, F.sqrt(_sum(F.transform(x, lambda a: a * a))) * F.sqrt(_sum(F.transform(p, lambda a: a * a))))


def pearson_distance(x: Column, p: Column) -> Column:
    """1 - correlation; null if either is constant."""
    centred = lambda a: F.transform(a, lambda v: v - _sum(a) / F.size(a))
    return cosine_distance(centred(x), centred(p))


def difference_factors(d: int) -> list[float]:
    """Coefficients of x[t-1], x[t-2], .. in the sum of the differences of order 0 to d - 1 at t - 1."""
    out = [0.0] * d
    for j in range(d):
        for k in range(j + 1):
            out[k] += (-1) ** k * math.comb(j, k)
    return out


#: Up to so many values the distribution of the one-sample statistic is exact, beyond its limit; n * d * d from which the two
#: sides can't both be passed but for less than a rounding.
EXACT, ONE_SIDED = 250, 4.0
#: One over the factorials of 0 to 160.
_INVERSE_FACTORIALS = [1 / math.factorial(i) for i in range(161)]


def _in_both(n: Column, d: Column) -> Column:
    """P(D >= d) by the matrix of Marsaglia, Tsang and Wang: its n-th power is taken by n steps of a vector, with each
    step's share of n! / n ** n, so that nothing over- or underflows."""
    k = (F.floor(n * d) + 1).cast("int")

    def with_matrix(k: Column) -> Column:
        m, h = 2 * k - 1, k - n * d
        each = F.sequence(F.lit(0), m - 1)

        def entry(i: Column, j: Column) -> Column:
            edge = F.when(j == 0, F.pow(h, i + 1)).otherwise(0.0) + F.when(i == m - 1, F.pow(h, m - j)).otherwise(0.0)
            corner = F.when((i == m - 1) & (j == 0), F.pow(F.greatest(2 * h - 1, F.lit(0.0)), m)).otherwise(0.0)
            return F.when(i - j + 1 < 0, 0.0).otherwise((1 - edge + corner) * F.get(F.array(*[F.lit(x) for x in _INVERSE_FACTORIALS]), F.greatest(i - j + 1, F.lit(0))))

        def power(matrix: Column) -> Column:
            start = F.transform(each, lambda i: F.when(i == k - 1, 1.0).otherwise(0.0))
            steps = F.aggregate(F.sequence(F.lit(1), n.cast("int")), start, lambda v, s: F.transform(matrix, lambda row: _sum(F.zip_with(row, v, lambda a, b: a * b)) * (s / n)))
            return 1 - F.get(steps, k - 1)

        return _let(F.transform(each, lambda i: F.transform(each, lambda j: entry(i, j))), power)

    return _let(k, with_matrix)


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _one_sided(n: Column, d: Column) -> Column:
    """P(D+ >= d), the exact sum; logarithms of factorials are running sums."""
    logs = F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.array(F.lit(0.0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.log(x.cast("double")))))

    def total(logs: Column) -> Column:
        def term(j: Column) -> Column:
            choose = F.get(logs, n.cast("int")) - F.get(logs, j) - F.get(logs, n.cast("int") - j)
            rest = F.greatest(1 - d - j / n, F.lit(0.0))
            return F.when(rest > 0, F.exp(choose + (j - 1) * F.log(d + j / n) + (n - j) * F.log(rest))).otherwise(0.0)

        return d * _sum(F.transform(F.sequence(F.lit(0), F.floor(n * (1 - d)).cast("int")), term))

    return _let(logs, total)


def uniform_p_value(n: Column, d: Column) -> Column:
    """The p-value of the two-sided one-sample Kolmogorov-Smirnov statistic d of n values: exact up to 250 values, by a
    matrix power, or where only one side can be passed by twice the one-sided sum, which keeps its digits however small it
    is; the limiting series beyond. n and d should be columns. Null for null; 1 for d <= 1 / (2 n), 0 for d >= 1."""
    z = (F.sqrt(n) + 0.12 + F.lit(0.11) / F.sqrt(n)) * d
    limit = 2 * _sum(F.transform(F.sequence(F.lit(1), F.lit(100)), lambda j: F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * j * j * z * z)))
    p = F.when(d >= 1, 0.0).when(2 * n * d <= 1, 1.0).when(n > EXACT, limit).when(n * d * d > ONE_SIDED, 2 * _one_sided(n, d)).otherwise(_in_both(n, d))
    return F.when(n.isNotNull() & d.isNotNull(), clip(p, 0.0, 1.0))


def uniform_p_value_sql(pairs: str) -> str:
    """Tables up to pv (n, d, p) for a table of n up to EXACT and d."""
    return f"""pa AS (SELECT n, d, floor(n * d)::INT + 1 AS k, 2 * (floor(n * d)::INT + 1) - 1 AS m, floor(n * d)::INT + 1 - n * d AS h FROM {pairs}),
ma AS (SELECT n, d, k, m, list_transform(range(m), lambda i: list_transform(range(m), lambda j: CASE WHEN i - j + 1 < 0 THEN 0.0::DOUBLE ELSE
    (1 - CASE WHEN j = 0 THEN pow(h, i + 1) ELSE 0 END - CASE WHEN i = m - 1 THEN pow(h, m - j) ELSE 0 END + CASE WHEN i = m - 1 AND j = 0 THEN pow(greatest(2 * h - 1, 0), m) ELSE 0 END) / gamma(i - j + 2.0::DOUBLE) END)) AS a
  FROM pa WHERE n * d * d <= {ONE_SIDED}),
po AS (SELECT n, d, k, m, a, 0 AS s, list_transform(range(m), lambda i: (i = k - 1)::INT::DOUBLE) AS v FROM ma
  UNION ALL SELECT n, d, k, m, a, s + 1, list_transform(a, lambda r: list_sum(list_transform(list_zip(r, v), lambda z: z[1] * z[2])) * ((s + 1) / n::DOUBLE)) FROM po WHERE s < n),
pv AS (SELECT n, d, least(greatest(1 - v[k], 0.0), 1.0) AS p FROM po WHERE s = n
  UNION ALL SELECT n, d, least(2 * d * list_sum(list_transform(range(floor(n * (1 - d))::INT + 1), lambda j: CASE WHEN 1 - d - j / n::DOUBLE > 0 THEN
    exp(lgamma(n + 1.0::DOUBLE) - lgamma(j + 1.0::DOUBLE) - lgamma(n - j + 1.0::DOUBLE) + (j - 1) * ln(d + j / n::DOUBLE) + (n - j) * ln(1 - d - j / n::DOUBLE)) ELSE 0 END)), 1.0) FROM pa WHERE n * d * d > {ONE_SIDED})"""
