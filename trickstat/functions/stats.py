"""Rates, intervals and tests of two proportions as Column expressions. NULL stands for "not enough data"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96
LEAST_TRIALS = 30
# The five-term approximation of erf (Abramowitz and Stegun 7.1.26).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def error_rate(errors: Column, trials: Column) -> Column:
    """Errors in percent of trials, 0 without trials."""
    return F.when(trials > 0, errors / trials * 100).otherwise(F.lit(0.0))


def enough(value: Column, *trials: Column) -> Column:
    for n in trials:
        value = F.when(n >= LEAST_TRIALS, value)
    return value


def wilson_half_width(errors: Column, trials: Column) -> Column:
    """Distance in percent from the observed share to the farther end of its Wilson interval."""
    p, n, z2 = errors / trials, trials.cast("double"), Z * Z
    scale = 1 + z2 / n
    centre = (p + z2 / (2 * n)) / scale
    margin = Z / scale * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return enough(F.greatest(F.abs(p - (centre - margin)), F.abs(centre + margin - p)) * 100, trials)


def wald_half_width(errors: Column, trials: Column) -> Column:
    p = errors / trials
    return enough(F.sqrt(p * (1 - p) / trials) * (Z * 100), trials)


def diff_se(errors_a: Column, trials_a: Column, errors_b: Column, trials_b: Column) -> Column:
    """Standard error in percent of the difference of two shares."""
    p, q = errors_a / trials_a, errors_b / trials_b
    return enough(F.sqrt(p * (1 - p) / trials_a + q * (1 - q) / trials_b) * 100, trials_a, trials_b)


def erf(x: Column) -> Column:
    t = 1 / (1 + ERF_P * F.abs(x))
    total = F.lit(0.0)
    for a in reversed(ERF_A):
        total = (total + a) * t
    return F.signum(x) * (1 - total * F.exp(-x * x))


def normal_cdf(z: Column) -> Column:
    return (erf(z / F.sqrt(F.lit(2.0))) + 1) * 0.5


def verdict(z: Column, p: Column) -> Column:
    """Significance band of p and reading of z, in one word each."""
    band = F.when(p < 0.001, "p<0.001").when(p < 0.01, "p<0.01").when(p < 0.05, "p<0.05").otherwise("not significant")
    reading = F.when(z < -Z, "low").when(z > Z, "normal").otherwise("inconclusive")
    return F.when(z.isNull(), F.lit("no data")).otherwise(F.concat_ws(" ", band, reading))


def relative_change(base: Column, other: Column) -> Column:
    """(other - base) in percent of base, 0 where base is 0."""
    return F.when(base != 0, (other - base) / base * 100).otherwise(F.lit(0.0))


def low_confidence(rate: Column, half_width: Column) -> Column:
    """Whether the interval is wider than the rate itself (or 5, if that is more)."""
    return F.coalesce(half_width > F.greatest(rate, F.lit(5.0)), F.lit(False))
