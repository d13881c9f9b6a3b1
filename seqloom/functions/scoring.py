"""Scores as projections: affinities, occupancies, combinations, linear models given as rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The scale of affinities in nM, the reach of amplitude, clipping of a logit.
MOST_NM, LEAST_NM, AMPLITUDE_NM, CLIP = 50_000.0, 1e-3, 3687.0, 60.0


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def affinity_to_unit(nm: str | Column) -> Column:
    """1 - ln(nM) / ln 50000 with nM clamped."""
    return 1 - F.ln(F.least(F.greatest(_c(nm), F.lit(LEAST_NM)), F.lit(MOST_NM))) / F.ln(F.lit(MOST_NM))


def unit_to_affinity(y: str | Column) -> Column:
    return F.pow(F.lit(MOST_NM), 1 - F.least(F.greatest(_c(y), F.lit(0.0)), F.lit(1.0)))


def amplitude(wild: str | Column, mutant: str | Column) -> Column:
    return (_c(wild) / _c(mutant)) / (1 + _c(wild) / AMPLITUDE_NM)


def agretopicity(wild: str | Column, mutant: str | Column) -> Column:
    return F.log10(_c(wild) / _c(mutant))


def occupancy(nm: str | Column, supply: float = 10.0) -> Column:
    """Part of the groove that is held at an affinity in nM; null where that is no number above 0."""
    a = supply / F.when((_c(nm) > 0) & ~F.isnan(_c(nm)), _c(nm))
    return a / (1 + a)


def occupancy_gain(mutant: str | Column, wild: str | Column) -> Column:
    """Of the mutant over the wild type; of the mutant alone where there is none."""
    return occupancy(mutant) - F.coalesce(occupancy(wild), F.lit(0.0))


def fisher(*p: str | Column, floor: float = 1e-9) -> Column:
    """-sum of ln p; null if any is."""
    total = F.lit(0.0)
    for x in p:
        total = total - F.ln(F.greatest(_c(x), F.lit(floor)))
    return F.when(sum((_c(x).isNull().cast("int") for x in p), F.lit(0)) == 0, total)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-CLIP)), F.lit(CLIP))))


def gate(z1: str | Column, z2: str | Column, a: float, b: float, c: float, d: float) -> Column:
    return sigmoid(a * _c(z1) + b) * sigmoid(c * _c(z2) + d)


def linear(df: DataFrame, model: Sequence[Mapping], *, intercept: float = 0.0, score: str = "score", imputed: str = "imputed") -> DataFrame:
    """df with the score of a standardised linear model, rows of feature, coef, mu, sigma; a null value counts as the mean and is named.

    A feature without a column is an error: an unmeasured feature is not the same as an unmeasured value.
    """
    absent = [m["feature"] for m in model if m["feature"] not in df.columns]
    if absent:
        raise ValueError(f"no column for {', '.join(absent)}")
    total = F.lit(float(intercept))
    for m in model:
        total = total + F.coalesce((F.col(m["feature"]) - m["mu"]) / m["sigma"], F.lit(0.0)) * m["coef"]
    names = F.array_compact(F.array(*(F.when(F.col(m["feature"]).isNull(), F.lit(m["feature"])) for m in model)))
    return df.withColumn(score, total).withColumn(imputed, F.array_join(names, ";"))


def recognition(counts: Mapping[int, str | Column], length: str | Column, *, a0: float, k: float) -> Column:
    """Z / (1 + Z) with Z the neighbours at each distance d weighed by exp(-k (a0 - (length - d)))."""
    z = F.lit(0.0)
    for d, n in counts.items():
        z = z + _c(n) * F.exp(F.least(F.greatest(-k * (a0 - (_c(length) - d)), F.lit(-CLIP)), F.lit(CLIP)))
    return z / (1 + z)
