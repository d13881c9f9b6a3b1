"""Scores against empirical backgrounds: percent ranks, step calibration, bands, false discovery."""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.operators import ordered


def percent_rank(queries: DataFrame, background: DataFrame, keys: Sequence[str], score: str = "score", *, weight: str | None = None) -> DataFrame:
    """queries with pct_rank: 100 times the part of the background of its keys that is strictly greater; null without background. weight: how many rows one of the background stands for.

    Distinct scores of both sides are counted first, and the counts run by ranges of scores, so that any number of rows is
    served and no task holds a key.
    """
    n = F.sum(F.col(weight).cast("bigint")) if weight else F.count("*")
    known = background.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(n.alias("_b"))
    asked = queries.where(F.col(score).isNotNull()).select(*keys, score).distinct().withColumn("_b", F.lit(0).cast("bigint"))
    both = known.unionByName(asked).groupBy(*keys, score).agg(F.sum("_b").alias("_b"))
    totals = both.groupBy(*keys).agg(F.nullif(F.sum("_b"), F.lit(0)).alias("_t"))
    ranked = ordered.attach(ordered.before(both, score, {"_above": ("sum", "_b")}, keys, falling=True, of=known), totals, keys)
    ranks = ranked.select(*keys, score, (100.0 * F.coalesce("_above", F.lit(0)) / F.col("_t")).alias("pct_rank"))
    return queries.join(ranks, [*keys, score], "left")


def band(rank: str | Column, strong: float = 0.5, weak: float = 2.0) -> Column:
    r = F.col(rank) if isinstance(rank, str) else rank
    return F.when(r <= strong, "strong").when(r <= weak, "weak").otherwise("none")


def bh_cut(df: DataFrame, p: str, alpha: float, keys: Sequence[str] = ()) -> DataFrame:
    """df with bh_cut, the largest p with p <= rank / m * alpha (0 if none), and significant.

    Equal p share the highest rank. Distinct p are counted and ranked by ranges, so that neither all p nor those of a hot
    key go through one task.
    """
    counted = df.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count("*").alias("_c"))
    ranked = ordered.attach(ordered.before(counted, p, {"_r": ("sum", "_c")}, keys), counted.groupBy(*keys).agg(F.sum("_c").alias("_m")), keys)
    passes = F.col(p) <= (F.col("_r") + F.col("_c")) / F.col("_m") * alpha
    cut = ranked.groupBy(*keys).agg(F.coalesce(F.max(F.when(passes, F.col(p))), F.lit(0.0)).alias("bh_cut"))
    out = df.join(cut, list(keys)) if keys else df.join(F.broadcast(cut))  # one row
    return out.withColumn("significant", (F.col(p) <= F.col("bh_cut")) & (F.col("bh_cut") > 0))


def bonferroni(df: DataFrame, p: str, alpha: float) -> DataFrame:
    m = df.where(F.col(p).isNotNull()).agg(F.count("*").alias("_m"))
    return df.join(F.broadcast(m)).withColumn("significant", F.col(p) * F.col("_m") <= alpha).drop("_m")  # one row


def isotonic_steps(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, steps array<struct<x, y>>: pool-adjacent-violators of y, rising in x, each block by its first x. Equal x are summed before they leave their tasks."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return isotonic_counts(known, x, F.col(y).cast("double"), F.lit(1.0), keys)


def _pooled(rows: pd.DataFrame) -> list[list[float]]:
    """Blocks (first x, sum, n) of rows x, s, n."""
    stack: list[list[float]] = []
    for at, s, n in rows.sort_values("x")[["x", "s", "n"]].itertuples(index=False, name=None):
        stack.append([at, s, n])
        while len(stack) > 1 and stack[-2][1] * stack[-1][2] >= stack[-1][1] * stack[-2][2]:
            _, s2, n2 = stack.pop()
            stack[-1][1] += s2
            stack[-1][2] += n2
    return stack


def isotonic_counts(df: DataFrame, x: str, total: Column, n: Column, keys: Sequence[str] = ()) -> DataFrame:
    """keys, steps array<struct<x, y>>: isotonic fit of total / n, rising in x, each block by its first x.

    Every range of values of a key is pooled by itself, and then the blocks of its ranges are, which gives the fit of all: a block
    that is pooled within a range stays one. A task holds the points of one range, or the blocks of a key, which are its result.
    """
    summed = df.groupBy(*keys, F.col(x).cast("double").alias("x")).agg(F.sum(total).cast("double").alias("s"), F.sum(n).cast("double").alias("n")).where("n > 0")
    types = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), *block] for block in _pooled(pdf)], columns=[*keys, "x", "s", "n"])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), [{"x": a, "y": s / n} for a, s, n in _pooled(pdf)]]], columns=[*keys, "steps"])

    blocks = ordered.ranged(summed, "x").groupBy(*keys, "_range").applyInPandas(part, f"{types}x double, s double, n double")
    return blocks.withColumn("_k", F.lit(0)).groupBy(*keys, "_k").applyInPandas(whole, f"{types}steps array<struct<x: double, y: double>>")


def step_value(steps: Column, x: Column) -> Column:
    """y of the last step that begins at or below x; of the first one below all."""
    below = F.filter(steps, lambda s: s["x"] <= x)
    return F.coalesce(F.get(below, F.size(below) - 1)["y"], F.get(steps, F.lit(0))["y"])


def random_peptides(spark: SparkSession, n: int, lengths: Sequence[int], weights: dict[str, float], seed: int) -> DataFrame:
    """pep: n strings drawn on the driver by a seeded generator, the same on every run; n is the calibration's own parameter."""
    draw = random.Random(seed)
    letters, w = zip(*sorted(weights.items()), strict=True)
    return spark.createDataFrame([("".join(draw.choices(letters, w, k=draw.choice(list(lengths)))),) for _ in range(n)], "pep string")


def prevalence_shift(df: DataFrame, score: str, prevalence: float, tolerance: float = 1e-10) -> float:
    """b with mean sigmoid(score + b) equal to the prevalence, by bisection on a histogram of scores that bounds the mean; then exact means."""
    lo, hi = -60.0, 60.0
    s = df.select(F.col(score).alias("s")).where("s IS NOT NULL").groupBy("s").agg(F.count("*").alias("n"))
    few = s.limit(100_001).toPandas() if s.limit(100_001).count() <= 100_000 else None
    mean = (lambda b: float(np.average(1 / (1 + np.exp(-np.clip(few.s + b, -60, 60))), weights=few.n))) if few is not None else (lambda b: s.agg((F.sum(F.col("n") / (1 + F.exp(-F.least(F.greatest(F.col("s") + b, F.lit(-60.0)), F.lit(60.0))))) / F.sum("n")).alias("m")).first().m)
    while hi - lo > tolerance:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mean(mid) < prevalence else (lo, mid)
    return (lo + hi) / 2
