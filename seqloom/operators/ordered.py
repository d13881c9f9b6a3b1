"""Running aggregates over an order, by ranges of values, so that neither a whole table nor a hot key goes through one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What joins an aggregate of the ranges before to that of the rows before within the range.
_JOINED = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "max": lambda a, b: F.greatest(a, b),
}
_AGGREGATES = {"sum": F.sum, "max": F.max}


def attach(df: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with the columns of facts, which has one row for each of the keys; null keys are equal. A key without facts loses its rows."""
    rest = [c for c in facts.columns if c not in keys]
    other = facts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *rest)
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(other, on).select(*df.columns, *rest)


def ranged(df: DataFrame, value: str, of: DataFrame | None = None) -> DataFrame:
    """df with the range of each value, rising with it, as many as there are shuffle partitions.

    Bounds are quantiles of the whole column, to 0.2 %, and come to the driver as one number for each range; as literals
    they give a row the same range wherever it is computed. Where df is another frame with more columns, `of` is that frame,
    whose bounds are cheaper. Nulls are in the first range, NaN in the last one.
    """
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x = F.col(value).cast("double")
    bounds = sorted(set((df if of is None else of).select(x.alias("x")).approxQuantile("x", [i / n for i in range(1, n)], 0.002)))
    return df.withColumn("_range", F.when(x.isNull(), 0).otherwise(_below(x, bounds, 0)))


def _below(x: Column, bounds: list[float], base: int) -> Column:
    """base and the number of bounds that are at most x, by halving: as many comparisons as the number of bounds has bits."""
    if not bounds:
        return F.lit(base)
    mid = len(bounds) // 2
    return F.when(x >= bounds[mid], _below(x, bounds[mid + 1 :], base + mid + 1)).otherwise(_below(x, bounds[:mid], base))


def before(df: DataFrame, value: str, wanted: Mapping[str, tuple[str, str]], keys: Sequence[str] = (), *, ties: Sequence[str] = (), falling: bool = False, of: DataFrame | None = None) -> DataFrame:
    """df with, for each name of wanted, (sum or max, column) over the rows of its keys that come before: null or 0 for the first.

    Order is by value, then by ties, which have to be total together. A range has one summary row for each key; those of a
    key go through one window, the rows through one for each key and range. Many equal values stay in one range.
    """
    side = (lambda c: F.col(c).desc_nulls_last()) if falling else (lambda c: F.col(c).asc_nulls_first())
    rows = ranged(df, value, of)
    past = Window.unboundedPreceding, -1
    inside = Window.partitionBy(*keys, "_range").orderBy(side(value), *ties).rowsBetween(*past)
    over = Window.partitionBy(*keys).orderBy(side("_range")).rowsBetween(*past)
    each = rows.groupBy(*keys, "_range").agg(*(_AGGREGATES[how](c).alias(name) for name, (how, c) in wanted.items()))
    carried = each.select(*keys, "_range", *(_AGGREGATES[how](name).over(over).alias(f"_c_{name}") for name, (how, _) in wanted.items()))
    local = rows.select("*", *(_AGGREGATES[how](c).over(inside).alias(f"_l_{name}") for name, (how, c) in wanted.items()))
    return attach(local, carried, [*keys, "_range"]).select(*df.columns, *(_JOINED[how](F.col(f"_c_{name}"), F.col(f"_l_{name}")).alias(name) for name, (how, _) in wanted.items()))


def neighbouring(df: DataFrame, value: str, keys: Sequence[str], ties: Sequence[str], of: DataFrame | None = None) -> DataFrame:
    """df with _before and _after, the value of the row before and after in its keys' order by value and ties; null at the ends."""
    rows = ranged(df, value, of)
    w = Window.partitionBy(*keys, "_range").orderBy(F.col(value).asc_nulls_first(), *ties)
    x = F.struct(F.col(value).alias("v"))  # a null value is not the end of the order
    ends = rows.groupBy(*keys, "_range").agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count_if(F.col(value).isNull()).alias("nulls"))
    over = Window.partitionBy(*keys).orderBy("_range")
    first = F.struct(F.when(F.col("nulls") == 0, F.col("lo")).alias("v"))
    last = F.struct(F.col("hi").alias("v"))
    edges = ends.select(*keys, "_range", F.lag(last).over(over).alias("_prior"), F.lead(first).over(over).alias("_next"))
    local = attach(rows.select("*", F.lag(x).over(w).alias("_lag"), F.lead(x).over(w).alias("_lead")), edges, [*keys, "_range"])
    return local.select(*df.columns, F.coalesce("_lag", "_prior")["v"].alias("_before"), F.coalesce("_lead", "_next")["v"].alias("_after"))

