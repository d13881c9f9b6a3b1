"""The k highest rows of every group, by radix selection: no group is ever sorted whole.

Histograms over some bits of the values at a time, from the highest down, find the range of values in which the k-th row of a
group lies. Where too many rows tie at one value, histograms over the bytes of the items go on, past the prefix that all of
them share. A group of any size is counted in parallel and pre-aggregated; what is sorted in the end is k rows and at most
FEW more of each group.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import Scratch

#: Bits of a value that are counted at a time; rows beyond k that a group may have when it is sorted.
DIGIT, FEW = 12, 4096


def _shared(a: Column, b: Column) -> Column:
    """The common prefix of two binary columns."""

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([os.path.commonprefix([p, q]) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.binary())

    return F.arrow_udf(run, "binary")(a, b)


def top_ranked(rows: DataFrame, keys: list[str], value: str, item: str, k: int, rank: str, *, few: int = FEW, digit: int = DIGIT) -> DataFrame:
    """rows (a stored table) up to rank k in each group, with that rank: by value falling, then by the UTF-8 bytes of item.

    keys are never null, values are whole numbers from 0, items are strings that repeat within a group only where it does not matter
    which of them stays. No rows give no rows.
    """
    scratch = Scratch(rows.sparkSession)
    group = Window.partitionBy(*keys)
    number = F.col(value).cast("bigint")
    bits = (F.ceil(F.length(F.bin(F.max(number))) / digit) * digit).cast("int")
    found = rows.groupBy(*keys).agg(F.count("*").alias("_n"), bits.alias("_shift")).select(*keys, F.lit(0).cast("bigint").alias("_low"), "_shift", F.lit(k).cast("bigint").alias("_need"), "_n")
    found = scratch.stored(found, "radix")
    is_open = (F.col("_n") > few + F.col("_need")) & (F.col("_shift") > 0)
    while found.where(is_open).limit(1).count():
        inside = rows.join(found.where(is_open), keys).where((number >= F.col("_low")) & (F.call_function("shiftright", number - F.col("_low"), F.col("_shift")) == 0))
        step = F.greatest(F.col("_shift") - digit, F.lit(0))
        counts = inside.groupBy(*keys, "_low", "_need", step.alias("_shift"), F.call_function("shiftright", number - F.col("_low"), step).alias("_digit")).agg(F.count("*").alias("_n"))
        upto = F.sum("_n").over(group.orderBy(F.desc("_digit")))
        chosen = counts.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_n") < F.col("_need")))
        after = chosen.select(*keys, (F.col("_low") + F.call_function("shiftleft", F.col("_digit"), F.col("_shift"))).alias("_low"), "_shift", (F.col("_need") - F.col("_upto") + F.col("_n")).alias("_need"), "_n")
        found = scratch.stored(found.where(~is_open).unionByName(after), "radix")
        scratch.drop(keep=1)
    # ties at one value: bytes of the items, of which those up to _edge stay; an empty edge keeps all
    text = F.encode(F.col(item), "UTF-8")
    head = F.substring(text, F.lit(1), F.octet_length("_edge"))
    found = scratch.stored(found.select("*", (F.col("_n") <= few + F.col("_need")).alias("_done"), F.lit(b"").alias("_edge")), "radix")
    scratch.drop(keep=1)
    while found.where("not _done").limit(1).count():
        inside = rows.join(found.where("not _done"), keys).where((number == F.col("_low")) & (head == F.col("_edge")))
        counts = inside.groupBy(*keys, "_low", "_need", "_shift", F.substring(text, F.octet_length("_edge") + 1, F.lit(1)).alias("_digit")).agg(F.count("*").alias("_n"), F.min(text).alias("_first"), F.max(text).alias("_last"))
        upto = F.sum("_n").over(group.orderBy("_digit"))
        chosen = counts.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_n") < F.col("_need")))
        need = F.col("_need") - F.col("_upto") + F.col("_n")
        after = chosen.select(*keys, "_low", "_shift", need.alias("_need"), "_n", ((F.col("_n") <= few + need) | (F.col("_first") == F.col("_last"))).alias("_done"), _shared(F.col("_first"), F.col("_last")).alias("_edge"))
        found = scratch.stored(found.where("_done").unionByName(after), "radix")
        scratch.drop(keep=1)
    stays = (number > F.col("_low")) | ((number == F.col("_low")) & (head <= F.col("_edge"))) | ((number == F.col("_low")) & (F.octet_length("_edge") == 0))
    near = rows.join(found.select(*keys, "_low", "_edge"), keys).where(stays).select(*rows.columns)
    return near.withColumn(rank, F.row_number().over(group.orderBy(F.desc(value), item))).where(F.col(rank) <= k)
