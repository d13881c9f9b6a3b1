"""Groups of texts that share a long window of letters, without a row for each window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators import density
from seqloom.operators.rounds import Rounds
from seqloom.operators.tiling import letters_of, rolled, slices, strings_of

#: Letters of a seed; windows of a piece at most; one piece of so many is looked at first; bits of the map of shared seeds; pieces that are held before equal ones are put together.
SEED, MOST, FIRST, BITS, HELD = 20, 64, 16, 27, 1 << 20


def _least(h: np.ndarray, n: int) -> np.ndarray:
    width = 1
    while 2 * width <= n:
        h, width = np.minimum(h[: len(h) - width], h[width:]), 2 * width
    return np.minimum(h[: len(h) - (n - width)], h[n - width :])


def _pieces(texts: pa.Array, window: int) -> tuple[np.ndarray, ...]:
    """row, code, start, length, letters: the windows of each text in pieces, each of windows in a row that have one least seed."""
    row, place = letters_of(texts)
    m = len(row) - window + 1
    if m <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none, place
    low = _least(rolled(place, SEED), window - SEED + 1)
    at = np.flatnonzero(row[:m] == row[window - 1 :])
    low = low[at]
    begin = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (low[1:] != low[:-1])][: len(at)])
    parts = -(-np.diff(np.r_[begin, len(at)]) // MOST)
    begin = np.repeat(begin, parts) + MOST * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    start = at[begin]
    return row[start], low[begin].view(np.int64), start, np.diff(np.r_[begin, len(at)]) + window - 1, place


def _together(group: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of every group: its first row, least and greatest label; and the distinct (least, other) labels of groups."""
    order = np.argsort(group, kind="stable")
    g, x = group[order], label[order]
    new = np.r_[True, g[1:] != g[:-1]][: len(g)]
    begin = np.flatnonzero(new)
    if not len(begin):
        return begin, label[:0], label[:0], np.zeros((0, 2), np.int64)
    low, high = np.minimum.reduceat(x, begin), np.maximum.reduceat(x, begin)
    own = np.repeat(low, np.diff(np.r_[begin, len(g)]))
    pairs = np.stack([own, x], 1)[own < x]
    return order[begin], low, high, np.unique(pairs, axis=0)


def _run(df: DataFrame, window: int, *, whole: bool, wanted) -> DataFrame:
    """df: label, text. whole: code, piece, a of every distinct piece that a task has and that is wanted, a its least label there, and rows without a piece that tie labels b to a; else code, a, b of its labels."""

    def made(parts: list) -> pa.RecordBatch:
        code, label = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        if not whole:
            first, low, high, _ = _together(code, label)
            return pa.RecordBatch.from_arrays([pa.array(code[first]), pa.array(low), pa.array(high)], names=["code", "a", "b"])
        text = pa.concat_arrays([p[2] for p in parts])
        first, low, _, ties = _together(text.dictionary_encode().indices.to_numpy(), label)
        n, none = len(first), len(ties)
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([pa.array(code[first]), pa.nulls(none, pa.int64())]),
                pa.concat_arrays([text.take(pa.array(first)).cast(pa.string()), pa.nulls(none, pa.string())]),
                pa.array(np.r_[low, ties[:, 0]]),
                pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(ties[:, 1])]),
            ],
            names=["code", "piece", "a", "b"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            labels, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).cast(pa.large_string()).fill_null("")
            for lo, hi in slices(texts):
                row, code, start, length, place = _pieces(texts.slice(lo, hi - lo), window)
                keep = np.flatnonzero(wanted(code)) if whole else np.arange(len(code))
                label = labels[lo:hi][row[keep]]
                parts.append((code[keep], label, strings_of(place, start[keep], length[keep])) if whole else (code, label))
                held += len(keep)
                if held >= HELD:
                    yield made(parts)
                    parts, held = [], 0
        if held:
            yield made(parts)

    return df.mapInArrow(run, "code bigint, piece string, a bigint, b bigint" if whole else "code bigint, a bigint, b bigint")


def _ties(pieces: DataFrame) -> DataFrame:
    return pieces.where("piece IS NULL").select("a", "b")


def components(df: DataFrame, id_col: str, text: str, window: int) -> DataFrame:
    """id, component: the least id (bigint) that each reaches over texts that share a window of letters, case ignored.

    The windows of a text that have one least seed (20 letters) are one piece, so that equal windows are in pieces of one seed. A sample
    of pieces ties copies first. Of the groups that these form only seeds of two groups and more matter: a map of bits, of fixed
    size, names them, and their pieces alone are cut into windows, which meet as text. Where the map fills up, all pieces travel.
    """
    spark = df.sparkSession
    kept = Rounds(spark, "loci")
    d = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text"))
    some = d.where("id IS NOT NULL")
    sample = kept.kept(_run(some, window, whole=True, wanted=lambda code: code % FIRST == 0))
    whole = sample.where("piece IS NOT NULL").select("piece", "a")
    shared = whole.groupBy("piece").agg(F.min("a").alias("_a"), F.max("a").alias("_z")).where("_a < _z")
    edges = whole.join(shared.select("piece", "_a"), "piece").where("_a < a").select(F.col("_a").alias("a"), F.col("a").alias("b"))
    groups = kept.kept(density.connected(edges.unionByName(_ties(sample)).distinct(), d.select("id")))
    grouped = kept.kept(some.join(groups.where("id IS NOT NULL"), "id").select("component", "text"))
    seeds = _run(grouped, window, whole=False, wanted=None).groupBy("code").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a < b")
    place = F.col("code").bitwiseAND(F.lit((1 << BITS) - 1))
    words = seeds.select(place.alias("p")).groupBy(F.expr("p div 64").alias("i")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("w")).toArrow()  # at most 2^21 rows
    bits = np.zeros(1 << (BITS - 6), np.int64)
    bits[words["i"].to_numpy()] = words["w"].to_numpy()
    map_ = spark.sparkContext.broadcast(bits)

    def named(code: np.ndarray) -> np.ndarray:
        p = code & ((1 << BITS) - 1)
        return (map_.value[p >> 6] >> (p & 63)) & 1 == 1

    rest = kept.kept(_run(grouped, window, whole=True, wanted=named))
    each = rest.where("piece IS NOT NULL").select("code", "piece", "a").repartition("code")
    cut = each.select("code", "a", F.explode(F.transform(F.sequence(F.lit(1), F.length("piece") - (window - 1)), lambda i: F.substring(F.col("piece"), i, F.lit(window)))).alias("w"))
    met = cut.withColumn("_a", F.min("a").over(Window.partitionBy("code", "w"))).where("_a < a").select(F.col("_a").alias("a"), F.col("a").alias("b"))
    last = density.connected(met.unionByName(_ties(rest)).distinct(), groups.where("id IS NOT NULL").select(F.col("component").alias("id")))
    found = groups.join(last.select(F.col("id").alias("component"), F.col("component").alias("_to")), "component", "left")
    return found.select("id", F.col("_to").alias("component"))
