"""The rarest windows of each text, without a row for each window of each text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.operators import tiling
from seqloom.operators.ranking import top
from seqloom.operators.rounds import Rounds

#: Rows that a task adds up before it gives them on; codes of the most frequent windows that every task knows; bits of the map of ids.
HELD, KNOWN, BITS = 1 << 20, 1 << 20, 24
_CODE = (1 << 39) - 1


def _starts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)


def _tally(texts: pa.Array, group: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """code (group << 39 | window), n, texts, first, row: of each window of each group its occurrences, its texts, and its first place."""
    row, at, code = tiling._codes(texts, k)
    code |= group[row[at]] << 39
    order = np.argsort(code, kind="stable")  # of equal ones by text and offset
    code, at = code[order], at[order]
    of, start = row[at], _starts(code)
    if not len(start):
        return (start,) * 5
    new = np.r_[True, (code[1:] != code[:-1]) | (of[1:] != of[:-1])]
    mine = of[start]
    first = at[start] - np.searchsorted(row, np.arange(len(texts)))[mine]
    return code[start], np.diff(np.r_[start, len(code)]), np.add.reduceat(new.astype(np.int64), start), first, mine


def tallies(df: DataFrame, key: str, group: str, text: str, k: int) -> DataFrame:
    """code, group, n, texts, key, first: occurrences of windows of k standard residues among the letters of the texts of a group, and rows of df that have them, as far as a task has added them up.

    A row of one occurrence has the key of its text and its zero-based offset, in others both are null. What a task cannot hold goes on,
    single occurrences first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict = {}
        held: list[list] = []  # group << 39 | code, n, texts, first, keys

        def added() -> list:
            code = np.concatenate([h[0] for h in held])
            order = np.argsort(code, kind="stable")
            code = code[order]
            at = _starts(code)
            n, texts = (np.add.reduceat(np.concatenate([h[i] for h in held])[order], at) for i in (1, 2))
            return [code[at], n, texts, np.concatenate([h[3] for h in held])[order[at]], pa.concat_arrays([h[4] for h in held]).take(pa.array(order[at]))]

        def out(h: list) -> pa.RecordBatch:
            code, n, texts, first, keys = h
            many = n > 1
            named = pa.array(list(groups), type_of).take(pa.array(code >> 39))
            none = pa.scalar(None, keys.type)
            return pa.RecordBatch.from_arrays([pa.array(code & _CODE), named, pa.array(n), pa.array(texts), pc.if_else(pa.array(many), none, keys), pa.array(first, mask=many)], names=["code", group, "n", "texts", key, "first"])

        def some(h: list, which: np.ndarray) -> list:
            return [*(x[which] for x in h[:4]), h[4].filter(pa.array(which))]

        for b in batches:
            type_of = b.column(1).type
            own = np.array([groups.setdefault(g, len(groups)) for g in b.column(1).to_pylist()], np.int64)
            texts = b.column(2).cast(pa.large_string()).fill_null("")
            for a, z in tiling.slices(texts):
                code, n, has, first, of = _tally(texts.slice(a, z - a), own[a:z], k)
                if not len(code):
                    continue
                held.append([code, n, has, first, b.column(0).take(pa.array(of + a))])
                if sum(len(h[0]) for h in held) >= HELD:
                    whole = added()
                    single = whole[1] == 1
                    held = []
                    if 2 * np.count_nonzero(~single) >= HELD or len(groups) > 1 << 20:
                        yield out(whole)
                        continue
                    if 2 * len(single) >= HELD:
                        yield out(some(whole, single))
                        whole = some(whole, ~single)
                    held = [whole]
            if len(groups) > 1 << 20:
                if held:
                    yield out(added())
                groups, held = {}, []
        if held:
            yield out(added())

    kind = lambda c: df.schema[c].dataType.simpleString()
    return df.select(key, group, text).mapInArrow(run, f"code bigint, `{group}` {kind(group)}, n bigint, texts bigint, `{key}` {kind(key)}, first bigint")


def _open(df: DataFrame, key: str, group: str, text: str, k: int, most: int, bits: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """key, group, code, first, n_corpus: the distinct windows of the texts whose place the map has; of the most frequent, known ones only the first, and only where a text has fewer than `most` others. n_corpus is null where it is not known."""
    given = df.sparkSession.sparkContext.broadcast((bits, *known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        map_, codes, counts = given.value
        for b in batches:
            p = b.column(3).to_numpy()
            b = b.filter(pa.array((map_[p >> 6] >> (p & 63)) & 1 == 1))
            texts = b.column(2).cast(pa.large_string()).fill_null("")
            for a, z in tiling.slices(texts):
                of, code, _, first = tiling._packed(texts.slice(a, z - a), k)
                n = np.zeros(len(code), np.int64)
                if len(codes):
                    at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                    n = np.where(codes[at] == code, counts[at], 0)
                few = np.bincount(of[n == 0], minlength=z - a) < most
                often = np.flatnonzero((n > 0) & few[of])
                often = often[np.lexsort((code[often], n[often], of[often]))]
                place = np.arange(len(often)) - np.searchsorted(of[often], of[often])
                took = np.r_[np.flatnonzero(n == 0), often[place < most]]
                own = pa.array(of[took] + a)
                yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(1).take(own), pa.array(code[took]), pa.array(first[took].astype(np.int64)), pa.array(n[took], mask=n[took] == 0)], names=[key, group, "code", "first", "n_corpus"])

    kind = lambda c: df.schema[c].dataType.simpleString()
    placed = df.select(key, group, text, F.pmod(F.xxhash64(key), F.lit(1 << BITS)).alias("_p"))
    return placed.mapInArrow(run, f"`{key}` {kind(key)}, `{group}` {kind(group)}, code bigint, first bigint, n_corpus bigint")


def rarest(spark: SparkSession, df: DataFrame, key: str, group: str, text: str, k: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Of each key the first `most` windows of k standard residues by how often they occur in all texts, then by code: key, group, code, first, n_corpus. And the background of each group: group, n_corpus, texts (pairs of a text and one of its windows).

    Tasks add up windows, and a window that occurs once brings the key of its text along, so a text that has enough of these is done. Windows of
    the others are counted by a join, but for the KNOWN most frequent, which are in every task: they matter only where a text has hardly any
    others. A map of bits, of fixed size, names texts that are not done; what it lets through by chance gets the same rows.
    """
    kept = Rounds(spark, "rarest")
    # one shuffle: what is dealt by the code is also dealt by code and group
    by_group = tallies(df, key, group, text, k).repartition("code").groupBy("code", group).agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"), F.min(key).alias(key), F.min("first").alias("first"))
    seen = kept.kept(by_group.select("code", group, F.sum("n").over(Window.partitionBy("code")).alias("n_corpus"), "texts", key, "first"))
    single = seen.where("n_corpus = 1").select(key, group, "code", "first", "n_corpus")
    # numbers of occurrences differ in no more than the root of twice all windows
    sizes = seen.where("n_corpus > 1").groupBy("n_corpus").agg(F.count("*").alias("c")).withColumn("c", F.sum("c").over(Window.orderBy(F.desc("n_corpus"))))
    least = sizes.where(F.col("c") <= KNOWN).agg(F.min("n_corpus")).first()[0]
    often = F.lit(False) if least is None else F.col("n_corpus") >= least
    known = seen.where(often).select("code", "n_corpus").distinct().orderBy("code").toArrow()  # at most KNOWN rows
    done = single.groupBy(key).agg(F.count("*").alias("c")).where(F.col("c") >= most)
    bits = tiling.bit_map(df.select(key).join(done, key, "left_anti").select(F.pmod(F.xxhash64(key), F.lit(1 << BITS)).alias("p")), BITS)
    rest = kept.kept(_open(df, key, group, text, k, most, bits, (known["code"].to_numpy(), known["n_corpus"].to_numpy())))
    counted = seen.where((F.col("n_corpus") > 1) & ~often).select("code", "n_corpus").distinct()
    rows = single.unionByName(rest.where("n_corpus IS NOT NULL")).unionByName(rest.where("n_corpus IS NULL").drop("n_corpus").join(counted, "code"))
    back = kept.kept(seen.groupBy(group, "n_corpus").agg(F.sum("texts").alias("texts")))
    first = kept.kept(top(rows, [key], [F.asc("n_corpus"), F.asc("code")], most))
    kept.drop(keep=2)
    return first, back
