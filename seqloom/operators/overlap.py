"""Pairs of short strings that have some windows in common, met by their rarest windows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counters of the sketch of how many strings have a window; pairs that are compared at a time; windows beyond which a string meets by pairs of windows, and by single ones.
SKETCH, CHUNK, PAIRS_BEYOND, SINGLE_BEYOND = 1 << 18, 1 << 17, 30, 200
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _windows(s: str, k: int) -> list[str]:
    return list({s[i : i + k] for i in range(len(s) - k + 1)})


def _hash(w: str) -> int:
    b = w.encode()
    return crc32(b) | crc32(b[::-1], 0x5BD1E995) << 32


def _key(parts: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        out = (out ^ p) * _ODD[0]
        out = (out ^ (out >> np.uint64(29))) * _ODD[1]
    return (out ^ (out >> np.uint64(32))).view(np.int64)


def _ordered(words: list[str], k: int, seen: np.ndarray) -> list[list[tuple[int, str, int]]]:
    """The windows of each word, rare ones first: count, window, hash."""
    return [sorted((int(seen[h % SKETCH]), w, h) for w, h in ((w, _hash(w)) for w in _windows(s, k))) for s in words]


def _keys(df: DataFrame, k: int, least: int, size: int, seen) -> DataFrame:
    """key, s, q, r: every string once for each choice of `size` of its first windows. Of at least `least` common ones the first `size` are among these on either side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            per: dict[int, list[int]] = {}
            each = _ordered(b.column(0).to_pylist(), k, seen.value)
            for i, w in enumerate(each):
                if len(w) >= least:
                    per.setdefault(len(w), []).append(i)
            for n, of in per.items():
                h = np.array([[x[2] for x in each[i]] for i in of], np.uint64)
                for at in combinations(range(n - least + size), size):
                    yield pa.RecordBatch.from_arrays([pa.array(_key([h[:, j] for j in at])), *(b.column(c).take(pa.array(of)) for c in range(3))], names=["key", "s", "q", "r"])

    return df.mapInArrow(run, "key bigint, s string, q boolean, r boolean")


def _pairs(rows: DataFrame, k: int, least: int, size: int, seen) -> DataFrame:
    """query, ref, shared of rows that are sorted by key; a pair is made at the key of its first common windows only."""

    def compared(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, q, r = (t.column(c).to_numpy() for c in (0, 2, 3))
        s = t.column(1).combine_chunks()
        codes = s.dictionary_encode()
        words, of = codes.dictionary, codes.indices.to_numpy()
        each = _ordered(words.to_pylist(), k, seen.value)
        width, local = np.array([len(w) for w in each]), {}
        ids, h = np.full((len(each), width.max()), -1, np.int32), np.zeros((len(each), width.max()), np.uint64)
        for i, w in enumerate(each):
            ids[i, : len(w)], h[i, : len(w)] = [local.setdefault(x[1], len(local)) for x in w], [x[2] for x in w]
        group = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
        asks, gives = np.flatnonzero(q), np.flatnonzero(r)
        first, last = np.searchsorted(group[gives], group[asks]), np.searchsorted(group[gives], group[asks], "right")
        ends = np.cumsum(last - first)
        for lo in range(0, int(ends[-1]) if len(ends) else 0, CHUNK):
            at = np.arange(lo, min(lo + CHUNK, int(ends[-1])))
            row = np.searchsorted(ends, at, "right")
            a, b = asks[row], gives[last[row] - (ends[row] - at)]
            x, y = of[a], of[b]
            order = np.argsort(np.maximum(width[x], width[y]), kind="stable")
            for part in np.array_split(order, -(-len(order) // (CHUNK // 16))):
                i, j, m = x[part], y[part], int(max(width[x[part]].max(), width[y[part]].max()))
                mine, theirs = ids[i, :m], ids[j, :m]
                same = np.zeros(mine.shape, bool)
                for c in range(m):
                    same |= mine == theirs[:, c : c + 1]
                same &= mine >= 0
                n = same.sum(1)
                keep = np.flatnonzero(n >= least)
                place = np.cumsum(same[keep], 1)
                firsts = [(place == z + 1).argmax(1) for z in range(size)]
                keep = keep[_key([h[i[keep], z] for z in firsts]) == key[a[part[keep]]]] if len(keep) else keep
                if len(keep):
                    yield pa.RecordBatch.from_arrays([words.take(pa.array(i[keep])), words.take(pa.array(j[keep])), pa.array(n[keep].astype(np.int64))], names=["query", "ref", "shared"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            key = b.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if cut or key[0] != held[0].column(0)[0].as_py():
                t = pa.Table.from_batches(held)
                yield from compared(t.slice(0, t.num_rows - b.num_rows + cut))
                held = [b.slice(cut)]
        if held:
            yield from compared(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "query string, ref string, shared bigint")


def shared_kmers(queries: DataFrame, refs: DataFrame, k: int, least: int) -> DataFrame:
    """query, ref, shared: pairs that have at least `least` different windows of k letters in common; queries (query), refs (ref).

    Windows are ordered, those that few strings have first, by counts in a sketch of fixed size. Of `least` common windows the first
    three are among the first n - least + 3 of either string, so strings meet by choices of three of these (of fewer where `least` is
    less, or strings are long), and a pair is made at its own first three. The order affects speed only.
    """
    spark, least = queries.sparkSession, max(least, 1)
    side = lambda df, c, q: df.select(F.col(c).alias("s"), F.lit(q).alias("q"), F.lit(not q).alias("r"))
    both = side(queries, "query", True).unionByName(side(refs, "ref", False)).where(F.length("s") >= k + least - 1).groupBy("s").agg(F.max("q").alias("q"), F.max("r").alias("r"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, most = np.zeros(SKETCH, np.int64), 0
        for b in batches:
            for s in b.column(0).to_pylist():
                most = max(most, len(s) - k + 1)
                for w in _windows(s, k):
                    seen[_hash(w) % SKETCH] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[most, seen[at]])], names=["i", "n"])

    counted = both.select("s").mapInArrow(tally, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n"), F.max("n").alias("most")).toArrow()  # at most SKETCH rows and one
    i, n = counted["i"].to_numpy(), counted["n"].to_numpy()
    seen = np.zeros(SKETCH, np.int64)
    seen[i[i >= 0]] = n[i >= 0]
    most = max([0, *counted["most"].to_numpy()[i < 0].tolist()])
    size = min(least, 3 if most <= PAIRS_BEYOND else 2 if most <= SINGLE_BEYOND else 1)
    shared = spark.sparkContext.broadcast(seen)
    met = _keys(both, k, least, size, shared).repartition("key").sortWithinPartitions("key")
    return _pairs(met, k, least, size, shared)
