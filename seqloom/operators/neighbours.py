"""Similarity joins of short strings: few substitutions, shared k-mers, shared anchors."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import sequences as S
from seqloom.operators import tiling
from seqloom.operators.overlap import shared_kmers  # noqa: F401  its first place
from seqloom.operators.rounds import Rounds


def hamming(a: Column, b: Column) -> Column:
    """Differing places of two strings of one length."""
    return F.size(F.filter(F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y")), lambda p: p["x"] != p["y"]))


#: Strings of at most so many letters meet by masks rather than by pieces, where the pieces would be shorter than three letters.
MASKED = 8


def _segments(pep: Column, d: int) -> Column:
    """Keys of a string, with their numbers: strings of one length within d substitutions have one in common.

    Long strings have d + 1 even pieces. Of short ones, whose pieces nearly all strings would share, keys are the letters beside every
    choice of d places, numbered by the places as bits: what meets there is within d.
    """
    n = F.length(pep)
    cut = lambda i: F.floor(n * i / (d + 1)).cast("int")
    out = F.array(*(F.struct(F.lit(i).alias("no"), F.substring(pep, cut(i) + 1, cut(i + 1) - cut(i)).alias("piece")) for i in range(d + 1)))
    for size in range(_short(d) + 1):
        masks = [set(m) for m in combinations(range(size), min(d, size))]
        keys = F.array(*(F.struct(F.lit(sum(1 << i for i in m)).alias("no"), F.concat(F.lit(""), *(F.substring(pep, i + 1, 1) for i in range(size) if i not in m)).alias("piece")) for m in masks))
        out = F.when(n == size, keys).otherwise(out)
    return out


def _short(d: int) -> int:
    return min(MASKED, 3 * (d + 1) - 1) if d else -1


def _own_mask(n: Column, differ: Column, d: int) -> Column:
    """The one mask of d places at which a pair that differs at the given places is made: these, and the last of the others."""
    rest = F.filter(F.sequence(n - 1, F.lit(0), F.lit(-1)), lambda i: ~F.array_contains(differ, i))
    places = F.concat(differ, F.slice(rest, 1, F.greatest(d - F.size(differ), F.lit(0))))
    return F.when(n > 0, F.aggregate(places, F.lit(0), lambda acc, i: acc + F.pow(F.lit(2), i).cast("int"))).otherwise(0)


def hamming_join(left: DataFrame, right: DataFrame, d: int, *, a: str = "query", b: str = "ref", least: int = 0) -> DataFrame:
    """a, b, dist: distinct pairs of one length within d substitutions, found by a piece or a mask that they share.

    Both sides are made distinct first. A pair that shares several is made once, at the first piece or at its own mask, so no
    distinct over pairs is needed.
    """
    cut = lambda df, name: df.select(name).where(F.col(name).isNotNull()).distinct().select(name, F.length(name).alias("_len"), F.explode(_segments(F.col(name), d)).alias("_s")).select(name, "_len", F.col("_s.no").alias("_no"), F.col("_s.piece").alias("_piece"))
    pairs = cut(left, a).join(cut(right, b), ["_len", "_no", "_piece"])
    first, n = F.lit(True), F.col("_len")
    for i in range(d):
        lo, hi = F.floor(n * i / (d + 1)).cast("int"), F.floor(n * (i + 1) / (d + 1)).cast("int")
        same = F.substring(F.col(a), lo + 1, hi - lo) == F.substring(F.col(b), lo + 1, hi - lo)
        first = first & ((F.col("_no") <= i) | ~same)
    if d == 0:
        return pairs.select(a, b, F.lit(0).alias("dist")).where(F.lit(least <= 0))
    each = F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y"))
    differ = F.filter(F.transform(each, lambda p, i: F.when(p["x"] != p["y"], i)), lambda i: i.isNotNull())
    pairs = pairs.where((n <= _short(d)) | first).withColumn("_d", differ).where((n > _short(d)) | (F.col("_no") == _own_mask(n, F.col("_d"), d)))
    return pairs.select(a, b, F.size("_d").alias("dist")).where(F.col("dist").between(least, d))


def nearest(queries: DataFrame, refs: DataFrame, d: int, *, a: str = "query", b: str = "ref", least: int = 0) -> DataFrame:
    """Each query with its least distance (d + 1 without any), the first nearest reference in order, and the number within d; least=1 leaves out equal ones."""
    found = hamming_join(queries, refs, d, a=a, b=b, least=least).groupBy(a).agg(F.min(F.struct("dist", b)).alias("_m"), F.count("*").alias("n_within"))
    return queries.select(a).distinct().join(found, a, "left").select(a, F.coalesce("_m.dist", F.lit(d + 1)).alias("dist"), F.col(f"_m.{b}").alias("nearest"), F.coalesce("n_within", F.lit(0)).alias("n_within"))


def counts_by_distance(pairs: DataFrame, key: str, most: int) -> DataFrame:
    """key and n0 … n_most: pairs at each distance."""
    return pairs.groupBy(key).agg(*(F.count_if(F.col("dist") == i).alias(f"n{i}") for i in range(most + 1)))


#: Longest strings whose masks are written as rows.
COUNTED = 12


def _masked(each: DataFrame, pep: str, d: int) -> DataFrame:
    """pep, _n, k, no, key: the letters beside every mask of 1 to d places of every string of up to COUNTED letters. A row for each: `neighbour_counts` does the same in units.

    Masks are a table, of at most d + 1 runs of letters each: as one expression for all lengths they are too long to be compiled.
    """
    masks = []
    for size in range(1, COUNTED + 1):
        for m in (m for k in range(1, min(d, size) + 1) for m in combinations(range(size), k)):
            ends = [-1, *m, size]
            runs = [(a + 2, b - a - 1) for a, b in zip(ends, ends[1:], strict=False)]
            runs += [(1, 0)] * (d + 1 - len(runs))
            masks.append((size, len(m), sum(1 << i for i in m), *(x for r in runs for x in r)))
    table = each.sparkSession.createDataFrame(masks, "_n int, k int, no int, " + ", ".join(f"_s{i} int, _l{i} int" for i in range(d + 1)))
    met = each.select(pep, F.length(pep).alias("_n")).join(F.broadcast(table), "_n")  # of a fixed size
    return met.select(pep, "_n", "k", "no", F.concat(*(F.substring(F.col(pep), F.col(f"_s{i}"), F.col(f"_l{i}")) for i in range(d + 1))).alias("key"))


#: Letters of a unit of `neighbour_counts`, about; longest strings that meet by masks there: longer ones have too many, and few share two pieces; letters of pairs that are compared at a time.
LETTERS, LONG, COMPARED = 1 << 21, 32, 1 << 22


def _letters(words: pa.LargeStringArray, n: int) -> np.ndarray:
    """The letters of strings of n letters, a row for each place, as differences from the least."""
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    text = words.buffers()[2][int(ends[0]) : int(ends[-1])].to_pybytes().decode()
    x = np.ascontiguousarray(np.frombuffer(text.encode("utf-32-le"), "<u4").reshape(-1, n).T)
    return x - x.min()


def _coded(code: np.ndarray, letters: np.ndarray, width: int) -> np.ndarray:
    """Numbers that are equal where the codes and all letters, of `width` bits, are."""
    bits = int(code.max()).bit_length()
    for x in letters:
        if bits + width > 63:
            code = np.unique(code, return_inverse=True)[1]
            bits = len(code).bit_length()
        code = (code << width) | x
        bits += width
    return code


def _by_masks(x: np.ndarray, own: np.ndarray, ends: list[int], whole: tuple[int, int], d: int) -> np.ndarray:
    """S_1 to S_d of strings that share two pieces with those of the same `own`, over the masks whose first whole pieces these are."""
    out, width = np.zeros((len(own), d), np.int64), int(x.max()).bit_length()
    of = [bisect_right(ends, i) for i in range(len(x))]
    rest = [i for i in range(len(x)) if of[i] not in whole]
    for m in (m for k in range(1, d + 1) for m in combinations(rest, k)):
        cut = {of[i] for i in m}
        if all(p in cut or p in whole for p in range(whole[1])):
            _, at, n = np.unique(_coded(own, x[[i for i in rest if i not in m]], width), return_inverse=True, return_counts=True)
            out[:, len(m) - 1] += n[at] - 1
    return out


def _by_pairs(x: np.ndarray, own: np.ndarray, ends: list[int], whole: tuple[int, int], d: int) -> np.ndarray:
    """As `_by_masks`, but that a pair adds to all sums where the pieces are the first whole ones of the places at which it differs."""
    out, size = np.zeros((len(own), d), np.int64), max(1, COMPARED // len(x))
    order = np.argsort(own, kind="stable")
    own, start = own[order], [0, *ends]
    for step in range(1, int(np.bincount(own).max())):
        same = np.flatnonzero(own[step:] == own[:-step])
        for at in (same[i : i + size] for i in range(0, len(same), size)):
            left, right = order[at], order[at + step]
            differ = x[:, left] != x[:, right]
            n, here = differ.sum(0), np.ones(len(at), bool)
            for p in range(whole[1]):
                if p not in whole:
                    here &= differ[start[p] : ends[p]].any(0)
            for j in range(1, d + 1):
                near = here & (n == j)
                for k in range(j, d + 1):
                    for side in (left, right):
                        np.add.at(out[:, k - 1], side[near], comb(len(x) - j, k - j))
    return out


def _sums(words: pa.LargeStringArray, no: np.ndarray, d: int) -> np.ndarray:
    """S_1 to S_d of each string over the masks of its pieces, no: a (d + 2) + b. Strings of one length that share pieces a and b are all here."""
    out, m = np.zeros((len(words), d), np.int64), d + 2
    size = pc.utf8_length(words).to_numpy()
    key = size * m * m + no
    order = np.argsort(key, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0, True])
    for at in (order[i:j] for i, j in zip(edges, edges[1:], strict=False)):
        n, whole = int(size[at[0]]), divmod(int(no[at[0]]), m)
        if n == 0 or len(at) == 1:
            continue
        x, ends = _letters(words.take(pa.array(at)), n), [n * i // m for i in range(1, m + 1)]
        shared = [i for i in range(n) if bisect_right(ends, i) in whole]
        _, own, times = np.unique(_coded(np.zeros(len(at), np.int64), x[shared], int(x.max()).bit_length()), return_inverse=True, return_counts=True)
        more = times[own] > 1
        if more.any():
            out[at[more]] = (_by_masks if n <= LONG else _by_pairs)(x[:, more], own[more], ends, whole, d)
    return out


def neighbour_counts(words: DataFrame, d: int, *, pep: str = "pep") -> DataFrame:
    """pep, n1 … nd: of every distinct string the number of others at each number of substitutions up to d. No row is made of a pair or a mask.

    The strings that share the letters beside a mask of k places are those that differ at some of these places only. So the sum over
    all masks of k places is S_k = sum over j up to k of n_j C(L - j, k - j), from which n_1, n_2, … follow in turn. A mask leaves
    two of d + 2 even pieces whole, so strings are dealt out by every choice of two pieces, and a unit adds up the masks whose first
    whole pieces these are.
    """
    each = Rounds(words.sparkSession, "neighbours").kept(words.select(pep).where(F.col(pep).isNotNull()).distinct())  # counted, then dealt
    n, m = F.length(pep), d + 2
    choices = list(combinations(range(m), 2))
    units = (each.agg(F.sum(n)).first()[0] or 0) * len(choices) // LETTERS + 1
    cut = lambda i: F.floor(n * i / m).cast("int")
    piece = lambda i: F.substring(F.col(pep), cut(i) + 1, cut(i + 1) - cut(i))
    both = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in choices))).alias("_p")
    dealt = each.select(pep, both).select(pep, F.col("_p.a").alias("_a"), F.col("_p.b").alias("_b")).repartition(units, n, "_a", "_b", piece(F.col("_a")), piece(F.col("_b")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = list(batches)
        if not unit:
            return
        unit = pa.Table.from_batches(unit).combine_chunks()
        peps, no = unit.column(0).combine_chunks(), unit.column(1).to_numpy() * m + unit.column(2).to_numpy()
        sums = _sums(peps.cast(pa.large_string()), no.astype(np.int64), d)
        some = np.flatnonzero((no == 1) | sums.any(1))  # at the first choice, also without any
        yield pa.RecordBatch.from_arrays([peps.take(pa.array(some)), *(pa.array(sums[some, k]) for k in range(d))], names=[pep, *(f"_s{k}" for k in range(1, d + 1))])

    found = dealt.mapInArrow(run, f"`{pep}` string, " + ", ".join(f"_s{k} bigint" for k in range(1, d + 1)))
    found = found.groupBy(pep).agg(*(F.sum(f"_s{k}").alias(f"_s{k}") for k in range(1, d + 1)))
    for k in range(1, d + 1):
        less = F.lit(0)
        for j in range(1, k):
            choose = F.lit(1)
            for i in range(k - j):
                choose = choose * (n - j - i) / (i + 1)
            less = less + F.col(f"n{j}") * F.greatest(F.round(choose), F.lit(0)).cast("bigint")
        found = found.withColumn(f"n{k}", F.col(f"_s{k}") - F.when(n >= k, less).otherwise(F.lit(0)))
    return found.select(pep, *(F.col(f"n{k}").cast("bigint").alias(f"n{k}") for k in range(1, d + 1)))


def mimics(binders: DataFrame, refs: DataFrame, d: int, *, pep: str = "pep", exclude_query: bool = False) -> DataFrame:
    """pep, category, n_exact, n_near, top_mimic, top_subs: of refs (category, pep) the equal ones and those within 1 to d substitutions.

    With exclude_query a string is no mimic of its own: n_exact is 0, and a category that has only the string itself gives no row.
    """
    r = refs.select("category", F.col(pep).alias("ref")).distinct()
    near = hamming_join(binders.select(F.col(pep).alias("query")), r, d, least=int(exclude_query)).join(r, "ref")
    best = F.min(F.when(F.col("dist") > 0, F.struct("dist", "ref")))
    found = near.groupBy(F.col("query").alias(pep), "category").agg(F.count_if(F.col("dist") == 0).alias("n_exact"), F.count_if(F.col("dist") > 0).alias("n_near"), best.alias("_m"))
    return found.select(pep, "category", "n_exact", "n_near", F.col("_m.ref").alias("top_mimic"), F.col("_m.dist").alias("top_subs"))


#: Letters of a signature by class; rows that a vote counts at most, and is widened below.
SIGNATURE = {"mhc1": 5, "mhc2": 4}
ENOUGH, CAP = 10, 100


def signature(pep: str | Column, cls: str = "mhc1") -> Column:
    """Class I: the first three and last two letters, which hold the pockets; class II: pockets 1, 4, 6 and 9 of the core, null below nine letters."""
    p = F.col(pep) if isinstance(pep, str) else pep
    if cls == "mhc1":
        return F.concat(F.substring(p, 1, 3), F.right(p, F.lit(2)))
    start = S.best_register(p)
    return F.concat(*(F.substring(p, start + j, F.lit(1)) for j in (1, 4, 6, 9)))


def signature_pairs(left: DataFrame, right: DataFrame, width: int, d: int) -> DataFrame:
    """sq, sp, dist: signatures of left (sq) and right (sp) within d substitutions of each other.

    Keys are the letters at every choice of width - d places, so that each row that meets is within d: nothing is made and thrown away
    but repeats, and a pair is kept at the first choice that it shares. Pieces of a few letters would bring nearly all together.
    """
    choices = list(combinations(range(width), width - d))
    letters = lambda c, places: F.concat(F.lit(""), *(F.substring(c, i + 1, 1) for i in places))
    cut = lambda df, c: df.select(c).distinct().select(c, F.length(c).alias("_n"), F.explode(F.array(*(F.struct(F.lit(k).alias("no"), letters(F.col(c), places).alias("key")) for k, places in enumerate(choices)))).alias("_k")).select(c, "_n", F.col("_k.no").alias("_no"), F.col("_k.key").alias("_key"))
    first = F.lit(True)
    for k, places in enumerate(choices[:-1]):
        first = first & ((F.col("_no") <= k) | (letters(F.col("sq"), places) != letters(F.col("sp"), places)))
    return cut(left, "sq").join(cut(right, "sp"), ["_n", "_no", "_key"]).where(first).select("sq", "sp", hamming(F.col("sq"), F.col("sp")).alias("dist"))


def _first_rows(near: DataFrame, panel: DataFrame, cap: int) -> DataFrame:
    """query, epitope, allele, dist: the first `cap` panel rows of every query, nearest first, then by epitope and allele, its own left out.

    near: query, sp, dist; panel: epitope, allele, sp. Of a signature only as many rows can be among them as the cap and an
    epitope's own rows allow, and of the signatures at one distance only those with the first epitopes, one more than the cap.
    """
    by_sig = Window.partitionBy("sp")
    of = panel.groupBy("sp", "epitope").agg(F.count("*").alias("_own")).groupBy("sp").agg(F.max("_own").alias("_most"), F.min("epitope").alias("_least"))
    rows = panel.join(of, "sp").withColumn("_at", F.row_number().over(by_sig.orderBy("epitope", "allele"))).where(F.col("_at") <= cap + F.col("_most"))
    some = near.join(of.select("sp", "_least"), "sp").withColumn("_r", F.row_number().over(Window.partitionBy("query", "dist").orderBy("_least", "sp"))).where(F.col("_r") <= cap + 1)
    met = some.select("query", "sp", "dist").join(rows.select("sp", "epitope", "allele"), "sp").where(F.col("epitope") != F.col("query"))
    return met.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy("dist", "epitope", "allele"))).where(F.col("_r") <= cap).select("query", "epitope", "allele", "dist")


def nearest_rows(queries: DataFrame, panel: DataFrame, *, scopes: int = 3, enough: int = ENOUGH, cap: int = CAP, cls: str = "mhc1") -> DataFrame:
    """query, epitope, allele, dist: panel rows near each query by signature, the radius widened until `enough` are found, `cap` of them at most: the cap is the vote's definition.

    Radii are tried one after the other, each only with the queries that still lack rows. Signatures meet, not rows: how many
    rows a signature has is counted once. Every round is written to the shared folder.
    """
    kept = Rounds(queries.sparkSession, "votes")
    width = SIGNATURE[cls]
    p = kept.kept(panel.select("epitope", "allele", signature("epitope", cls).alias("sp")).where("sp IS NOT NULL"))
    rows_of = kept.kept(p.groupBy("sp").agg(F.count("*").alias("_rows")))
    own = p.groupBy(F.col("epitope").alias("query")).agg(F.count("*").alias("_own"))
    open_ = kept.kept(queries.select("query", signature("query", cls).alias("sq")).where("sq IS NOT NULL").distinct().join(own, "query", "left").na.fill(0, ["_own"]))
    found = None
    for s in range(scopes + 1):
        pairs = kept.kept(signature_pairs(open_, rows_of, width, min(s, width)))
        n = pairs.join(rows_of, "sp").groupBy("sq").agg(F.sum("_rows").alias("_n"))
        counted = kept.kept(open_.join(n, "sq", "left").withColumn("_n", F.coalesce("_n", F.lit(0)) - F.col("_own")))
        done = counted if s == scopes else counted.where(F.col("_n") >= enough)
        near = _first_rows(done.where("_n > 0").select("query", "sq").join(pairs, "sq").select("query", "sp", "dist"), p, cap)
        found = near if found is None else found.unionByName(near)
        open_ = counted.where(F.col("_n") < enough).select("query", "sq", "_own")
        if s < scopes and not open_.limit(1).count():
            break
    return found


def votes(queries: DataFrame, panel: DataFrame, *, scopes: int = 3, enough: int = ENOUGH, cap: int = CAP, cls: str = "mhc1") -> DataFrame:
    """query, allele, votes, n: alleles of the nearest panel rows (see nearest_rows) and how many rows they have in all; panel: epitope, allele."""
    kept = nearest_rows(queries, panel, scopes=scopes, enough=enough, cap=cap, cls=cls)
    return kept.groupBy("query", "allele").agg(F.count("*").alias("votes")).withColumn("n", F.sum("votes").over(Window.partitionBy("query")))


def fuzzy_kmers(queries: DataFrame, refs: DataFrame, k: int, *, subs: int = 1, least: int = 1, feature: Callable[[Column], Column] | None = None) -> DataFrame:
    """query, ref, shared, score, place: pairs that have at least `least` different windows of the query of k letters in common, up to `subs` substitutions, best first.

    shared counts the query's windows that some window of the reference is near, score is the least number of substitutions, place
    orders a query's references by most shared, least score, name. Windows meet by a mask of `subs` wildcards, distinct windows
    once, and a pair of windows at the first mask that it shares. feature: the part of a string that is cut, such as its face.
    """
    part = feature or (lambda c: c)
    choices = list(combinations(range(k), k - subs))
    letters = lambda c, places: F.concat(F.lit(""), *(F.substring(c, i + 1, 1) for i in places))

    def cut(df: DataFrame, name: str) -> DataFrame:
        p = part(F.col(name))
        windows = F.when(F.length(p) >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(p) - (k - 1)), lambda i: F.substring(p, i, F.lit(k)))))
        return df.select(name).where(F.col(name).isNotNull()).distinct().select(name, F.explode(windows).alias("w"))

    def keyed(df: DataFrame, w: str) -> DataFrame:
        keys = F.array(*(F.struct(F.lit(n).alias("no"), letters(F.col(w), places).alias("key")) for n, places in enumerate(choices)))
        return df.select(w).distinct().select(w, F.explode(keys).alias("_k")).select(w, F.col("_k.no").alias("_no"), F.col("_k.key").alias("_key"))

    q, r = cut(queries, "query").withColumnRenamed("w", "_q"), cut(refs, "ref").withColumnRenamed("w", "_r")
    first = F.lit(True)
    for n, places in enumerate(choices[:-1]):
        first = first & ((F.col("_no") <= n) | (letters(F.col("_q"), places) != letters(F.col("_r"), places)))
    pairs = keyed(q, "_q").join(keyed(r, "_r"), ["_no", "_key"]).where(first).select("_q", "_r", hamming(F.col("_q"), F.col("_r")).alias("_d"))
    met = q.join(pairs, "_q").join(r, "_r").groupBy("query", "ref", "_q").agg(F.min("_d").alias("_d"))
    found = met.groupBy("query", "ref").agg(F.count("*").alias("shared"), F.min("_d").alias("score")).where(F.col("shared") >= least)
    return found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("shared"), "score", "ref")))


#: References and queries of a unit of `fuzzy_best`, and pairs that it counts at a time.
UNIT, ASKED, PAIRS = 1 << 15, 1 << 12, 1 << 21


def _cut(words: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """of, code: the distinct windows of k letters of each word, by word."""
    row, place = tiling.letters_of(words.cast(pa.large_string()))
    m = max(len(row) - k + 1, 0)
    code = np.zeros(m, np.int64)
    for j in range(k):
        code = code * 26 + place[j : j + m]
    within = row[:m] == row[k - 1 :][:m]
    key = np.unique(row[:m][within] * 26**k + code[within])
    return key // 26**k, key % 26**k


def _expanded(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ..., n of them, for each."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - n), n)


def _best(shared: np.ndarray, score: np.ndarray, query: np.ndarray, ref: np.ndarray, most: int) -> np.ndarray:
    """The rows of the first `most` references of each query."""
    # only counts that the first `most` of a query reach are sorted; counts of 255 and more are taken as one for that
    key = query * 256 + np.minimum(shared, 255)
    n = np.bincount(key, minlength=(int(query.max(initial=0)) + 1) * 256)
    more = n.reshape(-1, 256)[:, ::-1].cumsum(1)[:, ::-1].ravel() - n
    at = np.flatnonzero(more[key] < most)
    at = at[np.lexsort((ref[at], score[at], -shared[at], query[at]))]
    return at[np.arange(len(at)) - np.searchsorted(query[at], query[at]) < most]


def _unit(queries: pa.Array, refs: pa.Array, k: int, subs: int, most: int) -> tuple[np.ndarray, ...]:
    """query, ref, shared, score of the first `most` of the sorted references of each query."""
    of, code = _cut(queries, k)
    windows, own = np.unique(code, return_inverse=True)
    asked = of[np.argsort(own, kind="stable")]  # queries by window
    asked_at = np.searchsorted(np.sort(own), np.arange(len(windows) + 1))
    each = np.arange(len(windows))
    near, window, dist = [windows], [each], [np.zeros(len(windows), np.int64)]
    for unit in (26**j for j in range(k if subs else 0)):
        for step in range(1, 26):
            old = windows // unit % 26
            near.append(windows + ((old + step) % 26 - old) * unit)
            window.append(each)
            dist.append(np.ones(len(windows), np.int64))
    near, window, dist = np.concatenate(near), np.concatenate(window), np.concatenate(dist)
    order = np.argsort(near, kind="stable")
    near, window, dist = near[order], window[order], dist[order]
    row, code = _cut(refs, k)
    low = np.searchsorted(near, code)
    n = np.searchsorted(near, code, side="right") - low
    row, low, n = row[n > 0], low[n > 0], n[n > 0]
    ahead = np.r_[0, np.cumsum(np.diff(asked_at)[window])]
    pairs = np.cumsum(ahead[low + n] - ahead[low])  # as many as queries have the windows that are met
    edges = np.unique(np.r_[0, np.flatnonzero(np.diff(pairs // PAIRS)) + 1, len(row)])
    edges = np.unique(np.searchsorted(row, row[np.minimum(edges, len(row) - 1)])) if len(row) else edges[:0]  # a word is not split
    best = [np.zeros(0, np.int64)] * 4
    for a, z in zip(edges, [*edges[1:], len(row)], strict=True):
        at = _expanded(low[a:z], n[a:z])
        met = np.sort(((np.repeat(row[a:z], n[a:z]) * len(windows) + window[at]) << 1) | dist[at])
        met = met[np.r_[True, (met[1:] >> 1) != (met[:-1] >> 1)]]  # each window of a query at its least distance
        ref, w = (met >> 1) // len(windows), (met >> 1) % len(windows)
        times = np.diff(asked_at)[w]
        key = np.sort(((asked[_expanded(asked_at[w], times)] * len(refs) + np.repeat(ref, times)) << 1) | np.repeat(met & 1, times))
        start = np.flatnonzero(np.r_[True, (key[1:] >> 1) != (key[:-1] >> 1)])
        pair = key[start] >> 1
        found = [pair // len(refs), pair % len(refs), np.diff(np.r_[start, len(key)]), key[start] & 1]
        best = [np.r_[x, y] for x, y in zip(best, found, strict=True)]
        took = _best(best[2], best[3], best[0], best[1], most)
        best = [x[took] for x in best]
    return tuple(best)


def fuzzy_best(queries: DataFrame, refs: DataFrame, k: int, most: int, *, subs: int = 1) -> DataFrame:
    """query, ref, shared, score, place: the first `most` references of each query by `fuzzy_kmers`, of strings of the letters A to Z, none or one substitution allowed.

    refs are distinct and stored, as they are counted. Queries and references meet in units of bounded size, and only the best of a
    unit leave it, in place of a row for each pair.
    """
    if subs not in (0, 1) or 26**k * max(UNIT, ASKED) >= 1 << 62:
        raise ValueError("up to one substitution, and windows that fit a code")
    q = queries.where(F.length("query") >= k).select("query").distinct()
    slices, blocks = (max(1, -(-df.count() // size)) for df, size in ((refs, UNIT), (q, ASKED)))
    dealt = lambda df, name, m, own, other, n: df.select(name, F.pmod(F.xxhash64(name), F.lit(m)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(other)).select("_b", "_s", name).repartition(slices * blocks, "_b", "_s")
    left, right = dealt(q, "query", blocks, "_b", "_s", slices), dealt(refs.where(F.length("ref") >= k), "ref", slices, "_s", "_b", blocks)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        asked, there = a["query"].combine_chunks(), b["ref"].combine_chunks()
        there = there.take(pc.sort_indices(there))
        x = _unit(asked, there, k, subs, most) if len(asked) and len(there) else [np.zeros(0, np.int64)] * 4
        return pa.table({"query": asked.take(pa.array(x[0])), "ref": there.take(pa.array(x[1])), "shared": pa.array(x[2]), "score": pa.array(x[3].astype(np.int32))})

    found = left.groupBy("_b", "_s").cogroup(right.groupBy("_b", "_s")).applyInArrow(run, "query string, ref string, shared bigint, score int")
    return found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("shared"), "score", "ref"))).where(F.col("place") <= most)


def wild_type(peptides: DataFrame, windows: DataFrame, *, pep: str = "pep") -> DataFrame:
    """pep and its first variant of one substitution, by place and residue, among the windows; null if there is none, or pep is one itself."""
    from seqloom.operators.tiling import substitutions

    known = windows.select(F.col("kmer").alias("variant")).distinct()
    found = substitutions(peptides.select(pep).distinct(), pep).join(known, "variant").groupBy(pep).agg(F.min_by("variant", F.struct("pos", "residue")).alias("wild"))
    own = known.select(F.col("variant").alias(pep)).withColumn("_own", F.lit(True))
    return peptides.select(pep).distinct().join(found, pep, "left").join(own, pep, "left").select(pep, F.when(F.col("_own").isNull(), F.col("wild")).alias("wild"))


def find_sources(peptides: DataFrame, proteins: DataFrame, d: int = 1, *, exclude_exact: bool = False, name: str = "name", seq: str = "seq", pep: str = "pep") -> DataFrame:
    """query, name, offset, window, n_subs, mutations: every place of the proteins within d substitutions of a peptide, trimmed and in upper case.

    mutations are the (at, query, window) of the places that differ. Windows are searched once each, wherever they stand.
    """
    asked = peptides.select(F.upper(F.trim(pep)).alias("query")).where("query <> ''").distinct()
    lengths = [r[0] for r in asked.select(F.length("query")).distinct().collect()]  # of peptides: few
    cut = tiling.tile(proteins.select(name, F.upper(seq).alias(seq)), seq, sorted(lengths) or [1], kmer="window")
    pairs = hamming_join(asked, cut.select("window").distinct(), d, b="window", least=int(exclude_exact))
    each = F.transform(F.split("query", ""), lambda q, i: F.struct(i.alias("at"), q.alias("query"), F.substring(F.col("window"), i + 1, F.lit(1)).alias("window")))
    found = pairs.withColumn("mutations", F.filter(each, lambda m: m["query"] != m["window"]))
    return found.join(cut, "window").select("query", name, "offset", "window", F.col("dist").alias("n_subs"), "mutations")
