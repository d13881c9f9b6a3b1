"""Windows of sequences, their counts, and the sources they stand in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.sequences import RESIDUES, is_standard

#: Letters that are cut from a sequence at a time: a substring of a long string costs its offset, one of a block does not.
BLOCK = 512
#: Bytes of text that are packed at a time; the longest window whose base-20 code leaves 24 bits for the row.
SLICE, MOST_PACKED = 4_000_000, 9
#: Bits of the map of wanted windows; distinct windows that a task holds; multipliers of the rolled hash.
BITS, HELD = 24, 1 << 20
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def tile(df: DataFrame, seq: str, lengths: list[int], *, standard: bool = True, kmer: str = "kmer", offset: str = "offset") -> DataFrame:
    """df without seq, with every window of the given lengths and its zero-based offset; only standard residues unless told otherwise."""
    rest = [c for c in df.columns if c != seq]
    s, most = F.col("_block"), max(lengths)
    blocks = df.where(F.length(seq) >= min(lengths)).select(*rest, F.length(seq).alias("_n"), F.col(seq), F.explode(F.sequence(F.lit(0), F.floor((F.length(seq) - 1) / BLOCK).cast("int"))).alias("_b"))
    blocks = blocks.select(*rest, "_n", (F.col("_b") * BLOCK).alias("_at"), F.substring(F.col(seq), F.col("_b") * BLOCK + 1, F.lit(BLOCK + most - 1)).alias("_block"))
    out = None
    for k in lengths:
        last = F.least(F.lit(BLOCK), F.col("_n") - F.col("_at") - (k - 1)) - 1
        one = blocks.where(last >= 0).select(*rest, "_at", s, F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("_i"))
        one = one.select(*rest, F.substring(s, F.col("_i") + 1, F.lit(k)).alias(kmer), (F.col("_at") + F.col("_i")).alias(offset))
        out = one if out is None else out.unionByName(one)
    return out.where(is_standard(kmer)) if standard else out


def kmer_counts(df: DataFrame, seq: str, k: int, *, weight: str | None = None) -> DataFrame:
    """kmer, n: occurrences, or summed weights, of every standard window."""
    kept = df.select(seq, *([weight] if weight else []))
    return tile(kept, seq, [k]).groupBy("kmer").agg((F.sum(weight) if weight else F.count("*")).alias("n"))


def _places(letters: str) -> np.ndarray:
    """Of every byte its place among the letters, whatever its case, or -1."""
    out = np.full(256, -1, np.int64)
    for i, c in enumerate(letters):
        out[ord(c)] = out[ord(c.lower())] = i
    return out


def letters_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """row, place: of every letter A to Z of the texts, in either case, its text and its place in the alphabet."""
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    place = _places("ABCDEFGHIJKLMNOPQRSTUVWXYZ")[data[ends[0] : ends[-1]]]
    is_letter = place >= 0
    return np.repeat(np.arange(len(texts)), np.diff(ends))[is_letter], place[is_letter]


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of rows of about SLICE bytes of text."""
    sizes = np.cumsum(np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]))
    edges = [0, *(np.flatnonzero(np.diff(sizes // SLICE)) + 1).tolist(), len(texts)]
    yield from zip(edges, edges[1:], strict=False)


def rolled(place: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k letters in a row, by doubling."""
    x = place.astype(np.uint64) + np.uint64(1)
    out, done, width = None, 0, 1
    while True:
        if k & width:
            out = x if out is None else out[: len(x) - done] * np.uint64(pow(_BASE, width, 1 << 64)) + x[done:]
            done += width
        if done == k:
            break
        x, width = x[: len(x) - width] * np.uint64(pow(_BASE, width, 1 << 64)) + x[width:], 2 * width
    out = (out ^ (out >> np.uint64(32))) * _MIX
    return out ^ (out >> np.uint64(29))


def strings_of(place: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """The letters from start on, as large strings."""
    ends = np.r_[0, np.cumsum(length)].astype(np.int64)
    flat = place[np.repeat(start - ends[:-1], length) + np.arange(ends[-1])].astype(np.uint8) + np.uint8(65)
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(flat))


_RESIDUE = _places("".join(RESIDUES))[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)]


def _codes(texts: pa.Array, k: int) -> tuple[np.ndarray, ...]:
    """row, place, code: of every letter its text, where windows of k standard residues start, and their codes."""
    row, place = letters_of(texts)
    residue = _RESIDUE[place]
    m = max(len(row) - k + 1, 0)
    code, good = np.zeros(m, np.int64), row[:m] == row[k - 1 :][:m]
    for j in range(k):
        part = residue[j : j + m]
        code = code * 20 + part
        good &= part >= 0
    at = np.flatnonzero(good)
    return row, at, code[at]


def _packed(texts: pa.Array, k: int) -> tuple[np.ndarray, ...]:
    """row, code, n, first: distinct windows of the letters of each text, by row and code."""
    row, at, code = _codes(texts, k)
    key, first, n = np.unique((row[at] << 39) | code, return_index=True, return_counts=True)
    of = key >> 39
    return of, key & ((1 << 39) - 1), n, at[first] - np.searchsorted(row, of)


def packed_windows(df: DataFrame, text: str, k: int) -> DataFrame:
    """df without text, with the distinct windows of k standard residues among the letters of each text: code (base 20, in the order of the windows), n, first (least zero-based offset among the letters).

    Letters are taken from any text, in either case. A row of df is packed whole, in the task that reads it.
    """
    if k > MOST_PACKED:
        raise ValueError(f"windows of more than {MOST_PACKED} residues do not fit a code")
    rest = [f for f in df.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(rest)).cast(pa.large_string()).fill_null("")
            for a, z in slices(texts):
                of, code, n, first = _packed(texts.slice(a, z - a), k)
                own = pa.array(of + a)
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(own) for i in range(len(rest))), pa.array(code), pa.array(n.astype(np.int64)), pa.array(first.astype(np.int64))], names=[*(f.name for f in rest), "code", "n", "first"])

    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest)
    return df.select(*(f.name for f in rest), text).mapInArrow(run, f"{types}code bigint, n bigint, first bigint")


def letter_counts(df: DataFrame, text: str, k: int) -> DataFrame:
    """kmer, n: occurrences of every window of k standard residues among the letters of the texts, in either case. A task adds up its own slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = np.zeros(20**k, np.int64) if k <= 5 else None
        for b in batches:
            texts = b.column(0).cast(pa.large_string()).fill_null("")
            for a, z in slices(texts):
                code = _codes(texts.slice(a, z - a), k)[2]
                if small is not None:
                    small += np.bincount(code, minlength=len(small))
                    continue
                code, n = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], names=["code", "n"])
        if small is not None:
            at = np.flatnonzero(small)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(small[at])], names=["code", "n"])

    return df.select(text).mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).select(unpacked("code", k).alias("kmer"), "n")


def bit_map(places: DataFrame, bits: int) -> np.ndarray:
    """A map of 2^bits bits, 64 in a word, in which those of the column p are set."""
    words = places.groupBy(F.expr("p div 64").alias("i")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("w")).toArrow()  # at most 2^(bits - 6) rows
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["i"].to_numpy()] = words["w"].to_numpy()
    return out


def windows_among(df: DataFrame, text: str, wanted: DataFrame, lengths: list[int], *, kmer: str = "kmer", offset: str = "offset", distinct: bool = False) -> DataFrame:
    """df without text, with the windows of the letters of each text, in upper case, that may be among the strings of wanted (one column, letters only, of these lengths), and their zero-based offsets.

    A map of bits, of fixed size, names the wanted ones by a hash: what it lets through by chance falls out in the join that follows, and where
    it fills up, all windows are let through. distinct: the windows alone, of up to 13 letters, each once for about HELD that a task has.
    """
    if distinct and max(lengths) > 13:
        raise ValueError("windows of more than 13 letters do not fit a code")
    rest, mask = [f for f in df.schema.fields if f.name != text], (1 << BITS) - 1

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).cast(pa.large_string()).drop_null()
            size = np.diff(np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1])
            for k in np.unique(size[size > 0]).tolist():
                row, place = letters_of(own.filter(pa.array(size == k)))
                yield pa.RecordBatch.from_arrays([pa.array((rolled(place, k)[::k].view(np.int64)) & mask)], names=["p"])

    map_ = df.sparkSession.sparkContext.broadcast(bit_map(wanted.mapInArrow(places, "p bigint"), BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(rest)).cast(pa.large_string()).fill_null("")
            for a, z in slices(texts):
                row, place = letters_of(texts.slice(a, z - a))
                for k in lengths:
                    if len(row) < k:
                        continue
                    p = rolled(place, k).view(np.int64) & mask
                    at = np.flatnonzero(((map_.value[p >> 6] >> (p & 63)) & 1 == 1) & (row[: len(p)] == row[k - 1 :]))
                    own = row[at]
                    if len(at):
                        yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(own + a)) for i in range(len(rest))), strings_of(place, at, np.full(len(at), k)).cast(pa.string()), pa.array((at - np.searchsorted(row, own)).astype(np.int32))], names=[*(f.name for f in rest), kmer, offset])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: np.zeros(0, np.int64) for k in lengths}

        def out(k: int) -> pa.RecordBatch:
            place = held[k][:, None] // 26 ** np.arange(k - 1, -1, -1) % 26
            return pa.RecordBatch.from_arrays([strings_of(place.ravel(), np.arange(len(place)) * k, np.full(len(place), k)).cast(pa.string())], names=[kmer])

        for b in batches:
            texts = b.column(0).cast(pa.large_string()).fill_null("")
            for a, z in slices(texts):
                row, place = letters_of(texts.slice(a, z - a))
                for k in lengths:
                    if len(row) < k:
                        continue
                    p = rolled(place, k).view(np.int64) & mask
                    at = np.flatnonzero(((map_.value[p >> 6] >> (p & 63)) & 1 == 1) & (row[: len(p)] == row[k - 1 :]))
                    code = np.zeros(len(at), np.int64)
                    for j in range(k):
                        code = code * 26 + place[at + j]
                    held[k] = np.union1d(held[k], code)
                    if len(held[k]) >= HELD:
                        yield out(k)
                        held[k] = held[k][:0]
        yield from (out(k) for k in lengths if len(held[k]))

    if distinct:
        return df.select(text).mapInArrow(once, f"`{kmer}` string")
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest)
    return df.select(*(f.name for f in rest), text).mapInArrow(run, f"{types}`{kmer}` string, `{offset}` int")


def unpacked(code: str | Column, k: int) -> Column:
    """The window that a code stands for."""
    c = F.col(code) if isinstance(code, str) else code
    return F.concat(*(F.substring(F.lit(RESIDUES), (F.floor(c / 20**j) % 20 + 1).cast("int"), F.lit(1)) for j in range(k - 1, -1, -1)))


def substitutions(df: DataFrame, pep: str) -> DataFrame:
    """df with every string that differs in one place: variant, pos (zero-based), residue."""
    places = df.withColumn("pos", F.explode(F.sequence(F.lit(0), F.length(pep) - 1)))
    each = places.withColumn("residue", F.explode(F.array(*map(F.lit, RESIDUES)))).where(F.substring(F.col(pep), F.col("pos") + 1, F.lit(1)) != F.col("residue"))
    return each.withColumn("variant", F.concat(F.substring(F.col(pep), F.lit(1), F.col("pos")), "residue", F.substring(F.col(pep), F.col("pos") + 2, F.length(pep))))


def junction_windows(left: str, right: str, spacer: str, lengths: list[int], df: DataFrame) -> DataFrame:
    """df with the windows that touch both sides of a junction, or the spacer and a side: window, start."""
    whole = F.concat(F.col(left), F.col(spacer), F.col(right))
    a, b = F.length(left), F.length(left) + F.length(spacer)
    out = None
    for k in lengths:
        one = df.where(F.length(whole) >= k).withColumn("start", F.explode(F.sequence(F.lit(0), F.length(whole) - k)))
        end = F.col("start") + k
        touches = ((F.col("start") < a) & (end > a)) | ((F.col("start") < b) & (end > b))
        one = one.where(touches).withColumn("window", F.substring(whole, F.col("start") + 1, F.lit(k)))
        out = one if out is None else out.unionByName(one)
    return out


def exact_sources(queries: DataFrame, proteins: DataFrame, *, pep: str = "pep", seq: str = "seq") -> DataFrame:
    """Every place where a query stands in a protein: an equi-join on windows of the queries' lengths, which are few."""
    lengths = [r[0] for r in queries.select(F.length(pep)).distinct().collect()]
    if not lengths:
        return queries.join(proteins.drop(seq).limit(0).withColumn("offset", F.lit(0)), F.lit(True)).limit(0)
    return queries.join(tile(proteins, seq, sorted(lengths), kmer=pep), pep)
