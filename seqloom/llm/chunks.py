"""Pieces of text that a tokenizer treats alone, so that each distinct piece of a batch is encoded once.

Both public byte-pair vocabularies cut a text into matches of a pattern before they merge anything. A space between two
characters that are not white space always begins a match, so cutting there changes no token; the pieces between such
spaces repeat a great deal. Cutting and finding the distinct pieces is Arrow's work, only distinct pieces reach Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that some pattern may count as white space, and control characters. Next to a space, or at either end, they
#: can make a match that a cut at each space would part.
_BLANK = r"[\x00-\x20\x{7f}-\x{a0}\p{Z}]"
_TANGLED = rf" {_BLANK}|{_BLANK} |\A{_BLANK}|{_BLANK}\z"
#: Bytes of text that are worked on at a time, and entries of a cache before it starts anew: both bound a worker's memory.
SLICE_BYTES, CACHE_ENTRIES = 3_000_000, 500_000


def slices(batch: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """batch in runs of about limit bytes, nulls as empty texts; a longer text is a run of its own."""
    if not len(batch):
        return
    texts = pc.fill_null(batch.cast(pa.large_string()), "")
    run = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // limit
    edges = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(texts)]
    for a, b in zip(edges, edges[1:], strict=False):
        yield texts.slice(a, b - a)


@dataclass
class Cut:
    """Distinct pieces, the number of each text's pieces, and the place of every piece among the distinct ones."""

    distinct: list[str]
    per_text: np.ndarray
    place: np.ndarray


def cut(texts: pa.Array) -> Cut:
    """Cuts at every single space; all pieces of a text but its first stand for themselves with the space before them."""
    lists = pc.split_pattern(texts, " ")
    flat = pc.dictionary_encode(lists.flatten())
    return Cut(flat.dictionary.to_pylist(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), flat.indices.to_numpy(zero_copy_only=False).astype(np.int64))


def tangled(texts: pa.Array, specials: tuple[str, ...] = ()) -> np.ndarray:
    """Whether white space stands next to a space or at an end, or a special string occurs: such texts are not to be cut at spaces."""
    out = pc.match_substring_regex(texts, _TANGLED).to_numpy(zero_copy_only=False)
    for s in specials:
        out = out | pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
    return out.astype(bool)


class Cache:
    """Values of pieces by piece; `encode` gets the missing ones together."""

    def __init__(self, encode: Callable[[list[str]], list], entries: int = CACHE_ENTRIES):
        self.encode, self.entries, self.known = encode, entries, {}

    def values(self, pieces: list[str]) -> list:
        known = self.known
        missing = [p for p in dict.fromkeys(pieces) if p not in known]
        if len(known) + len(missing) > self.entries:  # what is in use now stays, frequent pieces among it
            known = self.known = {p: known[p] for p in pieces if p in known}
        known.update(zip(missing, self.encode(missing), strict=True))
        return list(map(known.__getitem__, pieces))


class Ragged:
    """Rows of numbers of unequal length, one after another."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat, self.lengths = flat, lengths
        self.starts = np.cumsum(lengths) - lengths

    @staticmethod
    def of_bytes(rows: list[bytes], kind: type = np.uint16) -> Ragged:
        size = np.dtype(kind).itemsize
        return Ragged(np.frombuffer(b"".join(rows), kind), np.fromiter(map(len, rows), np.int64, len(rows)) // size)

    def take(self, rows: np.ndarray) -> Ragged:
        """The given rows, in their order."""
        lengths = self.lengths[rows]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[rows] - (ends - lengths), lengths)
        return Ragged(self.flat[at], lengths)

    def join(self, per_row: np.ndarray) -> Ragged:
        """Neighbouring rows made one: per_row[i] of them make row i."""
        return Ragged(self.flat, sums(self.lengths, per_row))

    def row(self, i: int) -> np.ndarray:
        return self.flat[self.starts[i] : self.starts[i] + self.lengths[i]]


def sums(values: np.ndarray, per_row: np.ndarray) -> np.ndarray:
    """Sums of per_row[i] neighbouring values."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(per_row)
    return total[ends] - total[ends - per_row]
