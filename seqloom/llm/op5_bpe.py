"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct words of a batch are laid out as one row of byte tokens. An inverted index from token pair to the positions
where the pair stands, and a heap of the pairs by rank, replay every merge in rank order over all words at once; a merge
touches only its two neighbours, whose new pairs enter the index. Words are the matches of the vocabulary's pattern, each
encoded alone. Words and pieces seen before come from a bounded cache.

Cases: a null or empty text has no tokens, and its digests are those of zero bytes; repeated rows are each returned; an
empty table gives an empty result; a very long text is a slice of its own, and never cut; extra columns are never read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.chunks import Cache, Ragged, cut, slices, tangled
from seqloom.llm.common import documents

ROUND_TRIP = "struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>"


def rank_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class MergeReplay:
    """Encodes many words together. ranks: token bytes to id, lower ids merge first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)])
        self.shift = max(self.token).bit_length()
        self.merged: dict[int, int] = {}  # pair, packed, to the id it merges to, or -1
        self.of_bytes = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)])

    def _merge(self, pair: int) -> int:
        if len(self.merged) > 1_000_000:
            self.merged.clear()
        found = self.merged[pair] = self.ranks.get(self.token[pair >> self.shift] + self.token[pair & (1 << self.shift) - 1], -1)
        return found

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word; a word that is a token is that token."""
        out = [[self.ranks[w]] if w in self.ranks else None for w in words]
        rest = [i for i, x in enumerate(out) if x is None]
        raw = np.frombuffer(b" ".join([words[i] for i in rest]) + b" ", np.uint8)
        ends = np.cumsum(np.fromiter((len(words[i]) + 1 for i in rest), np.int64, len(rest)))  # of each word, and of the -1 that parts it from the next
        tokens = self.single[raw]
        ranks = np.full(len(raw), -1)
        ranks[:-1] = self.of_bytes[raw[:-1], raw[1:]]
        tokens[ends - 1] = ranks[ends - 1] = -1
        ranks[ends[ends > 1] - 2] = -1
        # the inverted index: a pair, by the token that it spells, to its positions in rising order
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0) :]
        keys, first = np.unique(ranks[order], return_index=True)
        index = dict(zip(keys.tolist(), (x.tolist() for x in np.split(order, first[1:])), strict=True)) if len(keys) else {}
        heap = list(index)
        heapify(heap)
        tokens, n, shift = tokens.tolist(), len(raw), self.shift
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        known, merge = self.merged.get, self._merge
        while heap:
            rank = heappop(heap)
            places = sorted(index.pop(rank))
            for k, p in enumerate(places):
                a, q = tokens[p], after[p]
                if a < 0 or (b := tokens[q]) < 0:
                    continue
                pair = a << shift | b
                r = known(pair)
                if (merge(pair) if r is None else r) != rank:
                    continue  # one of the two has merged with its other neighbour
                tokens[p], tokens[q] = rank, -2
                after[p] = q = after[q]
                before[q] = p
                lowest = rank
                # only the two touched neighbours can form new pairs
                if (b := tokens[q]) >= 0:
                    pair = rank << shift | b
                    r = known(pair)
                    if r is None:
                        r = merge(pair)
                    if r >= 0:
                        if r in index:
                            index[r].append(p)
                        else:
                            index[r] = [p]
                            heappush(heap, r)
                        if r < lowest:
                            lowest = r
                o = before[p]
                if o >= 0 and (a := tokens[o]) >= 0:
                    pair = a << shift | rank
                    r = known(pair)
                    if r is None:
                        r = merge(pair)
                    if r >= 0:
                        if r in index:
                            index[r].append(o)
                        else:
                            index[r] = [o]
                            heappush(heap, r)
                        if r < lowest:
                            lowest = r
                if lowest < rank and k + 1 < len(places):  # a lower rank has appeared: it goes first, what is left of this one after it
                    if rank not in index:
                        index[rank] = []
                        heappush(heap, rank)
                    index[rank] += places[k + 1 :]
                    break
        done = np.array(tokens)
        kept = done >= 0
        ids, until = done[kept].tolist(), np.cumsum(kept)[ends - 1].tolist() if len(ends) else []
        for i, a, b in zip(rest, [0, *until], until, strict=False):
            out[i] = ids[a:b]
        return out


class Codec:
    """Encodes and decodes whole texts a slice of a column at a time."""

    def __init__(self, path: str, words: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.kind = np.uint16 if max(self.ranks.values()) < 1 << 16 else np.uint32
        self.words = regex.compile(words)
        self.replay = MergeReplay(self.ranks)
        self.word_cache, self.piece_cache = Cache(self._words), Cache(self._pieces)
        table = [b""] * (max(self.ranks.values()) + 1)
        for b, i in self.ranks.items():
            table[i] = b
        self.bytes_of = Ragged.of_bytes(table, np.uint8)

    def _words(self, words: list[str]) -> list[bytes]:
        return [np.array(ids, self.kind).tobytes() for ids in self.replay.encode([w.encode() for w in words])]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Of pieces with the space before them: only the first word of each begins with a space."""
        if not pieces:
            return []
        words = self.words.findall(" " + " ".join(pieces))
        ids = self.word_cache.values(words)
        edges = [i for i, w in enumerate(words) if w[0] == " "]
        return [b"".join(ids[a:b]) for a, b in zip(edges, [*edges[1:], len(words)], strict=True)]

    def _whole(self, text: str) -> bytes:
        return b"".join(self.word_cache.values(self.words.findall(text)))

    def encode(self, texts: pa.Array) -> Ragged:
        """Ids of each text."""
        odd = tangled(texts)
        rows: list[bytes] = [b""] * len(texts)
        for i in np.flatnonzero(odd).tolist():
            rows[i] = self._whole(texts[i].as_py())
        plain = texts.filter(pa.array(~odd))
        if not len(plain):
            return Ragged.of_bytes(rows, self.kind)
        c = cut(plain)
        head = np.cumsum(c.per_text) - c.per_text
        firsts = [c.distinct[i] for i in c.place[head].tolist()]
        inner = np.ones(len(c.place), bool)
        inner[head] = False
        used = np.zeros(len(c.distinct), bool)
        used[c.place[inner]] = True  # a piece that only begins texts has no space before it
        values: list[bytes] = [b""] * len(c.distinct)
        for i, v in zip(np.flatnonzero(used).tolist(), self.piece_cache.values([c.distinct[i] for i in np.flatnonzero(used).tolist()]), strict=True):
            values[i] = v
        c.place[head] = len(values) + np.arange(len(head))
        ids = Ragged.of_bytes(values + [self._whole(t) for t in firsts], self.kind).take(c.place).join(c.per_text)
        if not odd.any():
            return ids
        for k, i in enumerate(np.flatnonzero(~odd).tolist()):
            rows[i] = ids.row(k).tobytes()
        return Ragged.of_bytes(rows, self.kind)

    def decode(self, ids: Ragged) -> Ragged:
        """Bytes of each row of ids."""
        return self.bytes_of.take(ids.flat.astype(np.int64)).join(ids.lengths)


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, words: str) -> Codec:
    """One for each worker process; its caches serve all tasks that run there."""
    if (path, words) not in _CODECS:
        _CODECS[path, words] = Codec(path, words)
    return _CODECS[path, words]


def encode_ids(text, path: str, words: str):
    """Column array<int> of the ids of a text column."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [codec(path, words).encode(s) for s in slices(batch)]
            lengths = np.concatenate([np.zeros(1, np.int64), *(p.lengths for p in parts)])
            flat = np.concatenate([np.zeros(0, np.int32), *(p.flat.astype(np.int32) for p in parts)])
            yield pa.ListArray.from_arrays(pa.array(np.cumsum(lengths), pa.int32()), pa.array(flat, pa.int32()))

    return F.arrow_udf(run, "array<int>")(text)


def decode_ids(ids, path: str, words: str):
    """Column of the bytes that a column of ids stands for."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [np.array(r or [], np.int64) for r in batch.to_pylist()]
            lengths = np.fromiter(map(len, rows), np.int64, len(rows))
            out = codec(path, words).decode(Ragged(np.concatenate([np.zeros(0, np.int64), *rows]), lengths))
            yield pa.array([out.row(i).tobytes() for i in range(len(rows))], pa.binary())

    return F.arrow_udf(run, "binary")(ids)


def round_trip(text, path: str, words: str):
    """Column of ROUND_TRIP: encodes, then decodes the ids, and digests both."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path, words)
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for s in slices(batch):
                ids = c.encode(s)
                back, wide = c.decode(ids), Ragged(ids.flat.astype("<u4"), ids.lengths)
                counts.append(ids.lengths)
                of_ids += [hashlib.sha256(wide.row(i)).hexdigest() for i in range(len(s))]
                of_bytes += [hashlib.sha256(back.row(i)).hexdigest() for i in range(len(s))]
            yield pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *counts]), pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return F.arrow_udf(run, ROUND_TRIP).asNondeterministic()(text)  # evaluated once, not once for each field


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", round_trip(F.col("text"), rank_file(), pattern()).alias("_r")).select("doc_id", "_r.n_tokens", "_r.ids_sha256", "_r.decoded_sha256")


QUERIES = {"op5_bpe_round_trip": op5_bpe_round_trip}
ORACLE_SQL: dict[str, str] = {}
