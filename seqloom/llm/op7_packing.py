"""Best-fit packing: bounded-space online best-fit of token pieces into fixed-length sequences.

A document's ids, and an end id, are cut into pieces only where they exceed a sequence. Each task packs the pieces of
its own input as they come: of at most `open_bins` open sequences it takes the one with the least free space that still
holds the piece, found by one bit operation in a bitset keyed by free space; when there are too many, the fullest closes.
What a task leaves partly filled is then packed once more, by the same rule and as whole sequences, among the tasks of a
group, so that small inputs and many partitions waste little either. Only counts and offsets move in that step.

Cases: a null or empty text is one piece that holds the end id only; a text of any length is cut into whole sequences and
a rest; repeated rows are packed each on their own, with equal doc_id; an empty table gives an empty result; extra
columns are never read.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.chunks import Cache, Ragged, slices
from seqloom.llm.common import documents, stored, text_or_empty

CAPACITY, END_ID, OPEN_BINS = 4096, 1, 512
#: Bytes of text that are encoded at a time: the more, the fewer pieces are looked up.
SLICE_BYTES = 6_000_000
#: Tasks whose partly filled sequences are packed together.
GROUP_TASKS = 64
#: Partly filled sequences that are packed together at most, on average.
GROUP_ROWS = 1 << 16


class WordTokens:
    """Ids of whole texts by a tokenizers file whose pieces never hold white space, so that every space is a safe cut.

    The vocabulary also parts letters and digits from other characters, so that a piece which ends in punctuation has the ids
    of what comes before it and then those of the punctuation: distinct pieces become far fewer.
    """

    #: Punctuation but the apostrophe, which begins endings of English words that the vocabulary keeps apart.
    MARKS = ".,;:!?*#$%&|<>()[]{}\"-_=+/\\@^~`"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        # of small letters only, which are their own normal form and one match of the pattern: neither step is needed
        made = json.loads(self.tokenizer.to_str())
        made |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
        self.lean = Tokenizer.from_str(json.dumps(made))
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.cache, self.tails = Cache(self._bases, 600_000), Cache(self.whole, 50_000)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _bases(self, pieces: list[str]) -> list[bytes]:
        out = [b""] * len(pieces)
        plain = pc.match_substring_regex(pa.array(pieces, pa.string()), "^[a-zà-öø-ÿ]+$").to_numpy(zero_copy_only=False).astype(bool) if pieces else np.zeros(0, bool)
        for run in np.array_split(np.flatnonzero(plain), max(1, int(plain.sum()) // 20_000)):
            ids = np.array(self.lean.encode(" ".join([pieces[i] for i in run.tolist()]), add_special_tokens=False).ids, self.kind) if len(run) else np.zeros(0, self.kind)
            data, size = ids.tobytes(), ids.itemsize
            ends = (size * (np.flatnonzero(self.ends[ids]) + 1)).tolist()  # a word ends with a token that says so
            for i, a, b in zip(run.tolist(), [0, *ends], ends, strict=False):
                out[i] = data[a:b]
        rest = np.flatnonzero(~plain).tolist()
        for i, v in zip(rest, self.whole([pieces[i] for i in rest]), strict=True):
            out[i] = v
        return out

    def _pieces(self, pieces: pa.Array) -> Ragged:
        """Ids of distinct pieces."""
        base = pc.ascii_rtrim(pieces, characters=self.MARKS)
        ends = pc.and_(pc.match_substring_regex(base, "[a-z0-9à-öø-ÿ]$"), pc.less(pc.binary_length(base), pc.binary_length(pieces)))
        bases = pc.dictionary_encode(pc.if_else(ends, base, pieces))
        ends = ends.to_numpy(zero_copy_only=False).astype(bool)
        marks = "".join("\\" + c for c in self.MARKS)
        tails = pc.dictionary_encode(pc.replace_substring_regex(pieces.filter(pa.array(ends)), f"^(?s:.*)[^{marks}]", ""))
        values = self.cache.values(bases.dictionary.to_pylist())
        rows = Ragged.of_bytes([*values, *self.tails.values(tails.dictionary.to_pylist()), b""], self.kind)
        at = np.full((len(pieces), 2), len(rows.lengths) - 1)
        at[:, 0] = bases.indices.to_numpy(zero_copy_only=False)
        at[ends, 1] = len(values) + tails.indices.to_numpy(zero_copy_only=False)
        return rows.take(at.reshape(-1)).join(np.full(len(pieces), 2))

    def encode(self, texts: pa.Array) -> Ragged:
        # the vocabulary lowers letters and drops white space itself
        low = pc.replace_substring(pc.ascii_lower(texts), "\n", " ")
        odd = np.zeros(len(texts), bool)
        for s in self.specials:
            odd |= pc.match_substring(low, s).to_numpy(zero_copy_only=False).astype(bool)
        lists = pc.split_pattern(low, " ")
        flat = pc.dictionary_encode(lists.flatten())
        per_text = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = self._pieces(flat.dictionary).take(flat.indices.to_numpy(zero_copy_only=False)).join(per_text)
        if not odd.any():
            return ids
        rows = [ids.row(i).tobytes() for i in range(len(texts))]
        for i in np.flatnonzero(odd).tolist():
            rows[i] = self.whole([texts[i].as_py()])[0]
        return Ragged.of_bytes(rows, self.kind)


_TOKENS: dict[str, WordTokens] = {}


def tokens(path: str) -> WordTokens:
    """One for each worker process; its cache serves all tasks that run there."""
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


class OpenBins:
    """At most `most` open sequences of `capacity` places."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.mask, self.count, self.next = capacity, most, 0, 0, 0
        self.by_free: dict[int, list[int]] = {}

    def _open(self, number: int, free: int) -> None:
        if not free:
            return  # full: closed at once
        self.by_free.setdefault(free, []).append(number)
        self.mask |= 1 << free
        self.count += 1
        if self.count > self.most:
            self._take((self.mask & -self.mask).bit_length() - 1)  # the fullest closes

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        number = held.pop()
        if not held:
            self.mask &= ~(1 << free)
        self.count -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """Number of the sequence that takes a piece, and the piece's place there."""
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            number, free = self.next, self.capacity
            self.next += 1
        self._open(number, free - length)
        return number, self.capacity - free


def pieces(docs: DataFrame, *, id_col: str, text_col: str, tokenizer: str, capacity: int, end_id: int, open_bins: int) -> DataFrame:
    """One row per piece, packed within its task: task, bin, place, besides the piece's own columns."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task bigint, bin bigint, place bigint"

    def run(batches):
        bins, task = OpenBins(capacity, open_bins), TaskContext.get().partitionId()
        for batch in batches:
            at = 0
            for part in slices(batch.column(1), SLICE_BYTES):
                ids = tokens(tokenizer).encode(part)
                rows = []
                for i in range(len(part)):
                    wide = np.append(ids.row(i).astype("<u4"), np.uint32(end_id))
                    for k, start in enumerate(range(0, len(wide), capacity)):
                        piece = wide[start : start + capacity]
                        rows.append((at + i, k, start, len(piece), zlib.crc32(piece.tobytes()), task, *bins.place(len(piece))))
                at += len(part)
                row, *columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["id", "piece", "start", "length", "ids_crc32", "task", "bin", "place"])

    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)


def repack(used: DataFrame, capacity: int, open_bins: int) -> DataFrame:
    """Packs whole sequences (task, bin, used) of neighbouring tasks into fewer: task, bin, to_task, to_bin, shift."""

    def run(key, group):
        bins = OpenBins(capacity, open_bins)
        order = group.sort_by([("used", "descending"), ("task", "ascending"), ("bin", "ascending")])
        names = list(zip(order["task"].to_pylist(), order["bin"].to_pylist(), strict=True))
        first: dict[int, tuple[int, int]] = {}
        placed = []
        for name, n in zip(names, order["used"].to_pylist(), strict=True):
            number, place = bins.place(n)
            placed.append((*name, *first.setdefault(number, name), place))
        return pa.table([pa.array(c, pa.int64()) for c in zip(*placed, strict=True)], names=["task", "bin", "to_task", "to_bin", "shift"])

    near = used.withColumn("g", F.floor(F.col("task") / GROUP_TASKS))
    # however many sequences closed part-filled, a group holds about GROUP_ROWS of them
    sizes = near.groupBy("g").agg(F.ceil(F.count("*") / GROUP_ROWS).alias("parts"))
    dealt = near.join(sizes, "g").withColumn("h", F.pmod(F.xxhash64("task", "bin"), "parts")).drop("parts")
    return dealt.groupBy("g", "h").applyInArrow(run, "task bigint, bin bigint, to_task bigint, to_bin bigint, shift bigint")


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "", capacity: int = CAPACITY, end_id: int = END_ID, open_bins: int = OPEN_BINS) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset."""
    import public_tokenizers

    done = stored(pieces(docs, id_col=id_col, text_col=text_col, tokenizer=tokenizer or str(public_tokenizers.path("word_bpe_49k.json")), capacity=capacity, end_id=end_id, open_bins=open_bins), "pieces")
    part_full = done.groupBy("task", "bin").agg(F.sum("length").alias("used")).where(F.col("used") <= capacity - capacity // 32)
    moved = repack(part_full, capacity, open_bins)
    to = done.join(moved, ["task", "bin"], "left")
    sequence = F.coalesce("to_task", "task") * F.lit(1 << 32) + F.coalesce("to_bin", "bin")
    return to.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), (F.col("place") + F.coalesce("shift", F.lit(0))).alias("offset"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


QUERIES = {"op7_best_fit_packing": op7_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
