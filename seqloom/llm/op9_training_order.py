"""Token-ID / binary output: training-order materialisation.

Each document's token ids, and an end id, are cut into sequences of a fixed length. Sequences are numbered by task and place
within it, and a keyed Feistel permutation of exactly as many numbers as there are sequences gives each its global slot:
no slot is drawn twice and none is left out. A slot depends on the key and on how the input was split into tasks, so a run on
other splits gives another order: what has to be kept is the shards themselves, each of which names its slots. Networks permute
powers of four only, so a number that falls outside is permuted again until it falls inside (cycle-walking). Sequences
are then dealt to partitions by ranges of slots, sorted, and written as shards: records of one stride, so that slot s is
record s mod R of shard s div R, at byte (s mod R) * stride of its payload. A reader that stopped at any slot opens the file
whose statistics hold that shard, and goes on in it from that byte; shards are read from front to back. A shard is a row of
a Parquet file, so that its page is read whole before a record is cut out of it.

Ids are encoded once, written to the shared folder, counted by task (a number for each task reaches the driver,
as in zipWithIndex) and shuffled once. Partitions hold even ranges of slots, whatever keys repeat in the input.

Cases: a null or empty text is one sequence that holds the end id only; a long text makes many sequences; repeated rows
make sequences of their own; an empty table makes no shard; the last shard can be short, its records are whole; extra
columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.chunks import slices
from seqloom.llm.common import documents, stored, text_or_empty
from seqloom.llm.op7_packing import SLICE_BYTES, tokens

LENGTH, RECORDS, END_ID, PAD_ID, KEY, ROUNDS = 1024, 128, 49407, 0, 20240607, 6
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def feistel(numbers: np.ndarray, n: int, key: int = KEY, *, inverse: bool = False) -> np.ndarray:
    """The keyed permutation of range(n), or its inverse, at the given numbers."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    low = np.uint64((1 << int(half)) - 1)
    keys = _mix(np.uint64(key & (1 << 64) - 1) + _ODD * np.arange(1, ROUNDS + 1, dtype=np.uint64))
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> half, x & low
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ (_mix(left + k) & low), left
            else:
                left, right = right, left ^ (_mix(right + k) & low)
        out[todo] = x = left << half | right
        todo = todo[x >= np.uint64(n)]  # outside: once more
    return out.astype(np.int64)


def encoded(docs: DataFrame, *, id_col: str, text_col: str, tokenizer: str, length: int, end_id: int) -> DataFrame:
    """id, piece, n, ids, task, local: all sequences, numbered within their task."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        task, local = TaskContext.get().partitionId(), 0
        for batch in batches:
            at = 0
            for part in slices(batch.column(1), SLICE_BYTES):
                ids = tokens(tokenizer).encode(part)
                sizes = ids.lengths + 1
                flat = np.full(len(ids.flat) + len(part), end_id, ids.flat.dtype)
                inside = np.ones(len(flat), bool)
                inside[np.cumsum(sizes) - 1] = False
                flat[inside] = ids.flat
                # sequences of a document lie one after another, so that they are cuts of one buffer
                each = -(-sizes // length)
                total = int(each.sum())
                of = np.repeat(np.arange(len(part)), each)
                piece = np.arange(total) - np.repeat(np.cumsum(each) - each, each)
                n = np.minimum(length, sizes[of] - piece * length)
                offsets = np.concatenate([[0], np.cumsum(n)]) * flat.itemsize
                data = pa.Array.from_buffers(pa.large_binary(), total, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at + of)), pa.array(piece.astype(np.int32)), pa.array(n.astype(np.int32)), data, pa.array(np.full(total, task), pa.int64()), pa.array(np.arange(local, local + total), pa.int64())], names=["id", "piece", "n", "ids", "task", "local"])
                at += len(part)
                local += total

    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"id {kind}, piece int, n int, ids binary, task bigint, local bigint")


def slots(sequences: DataFrame, key: int = KEY) -> tuple[DataFrame, int]:
    """sequences (stored, with task and local) and their column slot; how many there are."""
    counted = sorted((r.task, r.n) for r in sequences.groupBy("task").agg(F.count("*").alias("n")).collect())  # one row for each task
    ends = np.cumsum([n for _, n in counted])
    first = {t: int(e - n) for (t, n), e in zip(counted, ends, strict=True)}
    total = int(ends[-1]) if counted else 0
    shared = sequences.sparkSession.sparkContext.broadcast(first)  # a number for each task

    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for task, local in columns:
            start = np.array([shared.value[t] for t in task.to_pylist()], np.int64)
            yield pa.array(feistel(start + local.to_numpy(zero_copy_only=False), total, key), pa.int64())

    return sequences.withColumn("slot", F.arrow_udf(run, "bigint")("task", "local")), total


def shards(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "", length: int = LENGTH, records: int = RECORDS, end_id: int = END_ID, pad_id: int = PAD_ID, key: int = KEY) -> DataFrame:
    """One row per shard: shard, first_slot, stride and id_bytes (bytes of a record and of an id), payload (its records, one after another), sha256, and of each record in order doc_ids, pieces, lengths (tokens)."""
    import public_tokenizers

    path = tokenizer or str(public_tokenizers.path("word_bpe_49k.json"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows, total = slots(stored(encoded(docs, id_col=id_col, text_col=text_col, tokenizer=path, length=length, end_id=end_id), "sequences"), key)
    n_shards = -(-total // records)
    parts = max(1, min(n_shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    # even ranges of whole shards: no sampling of the data is needed to find them
    range_of = F.floor(F.floor(F.col("slot") / records) * parts / max(1, n_shards)).cast("int")
    rows = rows.select("slot", "id", "piece", "n", "ids").repartitionById(parts, range_of).sortWithinPartitions("slot")

    def run(batches):
        kind_of = tokens(path).kind
        stride = length * np.dtype(kind_of).itemsize
        held: list[tuple] = []
        id_type = None

        def shard() -> pa.RecordBatch:
            block = np.full((len(held), length), pad_id, kind_of)
            for k, (_, _, _, n, data) in enumerate(held):
                block[k, :n] = np.frombuffer(data, kind_of)
            payload = block.tobytes()
            at = held[0][0]
            columns = [[at // records], [at], [stride], [block.itemsize], [payload], [hashlib.sha256(payload).hexdigest()], [[h[1] for h in held]], [[h[2] for h in held]], [[h[3] for h in held]]]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.list_(id_type), pa.list_(pa.int32()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["shard", "first_slot", "stride", "id_bytes", "payload", "sha256", "doc_ids", "pieces", "lengths"])

        for batch in batches:
            id_type = batch.schema.field(1).type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] // records != held[0][0] // records:
                    yield shard()
                    held = []
                held.append(row)
        if held:
            yield shard()

    return rows.mapInArrow(run, f"shard bigint, first_slot bigint, stride bigint, id_bytes int, payload binary, sha256 string, doc_ids array<{kind}>, pieces array<int>, lengths array<int>")


def write(docs: DataFrame, path: str, **options) -> None:
    """Writes the shards as Parquet files of ascending ranges, uncompressed; the file statistics of `shard` let a reader open few."""
    shards(docs, **options).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str, first_slot: int, count: int, *, records: int = RECORDS) -> DataFrame:
    """slot, ids: records first_slot to first_slot + count - 1, cut from their shards at their bytes; what a resumed run reads next."""
    wanted = spark.read.parquet(path).where(F.col("shard").between(first_slot // records, (first_slot + count - 1) // records))
    each = wanted.select("first_slot", "stride", "id_bytes", "payload", F.posexplode("lengths").alias("at", "n")).where((F.col("first_slot") + F.col("at")).between(first_slot, first_slot + count - 1))
    record = F.substring("payload", (F.col("at") * F.col("stride") + 1).cast("int"), F.col("n") * F.col("id_bytes"))
    return each.select((F.col("first_slot") + F.col("at")).alias("slot"), unpacked(record, F.col("id_bytes")).alias("ids"))


def unpacked(data: Column, id_bytes: Column) -> Column:
    """Column array<int> of little-endian ids of so many bytes each."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch, sizes in batches:
            yield pa.array([np.frombuffer(b, f"<u{k}").tolist() for b, k in zip(batch.to_pylist(), sizes.to_pylist(), strict=True)], pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(data, id_bytes)


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(documents(spark, sf_dir))


QUERIES = {"op9_training_order": op9_training_order}
ORACLE_SQL: dict[str, str] = {}
