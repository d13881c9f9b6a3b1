"""Document fingerprints by content-defined chunking.

A gear hash over the UTF-8 bytes, whose value depends on the last 32 bytes only, marks where chunks may end. Boundaries are
normalised: up to the normal length a stricter mask has to match, beyond it an easier one, so that lengths gather around
the normal one and a local edit moves no boundary beyond its neighbourhood. A fingerprint is the set of chunk digests, each
with its length; likeness is containment, the part of one fingerprint's length whose digests the other has as well.

The query needs the text that comes next in descending order of ids. Documents are range-partitioned once by id and, within
equal or null ids, by the beginning of the text, by bounds from a bounded sample, which only even out the ranges. Inside a
task the next document is the next row; a copy of the first row of the following range, one for each range, goes along as
the last row of the range before it. Only rows that are equal in id and in the beginning of the text share a task whatever
their number.

Cases: a null text is the empty one, whose fingerprint is the empty string; two empty fingerprints are wholly alike, an
empty one and another not at all; rows with equal ids follow each other by text; null ids come last, by text as well; a single document is
followed by itself; an empty table gives an empty result; extra columns are never read.
"""

from __future__ import annotations

import hashlib
import random
from bisect import bisect_right
from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import documents, text_or_empty

#: Lengths of chunks in bytes: least, normal, most; bits of the masks before and after the normal length.
LEAST, NORMAL, MOST, STRICT_BITS, EASY_BITS = 12, 32, 128, 6, 4
#: Rows sampled for each range, on average; characters of a text by which rows of one id are dealt out.
SAMPLED, BEGIN = 50, 48
_draw = random.Random(2024)
GEAR = np.array([_draw.getrandbits(32) for _ in range(256)], np.uint32)


def gear_hashes(data: bytes) -> np.ndarray:
    """h[i] = sum of GEAR[data[i - k]] << k over the last 32 bytes, by doubling the span that is summed."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)  # the right side is evaluated before the sum is stored
    return h


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of data; the last one is its length."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = gear_hashes(data)
    easy = np.flatnonzero(h >> np.uint32(32 - EASY_BITS) == 0)
    strict = easy[h[easy] >> np.uint32(32 - STRICT_BITS) == 0]
    easy, strict = (easy + 1).tolist(), (strict + 1).tolist()
    ends, at, i, j = [], 0, 0, 0
    while n - at > LEAST:
        while j < len(strict) and strict[j] < at + LEAST:
            j += 1
        if j < len(strict) and strict[j] < at + NORMAL:
            end = strict[j]
        else:
            while i < len(easy) and easy[i] < at + NORMAL:
                i += 1
            end = min(easy[i] if i < len(easy) else n, at + MOST, n)
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def chunks(data: bytes) -> dict[str, int]:
    """Chunk digests and the lengths of their chunks in bytes."""
    out, at = {}, 0
    for end in chunk_ends(data):
        out[xxhash.xxh3_64_hexdigest(data[at:end])[:12]] = end - at
        at = end
    return out


def written(found: dict[str, int]) -> str:
    """digest.length, sorted and joined by spaces."""
    return " ".join(f"{d}.{n}" for d, n in sorted(found.items()))


def parsed(fingerprint: str) -> dict[str, int]:
    return {d: int(n) for d, _, n in (x.partition(".") for x in fingerprint.split())}


def likeness(a: dict[str, int], b: dict[str, int]) -> float:
    """Part of a's length whose chunks b has."""
    if not a:
        return 0.0 if b else 1.0
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


def fingerprint(text):
    """Column of the fingerprint of a text column."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([written(chunks(t or b"")) for t in batch.cast(pa.binary()).to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(text)


def containment(left, right):
    """Column: containment of the fingerprint column left in right."""

    def run(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in pairs:
            yield pa.array([likeness(parsed(x or ""), parsed(y or "")) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    return F.arrow_udf(run, "double")(left, right)


def edited(text: str, following: str) -> str:
    """The last half of text, rounded down, replaced by the first as many code points of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_RESULT_DDL = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(text: str, own: dict[str, int], following: str, others: dict[str, int]) -> tuple:
    changed = edited(text, following).encode()
    marks = chunks(changed)
    return len(text), hashlib.sha256(changed).hexdigest(), written(own), written(marks), likeness(own, marks), likeness(own, others)


def _order(a: tuple, b: tuple) -> int:
    """Of (id, beginning of the text): falling ids, null ones last, then rising texts."""
    if a[0] != b[0]:
        return 1 if a[0] is None else -1 if b[0] is None else 1 if a[0] < b[0] else -1
    return (a[1] > b[1]) - (a[1] < b[1])


def _ranges(rows: DataFrame, parts: int) -> tuple:
    """Function from columns of ids and beginnings of texts to the number of their range."""
    # each row is drawn by itself, so that about SAMPLED rows of each range come to the driver, whatever the number of tasks and of copies
    share = min(1.0, SAMPLED * parts / max(1, rows.count()))
    sample = sorted((tuple(r) for r in rows.select("id", "begin").sample(share, seed=1).collect()), key=cmp_to_key(_order))
    bounds = sorted({sample[len(sample) * k // parts] for k in range(1, parts)}, key=cmp_to_key(_order)) if sample else []

    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        # bounds by falling id; the few of one id, and of none, by text
        ids = sorted({b[0] for b in bounds if b[0] is not None})
        texts = {i: [b[1] for b in bounds if b[0] == i] for i in {b[0] for b in bounds}}
        above = {i: sum(_order(b, (i, "")) < 0 for b in bounds) for i in texts}  # bounds before those of that id
        none = above.get(None, len(bounds))
        for id_batch, begins in columns:
            out = []
            for i, t in zip(id_batch.to_pylist(), begins.to_pylist(), strict=True):
                if i is None:
                    out.append(none + bisect_right(texts.get(None, []), t))
                elif i in texts:
                    out.append(above[i] + bisect_right(texts[i], t))
                else:
                    k = bisect_right(ids, i)
                    out.append(above[ids[k - 1]] if k else none)
            yield pa.array(out, pa.int32())

    return F.arrow_udf(run, "int"), len(bounds) + 1


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("begin", F.substring("text", 1, BEGIN))
    range_of, n = _ranges(rows, partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("range", range_of("id", "begin")).drop("begin")
    # the highest id of each range that has rows, null only where all are: as many as there are ranges
    first = {r.range: r.id for r in rows.groupBy("range").agg(F.max("id").alias("id")).collect()}
    used = sorted(first)
    before = {k: used[i - 1] for i, k in enumerate(used)}  # before the first range stands the last
    heads = spark.createDataFrame([(k, before[k], first[k]) for k in used], f"_range int, before int, _id {kind}")
    borrowed = rows.join(F.broadcast(heads), (rows["range"] == heads["_range"]) & rows["id"].eqNullSafe(heads["_id"])).groupBy(F.col("before").alias("range")).agg(F.min("text").alias("text"))  # the least text of that id
    all_rows = rows.select("range", F.lit(0).alias("last"), "id", "text").unionByName(borrowed.select("range", F.lit(1).alias("last"), F.lit(None).cast(kind).alias("id"), "text"))
    dealt = all_rows.repartitionById(n, "range").sortWithinPartitions("range", "last", F.desc_nulls_last("id"), "text")

    def run(batches):
        held = None
        for batch in batches:
            ids, out = [], []
            for last, i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = chunks(text.encode())
                if held:
                    ids.append(held[0])
                    out.append(_compare(held[1], held[2], text, found))
                held = None if last else (i, text, found)
            columns = list(zip(*out, strict=True)) or [()] * len(_RESULT)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(1).type), *(pa.array(c, t) for c, (_, t) in zip(columns, _RESULT, strict=True))], names=["id", *(name for name, _ in _RESULT)])

    return dealt.select("last", "id", "text").mapInArrow(run, f"id {kind}, {_RESULT_DDL}").withColumnRenamed("id", id_col)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(documents(spark, sf_dir))


QUERIES = {"op10_fingerprints": op10_fingerprints}
ORACLE_SQL: dict[str, str] = {}
