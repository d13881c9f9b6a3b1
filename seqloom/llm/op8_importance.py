"""Quality classifier: importance resampling by hashed n-gram generative models.

Two bag models over hashed features, one of the target text (documents labelled good) and one of all raw text, give each
document the mean log ratio of its likelihoods. Features are windows of bytes, hashed into a fixed number of buckets, and
one event for each pair of words that a space parts, equal or not. The raw model counts all documents; the target model takes
a bounded sample of labelled ones. The log weight is that mean on a scale on which the target's own documents spread by 1, which
is about as much as Gumbel noise does: the draw decides among documents that are as like the target as each other, and
not between them and others. Selection is Gumbel top-k: the k largest of log weight plus noise from a hash of the id
stay, which samples k documents without replacement in proportion to their weights. k is taken from the target alone: the
number of documents at or above a low quantile of its log weights, lowered by as much as noise hardly ever takes away, so
that a corpus of target-like text stays whole.

Cases: a null or empty text has no features and a log weight of 0; a text of any length counts by its mean; repeated rows
count as often as they occur, get equal scores and are kept or dropped together, as are all ties at the cut; without good
labels every log weight is 0 and every document stays; an empty table gives an empty result; extra columns are kept by `keep`
and never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.chunks import cut, slices, sums
from seqloom.llm.common import documents, labels, row_key, stored, unused

WINDOW, BUCKETS = 4, 1 << 15
#: Documents labelled good that the target model, the scale and k use at most.
SAMPLE_ROWS = 20_000
#: Quantile of the target's log weights from which documents count for k, and by how much it is lowered: Gumbel noise is below -2 once in 1600 times.
QUANTILE, SLACK = 0.005, 2.0
SMOOTHING, SEED = 1.0, 17
_PAIR = BUCKETS  # and BUCKETS + 1: two different words in a row, the same word twice
N_FEATURES = BUCKETS + 2
#: Features without evidence that each text is given besides its own, so that a short one is close to the mean.
DAMPING = 50.0
#: Bytes of text that are worked on at a time; each makes some forty bytes of arrays.
SLICE_BYTES = 1_000_000
#: A bin of values small enough to fetch whole.
FETCH = 4096


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every window and their number in each text; whether each word equals the one before it, and the number of such pairs."""
    raw = texts.cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    data = np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]] if raw.buffers()[2] is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    sizes = np.diff(ends)
    n = np.maximum(sizes - WINDOW + 1, 0)
    code = np.zeros(max(len(data) - WINDOW + 1, 0), np.uint32)
    for k in range(WINDOW):
        code = code << np.uint32(8) | data[k : k + len(code)]
    inside = np.ones(len(code), bool)
    for k in range(1, WINDOW):  # windows that reach over the end of a text
        at = ends[1:] - k
        inside[at[(at >= 0) & (at < len(code))]] = False
    inside[ends[:-1][(sizes < WINDOW) & (sizes > 0) & (ends[:-1] < len(code))]] = False
    code = code[inside]
    bucket = (code * np.uint32(2654435761)) >> np.uint32(17)
    c = cut(texts)
    same = np.zeros(len(c.place), bool)
    same[1:] = c.place[1:] == c.place[:-1]
    pair = np.ones(len(c.place), bool)
    pair[np.cumsum(c.per_text) - c.per_text] = False
    return bucket.astype(np.int64), n, same[pair], c.per_text - 1


def counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """Occurrences of each feature over all rows: one row for each bucket and task is shuffled, one for each bucket reaches the driver."""

    def run(batches):
        total = np.zeros(N_FEATURES, np.int64)
        for batch in batches:
            for part in slices(batch.column(0), SLICE_BYTES):
                bucket, _, same, _ = features(part)
                total[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                total[_PAIR] += (~same).sum()
                total[_PAIR + 1] += same.sum()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(N_FEATURES)
    for r in docs.select(F.col(text_col).alias("_text")).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Of each feature; windows and word pairs are models of their own."""
    if not target.sum():
        return np.zeros(N_FEATURES)
    out = np.zeros(N_FEATURES)
    for part in (slice(0, BUCKETS), slice(BUCKETS, N_FEATURES)):
        t, r = target[part] + SMOOTHING, raw[part] + SMOOTHING
        out[part] = np.log(t / t.sum()) - np.log(r / r.sum())
    return out


def mean_ratio(text: Column, ratios: np.ndarray) -> Column:
    """Column of the mean log ratio of likelihoods of a text column's features."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [np.zeros(0)]
            for part in slices(batch, SLICE_BYTES):
                bucket, n, same, pairs = features(part)
                total = sums(ratios[bucket], n) + sums(np.where(same, ratios[_PAIR + 1], ratios[_PAIR]), pairs)
                found.append(np.round(total / (n + pairs + DAMPING), 9))
            yield pa.array(np.concatenate(found), pa.float64())

    return F.arrow_udf(run, "double").asNondeterministic()(text)


def gumbel(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise drawn from a hash of the key: the same in every run and on every executor."""
    unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.round(-F.log(-F.log(unit)), 6)


def kth_largest(values: DataFrame, column: str, k: int) -> float:
    """Exact, by counting in ever finer bins; a bin of at most FETCH values is fetched."""
    low, high = values.agg(F.min(column), F.max(column)).first()
    while low < high:
        step = (high - low) / 1024
        x = F.col(column)
        inside = values.where((x >= low) & (x <= high))
        rows = sorted(inside.groupBy(F.least(F.lit(1023), F.floor((x - low) / step)).alias("b")).agg(F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high")).collect(), key=lambda r: -r.b)
        for r in rows:
            if k <= r.n:
                break
            k -= r.n
        low, high = r.low, r.high
        if r.n <= FETCH:
            return sorted((v[0] for v in inside.where((x >= low) & (x <= high)).select(column).collect()), reverse=True)[k - 1]
    return low


def target_scale(means: np.ndarray) -> tuple[float, float]:
    """Factor from mean ratios to log weights, by which the middle half of the target spreads as a normal law of deviation 1 does, and the log weight from which documents count for k."""
    if not len(means):
        return 0.0, 0.0
    low, first, third = np.quantile(means, [QUANTILE, 0.25, 0.75], method="inverted_cdf")
    factor = float(1.349 / max(third - first, 1e-6))
    return factor, float(low * factor - SLACK)


def select(docs: DataFrame, marked: DataFrame, **options) -> DataFrame:
    """id, log_weight, perturbed, kept: one row per document."""
    return verdicts(docs, marked, **options).drop("_row")


def verdicts(docs: DataFrame, marked: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of select with _row, the digest of id and text by which each has its verdict. Rows of one id share its noise; a row without an id has its own."""
    known = marked.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.min(label_col) == 1).alias("_good"))
    good = F.broadcast(known.where("_good").orderBy(F.xxhash64("_id"), "_id").limit(sample_rows).select("_id"))  # at most sample_rows ids
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    ratios = log_ratios(counts(texts.join(good, "_id", "left_semi"), "_text"), counts(texts, "_text"))
    scored = stored(texts.select("_id", row_key("_id", "_text").alias("_row"), mean_ratio(F.col("_text"), ratios).alias("_mean")), "weights")
    target = scored.join(good, "_id", "left_semi").groupBy("_id").agg(F.min("_mean").alias("m")).toPandas()
    factor, cut_at = target_scale(target.m.to_numpy(float) if ratios.any() else np.zeros(0))
    noise = F.when(F.col("_id").isNull(), gumbel(F.col("_row"))).otherwise(gumbel(F.col("_id")))
    scored = scored.withColumn("log_weight", F.round(F.col("_mean") * factor, 6)).withColumn("perturbed", F.round(F.col("log_weight") + noise, 6))
    k = scored.where(F.col("log_weight") >= cut_at).count()
    least = kth_largest(scored, "perturbed", k) if k else np.inf
    return scored.select(F.col("_id").alias(id_col), "log_weight", "perturbed", (F.col("perturbed") >= float(least)).alias("kept"), "_row")


def keep(docs: DataFrame, marked: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that the selection keeps, with all their columns, each by the verdict of its own id and text."""
    name = unused(docs, "_key")
    kept = verdicts(docs, marked, id_col=id_col, text_col=text_col, **options).where("kept").select(F.col("_row").alias(name)).distinct()
    return docs.withColumn(name, row_key(id_col, text_col)).join(kept, name, "left_semi").select(*docs.columns)


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(documents(spark, sf_dir), labels(spark, sf_dir))


QUERIES = {"op8_importance_resampling": op8_importance_resampling}
ORACLE_SQL: dict[str, str] = {}
