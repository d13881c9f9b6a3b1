"""Token counts behind a digest cache.

The cache is a table (content_digest, tokenizer_digest, n_tokens). Texts are digested in the JVM, joined to the cache,
and only the distinct texts that it lacks are encoded and appended; then every document takes its count from the cache.
Content is normalised as far as that changes no count, which is: a null text is the empty one. A digest is SHA-256, the
tokenizer's digest covers its file, so another version never takes another's counts.

A missing text crosses one shuffle, made distinct on the map side first, so a text that a third of the rows share sends
one row from each task. Counts are a table of their own before they join back by digest: only between two shuffles, with no
aggregate in between, does adaptive execution split the rows of a hot digest.

Cases: null and empty texts have 0 tokens; repeated rows are each returned; empty tables give empty results; a very
long text is encoded alone in its batch; extra columns are never read.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.chunks import Cache, cut, slices, sums, tangled
from seqloom.llm.common import documents, shared_folder, stored, text_or_empty

LIMIT = 512
CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens bigint"


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class Counter:
    """Counts of whole texts, as the tokenizers library gives them without added special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.inner, self.first = Cache(lambda p: self.whole([f" {x}" for x in p])), Cache(self.whole, 50_000)

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        odd = tangled(texts, self.specials)
        if odd.any():
            out[odd] = [self.whole([t])[0] for t in texts.filter(pa.array(odd)).to_pylist()]
        plain = texts.filter(pa.array(~odd))
        if len(plain):
            c = cut(plain)
            counts = np.array(self.inner.values(c.distinct), np.int64)[c.place]
            head = np.cumsum(c.per_text) - c.per_text
            counts[head] = self.first.values([c.distinct[i] for i in c.place[head].tolist()])
            out[~odd] = sums(counts, c.per_text)
        return out


#: One for each worker process; its caches serve all tasks that run there.
_COUNTERS: dict[str, Counter] = {}


def count_tokens(text, path: str):
    """Column of the number of tokens of a text column."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(path)
        counter = _COUNTERS[path]
        for batch in batches:
            yield pa.array(np.concatenate([np.zeros(0, np.int64), *(counter(s) for s in slices(batch))]), pa.int64())

    return F.arrow_udf(run, "bigint")(text)


def token_counts(docs: DataFrame, cache_path: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "", limit: int = LIMIT) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit; the cache at cache_path grows by the texts that it lacked."""
    spark, path = docs.sparkSession, tokenizer or tokenizer_file()
    version = file_digest(path)
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    cached = lambda: spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer_digest") == version).drop("tokenizer_digest")
    text = text_or_empty(text_col)
    digest = F.unhex(F.sha2(text, 256))
    texts = docs.select(digest.alias("content_digest"), text.alias("_text"))
    # one text of each digest, taken before the shuffle as well as after it
    missing = texts.groupBy("content_digest").agg(F.first("_text").alias("_text")).join(cached(), "content_digest", "left_anti")
    missing.select("content_digest", F.lit(version).alias("tokenizer_digest"), count_tokens(F.col("_text"), path).alias("n_tokens")).write.mode("append").parquet(cache_path)
    # two runs that miss the same text at once both append it, with the same count
    counts = stored(cached().groupBy("content_digest").agg(F.first("n_tokens").alias("n_tokens")), "counts")
    keyed = docs.select(F.col(id_col), digest.alias("content_digest"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    return keyed.join(counts, "content_digest").select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of its own for each call, so that every text of the table is encoded."""
    return token_counts(documents(spark, sf_dir), f"{shared_folder(spark)}/token-cache-{uuid.uuid4().hex}")


QUERIES = {"op2_token_counts": op2_token_counts}
ORACLE_SQL: dict[str, str] = {}
