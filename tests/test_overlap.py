"""Pairs by shared windows, met by rare ones."""

import random

from pyspark.sql import functions as F

from seqloom.operators import overlap


def _plain(queries, refs, k, least):
    cut = lambda s: {s[i : i + k] for i in range(len(s) - k + 1)}
    both = ((q, r, len(cut(q) & cut(r))) for q in set(queries) for r in set(refs))
    return sorted(x for x in both if x[2] >= least)


def test_shared_windows_equal_plain_ones_and_pairs_are_made_once(spark, monkeypatch):
    monkeypatch.setattr(overlap, "CHUNK", 64)
    r = random.Random(3)
    word = lambda: "".join(r.choice(("th", "er", "tion", "a", "é", "ng")) for _ in range(r.randint(1, 12)))
    queries, refs = [word() for _ in range(60)], [word() for _ in range(60)]
    refs += queries[:20] + ["", "abc"]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        for k, least in ((5, 5), (3, 2), (4, 1)):
            q, f = (spark.createDataFrame([(x,) for x in v], f"{c} string") for v, c in ((queries, "query"), (refs, "ref")))
            got = sorted(map(tuple, overlap.shared_kmers(q, f, k, least).collect()))
            assert got == _plain(queries, refs, k, least)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_window_that_all_share_brings_no_pairs_together(spark):
    """Before, every two words met at every window that they share."""
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(9)) + "tions" for _ in range(400)]
    d = spark.createDataFrame([(w,) for w in words], "s string").select("s", F.lit(True).alias("q"), F.lit(True).alias("r"))
    seen = [0] * overlap.SKETCH
    for w in words:
        for x in overlap._windows(w, 5):
            seen[overlap._hash(x) % overlap.SKETCH] += 1
    met = overlap._keys(d, 5, 5, 3, spark.sparkContext.broadcast(seen)).groupBy("key").count().agg(F.sum(F.col("count") * (F.col("count") - 1))).first()[0]
    assert met < len(words)
