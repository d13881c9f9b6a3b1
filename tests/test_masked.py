"""Counts of neighbours by a table of masks."""

import random

from seqloom.operators import neighbours


def test_neighbour_counts_equal_plain_ones_with_a_short_plan(spark):
    r = random.Random(1)
    words = sorted({"".join(r.choice("abc") for _ in range(r.choice([1, 2, 3, 4, 6, 7, 9, 11, 12, 12, 14]))) for _ in range(400)})
    df = spark.createDataFrame([(w,) for w in words], "pep string")
    apart = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    plain = {(w, *(sum(len(v) == len(w) and apart(w, v) == n for v in words) for n in (1, 2))) for w in words}
    assert {(x.pep, x.n1, x.n2) for x in neighbours.neighbour_counts(df, 2).collect()} == plain
    assert neighbours._masked(df, "pep", 2)._jdf.queryExecution().analyzed().toString().count("substring") < 20  # before, thousands, too long to compile
