"""Packed windows and halved bounds against plain versions."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seqloom.functions.sequences import RESIDUES
from seqloom.operators import calibration, ordered, tiling


def test_packed_windows_of_any_text(spark, monkeypatch):
    rng = random.Random(3)
    letters = RESIDUES + RESIDUES.lower() + "BJOUXZ" + " .,\n0é漢"
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 9, 40, 400]))) for _ in range(80)] + [None, "", "ACDEFGHIK" * 300, "éé" * 50, "ACDEFGHIKLMNPQRSTVWY"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, code string").repartition(3)
    for k, size in ((1, 4_000_000), (9, 4_000_000), (5, 100)):
        monkeypatch.setattr(tiling, "SLICE", size)
        got = {(r.doc_id, r.kmer): (r.n, r.first) for r in tiling.packed_windows(df.drop("code"), "text", k).select("doc_id", tiling.unpacked("code", k).alias("kmer"), "n", "first").collect()}
        want, first = Counter(), {}
        for i, t in enumerate(texts):
            s = re.sub("[^A-Za-z]", "", t or "").upper()
            for o in range(len(s) - k + 1):
                w = s[o : o + k]
                if set(w) <= set(RESIDUES):
                    want[i, w] += 1
                    first.setdefault((i, w), o)
        assert got == {key: (n, first[key]) for key, n in want.items()}
    codes = tiling.packed_windows(df.drop("code"), "text", 3).select("code", tiling.unpacked("code", 3).alias("w")).distinct().orderBy("code").collect()
    assert [r.w for r in codes] == sorted(r.w for r in codes)
    with pytest.raises(ValueError):
        tiling.packed_windows(df, "text", 10)
    assert tiling.packed_windows(df.limit(0), "text", 3).count() == 0


def test_bounds_by_halving(spark):
    xs = [float("-inf"), -2.0, 0.0, 0.5, 1.0, 3.0, 7.0, float("inf"), float("nan")]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for bounds in ([], [0.0], [-2.0, 0.5], [-1.0, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0]):
        got = [r.b for r in df.select(ordered._below(F.col("x"), bounds, 0).alias("b")).collect()]
        assert got == [len(bounds) if x != x else sum(b <= x for b in bounds) for x in xs]


def test_percent_ranks_with_weights_and_null_keys(spark):
    rng = random.Random(5)
    back = [(rng.choice(["a", "b", None]), rng.randint(0, 30) / 2, rng.randint(1, 9)) for _ in range(300)] + [("a", None, 4)]
    asked = [(k, x) for k in ("a", "b", "c", None) for x in (-1.0, 0.0, 7.25, 15.0, 99.0, None)]
    for weight in (None, "n"):
        got = calibration.percent_rank(spark.createDataFrame(asked, "k string, score double"), spark.createDataFrame(back, "k string, score double, n int"), ["k"], weight=weight).collect()
        for r in got:
            own = [(s, n if weight else 1) for k, s, n in back if k == r.k and s is not None]
            want = 100 * sum(n for s, n in own if s > r.score) / sum(n for _, n in own) if own and r.score is not None and r.k is not None else None
            assert r.pct_rank == (want if want is None else pytest.approx(want))


def _texts(spark):
    import random

    r = random.Random(9)
    word = lambda n: "".join(r.choice("abcdeXé -Z") for _ in range(n))
    texts = [word(r.randint(0, 700)) for _ in range(30)] + [None, "", "é"]
    letters = ["".join(c for c in t or "" if c.isascii() and c.isalpha()).upper() for t in texts]
    return spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").repartition(3), letters


def test_letter_counts_equal_plain_ones_and_a_task_adds_up_its_own(spark):
    from collections import Counter

    df, letters = _texts(spark)
    for k in (2, 6):
        plain = Counter(w for s in letters for w in (s[i : i + k] for i in range(len(s) - k + 1)) if set(w) <= set("ACDEFGHIKLMNPQRSTVWY"))
        assert {r.kmer: r.n for r in tiling.letter_counts(df, "text", k).collect()} == plain
    assert "Generate" not in tiling.letter_counts(df, "text", 5)._jdf.queryExecution().toString()  # before, a row for each window


@pytest.mark.parametrize("bits", [24, 6])
def test_windows_among_are_all_that_are_wanted(spark, monkeypatch, bits):
    monkeypatch.setattr(tiling, "BITS", bits)  # at 6 the map is full
    df, letters = _texts(spark)
    wanted = {s[i : i + k] for s in letters[:9] for i in range(0, max(len(s) - 8, 0), 50) for k in (8, 3)} | {"QQQ"}
    cut = tiling.windows_among(df, "text", spark.createDataFrame([(w,) for w in wanted], "w string"), [3, 8], kmer="w", offset="o").collect()
    plain = {(i, s[o : o + k], o) for i, s in enumerate(letters) for k in (3, 8) for o in range(len(s) - k + 1)}
    got = {(r.id, r.w, r.o) for r in cut}
    assert got <= plain and {x for x in plain if x[1] in wanted} <= got and len(got) == len(cut)
    assert bits == 6 or len(got) < 2 * sum(x[1] in wanted for x in plain)  # before, every window became a row
    once = [r.w for r in tiling.windows_among(df.coalesce(1), "text", spark.createDataFrame([(w,) for w in wanted], "w string"), [3, 8], kmer="w", distinct=True).collect()]
    assert sorted(once) == sorted({x[1] for x in got})
