"""Contact weights, mimics without the query, and the first source of a peptide."""

import random

import pytest

from seqloom.operators import neighbours, recognition
from seqloom.sources import tables


def plain_weights(n, profile, pooled):
    if n in profile:
        frac = list(profile[n])
    else:
        frac, m = [], len(pooled)
        for i in range(n):
            x = (i + 0.5) / n * m - 0.5
            lo = max(0, min(m - 1, int(x // 1)))
            frac.append(pooled[lo] * (1 - (x - lo)) + pooled[min(m - 1, lo + 1)] * (x - lo))
        frac = [f / (sum(frac) or 1.0) for f in frac]
    kept = [f if f >= 1 / (2 * n) else 0.0 for f in frac]
    left = [f for f in kept if f > 0]
    return [f * len(left) / sum(left) for f in kept] if left else [1.0] * n


def test_contact_weights_of_known_and_other_lengths(spark):
    rng = random.Random(2)
    raw = [rng.random() for _ in range(9)]
    profile, pooled = {9: [r / sum(raw) for r in raw], 4: [0.0] * 4}, [0.02, 0.05, 0.2, 0.4, 0.2, 0.1, 0.03]
    df = spark.createDataFrame([("A" * n,) for n in (0, 1, 2, 4, 7, 9, 15)], "pep string")
    for r in df.select("pep", recognition.contact_weights(df["pep"], profile, pooled).alias("w")).collect():
        assert r.w == pytest.approx(plain_weights(len(r.pep), profile, pooled) if r.pep else [])


def test_mimics_without_the_query_itself(spark):
    refs = spark.createDataFrame([("a", "AAAA"), ("a", "AAAC"), ("b", "AAAA"), ("b", "DDDD")], "category string, pep string")
    asked = spark.createDataFrame([("AAAA",)], "pep string")
    told = lambda **k: {r.category: (r.n_exact, r.n_near, r.top_mimic) for r in neighbours.mimics(asked, refs, 1, **k).collect()}
    assert told() == {"a": (1, 1, "AAAC"), "b": (1, 0, None)} and told(exclude_query=True) == {"a": (0, 1, "AAAC")}


def test_first_source_by_order(spark):
    rows = [("AAAAAAAAA", "mhc1", None, "z", 1), ("AAAAAAAAA", "mhc1", None, "b", 2), ("CCCCCCCCC", None, None, None, 1), ("CCCCCCCCC", None, None, "q", 2)]
    df = spark.createDataFrame(rows, "peptide string, mhc_class string, mhc_species string, source_protein string, row int")
    assert {r.peptide: r.source for r in tables.peptides(df, "mhc1").collect()} == {"AAAAAAAAA": "b", "CCCCCCCCC": "q"}
    assert {r.peptide: r.source for r in tables.peptides(df, "mhc1", order="row").collect()} == {"AAAAAAAAA": "z", "CCCCCCCCC": None}


def test_face_windows_by_class_and_mask(spark):
    from seqloom.functions import sequences as S

    rng = random.Random(4)
    peps = ["".join(rng.choice(S.RESIDUES) for _ in range(n)) for n in (1, 2, 3, 4, 5, 6, 8, 9, 11, 15, 20)] + ["SIINFEKL", "AAAKFVAAWTLKAAA", "ACXDEFGHI", ""]
    df = spark.createDataFrame([(p,) for p in peps], "pep string")
    for cls in ("mhc1", "mhc2"):
        for wildcard in (False, True):
            got = df.select("pep", S.best_register("pep").alias("s"), S.face_kmers("pep", 3, cls, wildcard=wildcard).alias("c"), S.face_kmers("pep", 3, "mhc2", register=S.F.lit(1), wildcard=wildcard).alias("one")).collect()
            for r in got:
                for start, codes in ((r.s, r.c), *([(1, r.one)] if cls == "mhc2" else [])):
                    n = len(r.pep)
                    at = {i % n for i in (0, 1, 2, -2, -1)} if cls == "mhc1" and n else {start + i for i in (0, 3, 5, 8)} if cls == "mhc2" and start is not None else set()
                    base = 21 if wildcard else 20
                    face = [20 if i in at else S.RESIDUES.index(c) for i, c in enumerate(r.pep) if wildcard or i not in at] if set(r.pep) <= set(S.RESIDUES) else []
                    assert codes == [face[i] * base**2 + face[i + 1] * base + face[i + 2] for i in range(len(face) - 2)], (r.pep, cls, wildcard)
    assert len(next(r.c for r in df.select("pep", S.face_kmers("pep", 3).alias("c")).collect() if r.pep == "SIINFEKL")) == 1
