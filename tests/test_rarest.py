"""The rarest windows of each text against plain versions."""

import random
import re
from collections import Counter

import pytest

from seqloom.functions.sequences import RESIDUES
from seqloom.operators import rarest
from seqloom.operators.rounds import Rounds


def plain(rows, k, most):
    cut = []
    for i, g, t in rows:
        s = re.sub("[^A-Za-z]", "", t or "").upper()
        own = {}
        for o in range(len(s) - k + 1):
            if set(s[o : o + k]) <= set(RESIDUES):
                own.setdefault(s[o : o + k], []).append(o)
        cut.append((i, g, own))
    n = Counter()
    for _, _, own in cut:
        n.update({w: len(o) for w, o in own.items()})
    first = [(i, g, w, own[w][0], n[w]) for i, g, own in cut for w in sorted(own, key=lambda w: (n[w], w))[:most]]
    return first, Counter((g, n[w]) for _, g, own in cut for w in own)


@pytest.mark.parametrize(("held", "known", "bits"), [(1 << 21, 1 << 20, 24), (50, 40, 6), (400, 0, 24)])
def test_rarest_windows_of_any_text(spark, monkeypatch, held, known, bits):
    monkeypatch.setattr(rarest, "HELD", held)
    monkeypatch.setattr(rarest, "KNOWN", known)
    monkeypatch.setattr(rarest, "BITS", bits)  # at 6 the map is full
    rng = random.Random(11)
    words = ["".join(rng.choice(RESIDUES[:9] + "ao ") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 4, 30, 200]))) for _ in range(70)]
    texts += [texts[5]] * 6 + [texts[9] + "é"] * 3 + [None, "", "ACDEF", "acd ef", "AAAAAAAAAAAAA"] + ["ACDEFG"] * 9
    rows = [(i, rng.choice(["a", "b", "c", None]), t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id bigint, lang string, text string").repartition(3)
    first, back = rarest.rarest(spark, df, "id", "lang", "text", 4, 3)
    from seqloom.operators.tiling import unpacked

    want, groups = plain(rows, 4, 3)
    got = [(r.id, r.lang, r.w, r["first"], r.n_corpus) for r in first.withColumn("w", unpacked("code", 4)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {(r.lang, r.n_corpus): r.texts for r in back.collect()} == groups
    few = rarest.rarest(spark, df.limit(0), "id", "lang", "text", 4, 3)
    assert few[0].count() == few[1].count() == 0


def test_copies_of_a_text_store_no_rows_of_their_own(spark, monkeypatch):
    from seqloom.operators import tiling

    stored, kept = [], Rounds.kept
    monkeypatch.setattr(Rounds, "kept", lambda self, df: stored.append((out := kept(self, df)).count()) or out)
    d = spark.createDataFrame([("ACDEFGHIKLMNPQRSTVWY" * 3 + "AACCDDEEFFGGHHIIKKLL",)], "text string").crossJoin(spark.range(40)).selectExpr("id", "'a' AS lang", "text")
    first, _ = rarest.rarest(spark, d, "id", "lang", "text", 9, 3)
    windows = tiling.packed_windows(d.drop("lang"), "text", 9).count()
    assert first.count() == 120 and max(stored) < windows / 2  # before, the first table had a row for each window of each text
