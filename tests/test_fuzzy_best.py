"""The best references by fuzzy windows, against all of them."""

import random

import pyarrow as pa
import pytest

from seqloom.operators import neighbours


def _strings():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("ABCDZ") for _ in range(rng.randint(1, 14)))
    return [word() for _ in range(40)] + ["ABCDE", "A" * 300, "AB"], [word() for _ in range(150)] + ["ABCDE", "XABCDE", "A" * 400, "ABCD", "ABCDE"]


@pytest.mark.parametrize(("k", "subs", "unit", "asked"), [(5, 1, 1 << 15, 1 << 12), (4, 1, 40, 15), (3, 0, 40, 1 << 12)])
def test_best_are_the_first_of_all(spark, monkeypatch, k, subs, unit, asked):
    monkeypatch.setattr(neighbours, "UNIT", unit)
    monkeypatch.setattr(neighbours, "ASKED", asked)
    queries, refs = _strings()
    q, r = spark.createDataFrame([(x,) for x in [*queries, None]], "query string"), spark.createDataFrame([(x,) for x in {*refs}], "ref string")
    rows = lambda df: sorted(tuple(x) for x in df.select("query", "ref", "shared", "score", "place").collect())
    assert rows(neighbours.fuzzy_best(q, r, k, 4, subs=subs)) == rows(neighbours.fuzzy_kmers(q, r, k, subs=subs).where("place <= 4"))
    assert rows(neighbours.fuzzy_best(q, r.limit(0), k, 4, subs=subs)) == rows(neighbours.fuzzy_best(q.limit(0), r, k, 4, subs=subs)) == []
    with pytest.raises(ValueError):
        neighbours.fuzzy_best(q, r, k, 4, subs=2)


def test_a_unit_gives_the_best_alone_however_it_is_counted(monkeypatch):
    queries, refs = _strings()
    a, b = pa.array(sorted({*queries})), pa.array(sorted({*refs}))
    whole = neighbours._unit(a, b, 4, 1, 3)
    assert max(list(whole[0]).count(x) for x in set(whole[0])) == 3  # before, a row for each pair and window
    monkeypatch.setattr(neighbours, "PAIRS", 20)
    assert sorted(zip(*neighbours._unit(a, b, 4, 1, 3), strict=True)) == sorted(zip(*whole, strict=True))
