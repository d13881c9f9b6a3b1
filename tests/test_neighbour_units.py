"""Counts of neighbours in units of strings that share two pieces."""

import random
from collections import Counter
from itertools import combinations

from seqloom.operators import neighbours


def apart(a, b):
    return sum(x != y for x, y in zip(a, b, strict=True)) if len(a) == len(b) else -1


def changed(r, word, n, letters):
    out = list(word)
    for i in r.sample(range(len(out)), n):
        out[i] = r.choice(letters)
    return "".join(out)


def test_neighbours_of_odd_and_long_strings_are_counted_without_joins(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LETTERS", 2000)  # many units
    r = random.Random(5)
    words = {"", "A", "a", "é", "ß", "AB", "Aé", "𝄞é", "𝄞b", "A" * 33, "A" * 32 + "B"}
    for size, letters in ((4, "ABC"), (8, "AB𝄞"), (13, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (16, "AB"), (25, "ABé"), (32, "XYZ"), (33, "XYZ"), (40, "Aé𝄞"), (90, "AB")):
        base = "".join(r.choice(letters) for _ in range(size))
        words |= {changed(r, base, r.choice([0, 1, 1, 2, 3, 4]), letters) for _ in range(25)}
    df = spark.createDataFrame([(w,) for w in sorted(words)] + [("A",), (None,)], "pep string")
    for d in (1, 2, 3):
        found = neighbours.neighbour_counts(df, d)
        assert "Join" not in found._jdf.queryExecution().analyzed().toString()  # before, several
        plain = {x: tuple(sum(apart(x, y) == k for y in words) for k in range(1, d + 1)) for x in words}
        assert {x.pep: tuple(x[f"n{k}"] for k in range(1, d + 1)) for x in found.collect()} == plain


def test_long_words_of_one_ending_make_no_pairs(spark):
    r = random.Random(6)
    words = sorted({"".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(9)) + "ENDING" for _ in range(3000)} | {w + "ABCDEFENDING" for w in ("AAA", "AAB", "ABB", "BBB")})
    found = neighbours.neighbour_counts(spark.createDataFrame([(w,) for w in words], "pep string"), 2)
    near = {}
    for k in (0, 1, 2):  # a string meets those that lack the same places
        for x in words:
            for m in combinations(range(15), k) if k else ():
                near.setdefault((m, "".join(c for i, c in enumerate(x) if i not in m)), set()).add(x)
    pairs = {(x, y) for same in near.values() if len(same) > 1 for x in same for y in same if x != y}
    plain = Counter((x, apart(x, y)) for x, y in pairs)
    assert {(x.pep, x.n1, x.n2) for x in found.collect()} == {(x, plain[x, 1], plain[x, 2]) for x in words}
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()  # before, 3,000 x 3,000 pairs by the ending
