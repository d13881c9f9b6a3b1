"""Assembled scorers: what is built, what is read, and the ranks against a plain version."""

import math
import random
import shutil

import pytest
from pyspark.sql import functions as F

from seqloom.operators import calibration, scorer


def model_frame(spark, shift=None):
    rows = [(a, 0, {"1:A": 0.5 + i, "1:C": -0.25 * i}, 0.125 + (0.5 if a == shift else 0)) for i, a in enumerate("xyz")]
    return spark.createDataFrame(rows, "allele string, length int, table map<string, double>, term double")


def by_letters(letters, seen=None):
    def head(rows):
        if seen is not None:
            seen.extend((r.allele, r.length) for r in rows.select("allele", "length").distinct().collect())
        return rows.withColumn("score", sum((F.size(F.split("pep", x)) - 1.0) * w for x, w in letters.items()) + F.ascii("allele") / 1000.0)

    return head


def test_null_peptides_are_the_same_on_every_run_and_follow_their_weights(spark):
    draw = lambda **k: sorted((r.no, r.length, r.pep) for r in scorer.null_peptides(spark, 400, {"A": 3.0, "C": 1.0}, {8: 1.0, 9: 3.0}, **k).collect())
    one, each = draw(seed=4), draw(seed=4, each=True)
    assert one == draw(seed=4) and one != draw(seed=5) and {r[1] for r in one} == {0} and [r[1] for r in each].count(8) == 400
    letters = "".join(r[2] for r in one)
    assert 0.72 < letters.count("A") / len(letters) < 0.78 and 0.68 < sum(len(r[2]) == 9 for r in one) / 400 < 0.82
    assert all(len(p) == n for _, n, p in each)


def test_a_second_build_builds_nothing_and_a_changed_model_its_alleles_only(spark, tmp_path):
    c = scorer.Calibrations(spark, f"file://{tmp_path}/cal")
    nulls = scorer.null_peptides(spark, 50, {"A": 1.0, "C": 1.0}, {8: 1.0, 9: 1.0}, each=True)
    seen = []
    head = by_letters({"A": 1.0}, seen)
    before = scorer.fingerprints(model_frame(spark), "v1")
    assert c.build("p", before, nulls, head) == 6 and c.build("p", before, nulls, head) == 0 and len(seen) == 6
    after = scorer.fingerprints(model_frame(spark, "y"), "v1")
    assert c.build("p", after, nulls, head) == 2 and set(seen[6:]) == {("y", 8), ("y", 9)}
    assert c.build("q", before, nulls, head) == 6 and c.build("p", scorer.fingerprints(model_frame(spark), "v2"), nulls, head) == 6
    rows = c.rows("p", after).collect()
    assert sum(r.n for r in rows) == 3 * 100 and {(r.allele, r.length) for r in rows} == {(a, n) for a in "xyz" for n in (8, 9)}
    assert {r.ok for r in c.check().collect()} == {True} and c.check().count() == 20


def test_damaged_and_unlisted_parts_are_told(spark, tmp_path):
    c = scorer.Calibrations(spark, f"file://{tmp_path}/cal")
    nulls = scorer.null_peptides(spark, 20, {"A": 1.0, "C": 1.0}, {8: 1.0})
    prints = scorer.fingerprints(model_frame(spark), "v1")
    c.build("p", prints, nulls, by_letters({"A": 1.0}))
    [listed] = list((tmp_path / "cal" / "parts").iterdir())
    spark.read.parquet(str(listed)).withColumn("n", F.col("n") + 1).write.parquet(str(tmp_path / "cal" / "parts" / ("part-" + "0" * 32)))  # lost before it was listed
    assert sum(r.n for r in c.rows("p", prints).collect()) == 60 and {r.ok for r in c.check().collect()} == {True}
    spark.read.parquet(str(listed)).where("allele <> 'z'").write.parquet(str(tmp_path / "less"))
    shutil.rmtree(listed)
    shutil.move(tmp_path / "less", listed)
    assert {(r.allele, r.ok) for r in c.check().collect()} == {("x", True), ("y", True), ("z", False)}
    # a key without a usable score is listed with no rows and not built again
    empty = lambda rows: rows.withColumn("score", F.lit(float("-inf")))
    assert c.build("none", prints, nulls, empty) == 3 and c.build("none", prints, nulls, empty) == 0 and c.rows("none", prints).count() == 0


def test_binder_scores_against_a_plain_version(spark, tmp_path):
    rng = random.Random(7)
    c = scorer.Calibrations(spark, f"file://{tmp_path}/cal")
    nulls = scorer.null_peptides(spark, 120, {"A": 1.0, "C": 1.0, "D": 2.0}, {6: 1.0, 7: 1.0}, seed=1)
    one, two = by_letters({"A": 1.0, "C": 0.25}), by_letters({"D": 1.0, "A": 0.5})
    prints = scorer.fingerprints(model_frame(spark), "both").where("allele <> 'z'")
    asked = [("".join(rng.choice("ACDE") for _ in range(6)), a) for a in "xyz" for _ in range(15)]
    known = [(a, "AADADA") for a in "x" for _ in range(30)] + [("x", "CCCDDD")]
    got = {(r.pep, r.allele): r for r in scorer.binder_scores(spark.createDataFrame(asked, "pep string, allele string"), c, prints, nulls, one, two, positives=spark.createDataFrame(known, "allele string, pep string")).collect()}
    assert got.keys() == {k for k in asked if k[1] != "z"}  # z has no null
    f = lambda p, w, a: sum(p.count(x) * v for x, v in w.items()) + ord(a) / 1000
    null = [r.pep for r in nulls.collect()]
    rank = lambda values, v: 100 * sum(x > v + 1e-12 for x in values) / len(values)
    for (p, a), r in got.items():
        w1, w2 = {"A": 1.0, "C": 0.25}, {"D": 1.0, "A": 0.5}
        n1, n2 = [f(q, w1, a) for q in null], [f(q, w2, a) for q in null]
        both = lambda q, a=a, w1=w1, w2=w2, n1=n1, n2=n2: round(-math.log(max(rank(n1, f(q, w1, a)), 1e-9)) - math.log(max(rank(n2, f(q, w2, a)), 1e-9)), 9)
        assert r.presentation_rank == pytest.approx(rank(n1, f(p, w1, a))) and r.affinity_rank == pytest.approx(rank(n2, f(p, w2, a)))
        want = rank([both(q) for q in null], both(p))
        assert r.binder_rank == pytest.approx(want) and r.band == ("strong" if want <= 0.5 else "weak" if want <= 2 else "none")
        assert 0 <= r.p_binder <= 1 and (a == "x" or r.p_binder == pytest.approx(1 - want / 100))


def test_ranks_within_a_length_and_unknown_alleles(spark):
    nulls = spark.createDataFrame([("x", 3, 1.0, 5, 0), ("x", 3, 2.0, 5, 0), ("x", 4, 1.0, 1, 0)], "allele string, length int, score double, n bigint, m bigint")
    rows = spark.createDataFrame([("AAA", "x", 1.0), ("AAA", "x", 1.5), ("AAAA", "x", 1.5), ("AAAA", "x", 0.5), ("AA", "x", 1.0), ("AAA", "y", 1.0), ("AAA", "x", None)], "pep string, allele string, score double")
    got = sorted((r.pep, r.allele, r.score or 0, r.rank) for r in scorer.ranked(rows, nulls, "rank", by_length=True).collect())
    assert got == [("AA", "x", 1.0, None), ("AAA", "x", 0, None), ("AAA", "x", 1.0, 50.0), ("AAA", "x", 1.5, 50.0), ("AAA", "y", 1.0, None), ("AAAA", "x", 0.5, 100.0), ("AAAA", "x", 1.5, 0.0)]


def test_isotonic_blocks_of_ranges_are_those_of_the_whole(spark):
    rng = random.Random(9)
    rows = [(k, rng.choice([0.5, 1.0]) * rng.randint(0, 400), float(rng.random() < 0.3)) for k in "ab" for _ in range(900)]
    got = {r.k: [(s.x, s.y) for s in r.steps] for r in calibration.isotonic_steps(spark.createDataFrame(rows, "k string, x double, y double"), "x", "y", ["k"]).collect()}
    for k in "ab":
        points = {}
        for kk, x, y in rows:
            if kk == k:
                s, n = points.get(x, (0, 0))
                points[x] = (s + y, n + 1)
        stack = []
        for x, (s, n) in sorted(points.items()):
            stack.append([x, s, n])
            while len(stack) > 1 and stack[-2][1] * stack[-1][2] >= stack[-1][1] * stack[-2][2]:
                _, s, n = stack.pop()
                stack[-1][1:] = [stack[-1][1] + s, stack[-1][2] + n]
        assert got[k] == [(x, s / n) for x, s, n in stack]
