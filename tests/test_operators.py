"""Operators against brute force on seeded small inputs."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from seqloom.operators import calibration, cassette, counts, density, neighbours, ordered, portfolio, presentation, ranking, tiling

AA = "ACDEFGHIKLMNPQRSTVWY"


def peptides(seed, n, lengths=(8, 9, 10), letters=AA):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.choice(lengths))) for _ in range(n)]


def strings(spark, rows, name):
    return spark.createDataFrame([(r,) for r in rows], f"{name} string")


def test_hamming_join(spark):
    a, b = peptides(1, 120, letters="ACD"), [*peptides(2, 150, letters="ACD"), *peptides(1, 120, letters="ACD")[:20]]
    for d in (0, 1, 2, 3):
        got = sorted((r.query, r.ref, r.dist) for r in neighbours.hamming_join(strings(spark, a, "query"), strings(spark, b, "ref"), d).collect())
        dist = lambda x, y: sum(p != q for p, q in zip(x, y))
        assert got == sorted((x, y, dist(x, y)) for x in set(a) for y in set(b) if len(x) == len(y) and dist(x, y) <= d)
    near = {r.query: (r.dist, r.nearest, r.n_within) for r in neighbours.nearest(strings(spark, ["GILGFVFTL", "WWWWWWWWW"], "query"), strings(spark, ["GILGFVFTA", "DDDDDDDDD"], "ref"), 2).collect()}
    assert near == {"GILGFVFTL": (1, "GILGFVFTA", 1), "WWWWWWWWW": (3, None, 0)}


def test_sources_and_wild_type(spark):
    protein = "MKTAYIAKQRQISFVKSHFSRQLEERLGLIEVQ"
    own = protein[5:14]
    mutant = own[:4] + ("W" if own[4] != "W" else "A") + own[5:]
    proteins = spark.createDataFrame([("P1", protein)], "name string, seq string")
    hits = tiling.exact_sources(strings(spark, [own, mutant], "pep"), proteins).collect()
    assert [(r.pep, r.name, r.offset) for r in hits] == [(own, "P1", 5)]
    wild = {r.pep: r.wild for r in neighbours.wild_type(strings(spark, [own, mutant], "pep"), tiling.tile(proteins, "seq", [9])).collect()}
    assert wild == {own: None, mutant: own}


def test_votes_and_enrichment(spark):
    rng = random.Random(4)
    marks = {"A1": ("KLD", "VY"), "A2": ("FYE", "RK"), "A3": ("GGH", "ML")}
    rows = [(f"{s}{''.join(rng.choice(AA) for _ in range(4))}{e}", a) for a, (s, e) in marks.items() for _ in range(40)]
    panel = spark.createDataFrame(rows, "epitope string, allele string")
    v = neighbours.votes(strings(spark, ["KLDAAAAVY", "WWWWWWWWW"], "query"), panel)
    e = counts.enrichment(v, counts.group_shares(panel, "allele")).collect()
    assert {r["query"] for r in e} == {"KLDAAAAVY"}
    assert max(e, key=lambda r: r.votes).allele == "A1" and max(r.vote for r in e) == 1.0
    df = spark.createDataFrame([(k, n, p) for k, n, p in ((0, 5, 0.2), (3, 5, 0.2), (5, 5, 0.2), (40, 100, 0.33))], "k int, n int, p double")
    for r in df.select("*", counts.binomial_tail(F.col("k"), F.col("n"), F.col("p")).alias("t")).collect():
        assert r.t == pytest.approx(sum(math.comb(r.n, i) * r.p**i * (1 - r.p) ** (r.n - i) for i in range(r.k, r.n + 1)))


def test_percent_rank_and_steps(spark):
    rng = random.Random(5)
    back = [("a", float(rng.randint(0, 30))) for _ in range(200)]
    df = spark.createDataFrame(back, "k string, score double")
    asked = spark.createDataFrame([("a", 3.0), ("a", 15.5), ("a", 99.0), ("b", 1.0), ("a", None)], "k string, score double")
    got = {(r.k, r.score): r.pct_rank for r in calibration.percent_rank(asked, df, ["k"]).collect()}
    for (k, s), p in got.items():
        want = None if s is None or k == "b" else 100 * sum(b > s for _, b in back) / len(back)
        assert p == want
    xy = [(float(rng.randint(0, 12)), rng.random()) for _ in range(80)]
    steps = calibration.isotonic_steps(spark.createDataFrame(xy, "x double, y double"), "x", "y").first().steps
    xs = sorted({x for x, _ in xy})
    of = {x: [y for a, y in xy if a == x] for x in xs}
    for i, x in enumerate(xs):  # min-max formula of the isotonic fit
        want = max(min(np.mean(sum((of[z] for z in xs[a : b + 1]), [])) for b in range(i, len(xs))) for a in range(i + 1))
        below = [s for s in steps if s.x <= x]
        assert below[-1].y == pytest.approx(want)


def test_bh(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, None]
    out = calibration.bh_cut(spark.createDataFrame([(x,) for x in p], "p double"), "p", 0.05).collect()
    assert {r.p for r in out if r.significant} == {0.001, 0.008}


def test_prevalence_shift(spark):
    b = calibration.prevalence_shift(spark.createDataFrame([(3.0,), (0.0,), (-3.0,)], "s double"), "s", 0.25)
    assert [round(1 / (1 + math.exp(-(s + b))), 4) for s in (3, 0, -3)] == [0.6579, 0.0874, 0.0047]


@pytest.mark.parametrize("n", [2, 4])
def test_pareto(spark, n):
    rng = np.random.default_rng(n)
    z = np.round(rng.random((120, n)), 1)
    names = [f"o{i}" for i in range(n)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(z)], "id int, " + ", ".join(f"{c} double" for c in names))
    want = {i for i in range(120) if not any((z[j] >= z[i]).all() and (z[j] > z[i]).any() for j in range(120))}
    assert {r.id for r in portfolio.pareto_front(df, names).collect()} == want
    ranks = portfolio.nondominated_rank(df, names, 2).collect()
    assert len(ranks) == 120 and {r.id for r in ranks if r.front == 1} == want


def test_stop_rule_and_survival(spark):
    df = spark.createDataFrame([("b", i, p) for i, p in enumerate((0.5, 0.3, 0.2, 0.1))], "block string, id int, p double")
    assert portfolio.select_saturating(df, "p", "block", "id", 4.0).count() == 3
    rng = random.Random(7)
    rows = [("k", b, rng.uniform(0, 0.6)) for b in (0, 0, 1, 1, 1)]
    q, got = 0.7, {}
    data = spark.createDataFrame(rows, "key string, block int, p double")
    got = {r.k: r.p_ge_k for r in portfolio.survival(data, "p", "block", q, ["key"]).collect()}
    want = [0.0] * 6
    for on in itertools.product((0, 1), repeat=2):
        for hits in itertools.product((0, 1), repeat=5):
            w = math.prod(q if x else 1 - q for x in on)
            for (_, b, p), h in zip(rows, hits):
                w *= (p / q if h else 1 - p / q) if on[b] else (0.0 if h else 1.0)
            for k in range(sum(hits) + 1):
                want[k] += w
    assert [got[k] for k in range(6)] == pytest.approx(want)
    assert portfolio.at_least_one(data, "p", "block", q, ["key"]).first().p_ge1 == pytest.approx(want[1])
    with pytest.raises(Exception, match="exceeds"):
        portfolio.at_least_one(data, "p", "block", 0.01).collect()


def test_compose_and_order(spark):
    df = spark.createDataFrame([("x", 1, 0, 0.6), ("x", 2, 0, 0.5), ("x", 3, 1, 0.4), ("x", 4, 1, 0.1)], "arm string, id int, block int, p double")
    got = [r.id for r in portfolio.compose(df, "p", "block", "id", "arm", 2, 0.7).orderBy("position").collect()]
    assert got == [1, 3]
    rng = random.Random(9)
    costs = [("c", a, b, rng.random()) for a, b in itertools.permutations(range(5), 2)]
    path = [r.unit for r in cassette.order_units(spark.createDataFrame(costs, "cassette string, left int, right int, cost double")).orderBy("position").collect()]
    cost = {(a, b): c for _, a, b, c in costs}
    worst = lambda p: max(cost[x] for x in itertools.pairwise(p))
    assert sorted(path) == list(range(5)) and worst(path) <= 1.2 * min(worst(p) for p in itertools.permutations(range(5)))


def test_density_contraction_and_loci(spark):
    peps = peptides(11, 60, lengths=(9,))
    counted = density.code_counts(strings(spark, peps, "pep"), "pep", 3)
    table = {r.code: r.cnt for r in counted.collect()}
    rng = random.Random(12)
    kernel = {(a, b): (1.0 if a == b else round(rng.random(), 2)) for a in AA for b in AA}
    got = {r.code: r.cnt for r in density.contract(counted, density.kernel_rows(spark, kernel), 3).collect()}
    digits = lambda c: (c // 400, c // 20 % 20, c % 20)
    for code in list(got)[:50]:
        y = digits(code)
        assert got[code] == pytest.approx(sum(n * math.prod(kernel[AA[a], AA[b]] for a, b in zip(digits(c), y)) for c, n in table.items()))
    w = {r.pep: r.weight for r in density.locus_weights(strings(spark, ["VVVGAVGVGK", "VVGAVGVGK", "SIINFEKLAA"], "pep"), "pep").collect()}
    assert w == {"VVVGAVGVGK": 0.5, "VVGAVGVGK": 0.5, "SIINFEKLAA": 1.0}


def test_register_em_recovers_planted_starts(spark):
    rng = random.Random(13)
    rows = []
    for i in range(80):
        s = rng.randrange(4)
        core = "F" + rng.choice(AA) * 2 + "L" + rng.choice(AA) + "T" + rng.choice(AA) * 2 + "K"
        rows.append(("g", "".join(rng.choice("DEGNPQ") for _ in range(s)) + core + "".join(rng.choice("DEGNPQ") for _ in range(3 - s)), s))
    panel = spark.createDataFrame(rows, "allele string, pep string, true int")
    start = F.when(F.col("pep").startswith("F"), 0).otherwise(F.crc32("pep") % 4).cast("int")
    at, _ = presentation.register_em(panel, "pep", "allele", start, rounds=6)
    got = {r.pep: r.start for r in at.collect()}
    assert np.mean([got[p] == s for _, p, s in rows]) > 0.9
    shares = presentation.mixture_em(panel, "pep", "allele", F.lit(0), rounds=1).groupBy("pep").agg(F.sum("share").alias("s")).collect()
    assert all(r.s == pytest.approx(1.0) for r in shares)


def test_ridge_and_motif(spark):
    rng = np.random.default_rng(14)
    x = rng.random((200, 2))
    y = 2 * x[:, 0] - x[:, 1] + 0.5
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    w = presentation.ridge(df, ["a", "b"], "y", 1e-9)
    assert (w["a"], w["b"], w["intercept"]) == pytest.approx((2, -1, 0.5), abs=1e-6)
    m = counts.motif(spark.createDataFrame([("g", "AC"), ("g", "AD")], "g string, pep string"), "pep", 2, group="g").collect()
    assert {(r.pos, r.residue): round(r.bits, 4) for r in m} == {(0, "A"): 4.3219, (1, "C"): 3.3219, (1, "D"): 3.3219}


def test_overlaps_and_safety(spark):
    rng = random.Random(15)
    rows = lambda n: [(i, s, s + rng.randint(0, 40)) for i in range(n) for s in [rng.randint(0, 300)]]
    a, b = rows(60), rows(60)
    df = lambda r: spark.createDataFrame(r, "id int, start int, end int")
    got = sorted((r.a_id, r.b_id) for r in cassette.overlaps(df(a), df(b), width=16).collect())
    assert got == sorted((i, j) for i, s, e in a for j, u, v in b if s <= v and u <= e)
    units = spark.createDataFrame([("u1", "G1", "AAAAAAAAA", True), ("u2", "G2", "CCCCCCCCC", False), ("u3", "G3", "CCCCCCCCC", True), ("u4", "G4", "CCCCCCCCD", True)], "unit string, gene string, register string, novel boolean")
    proteins = spark.createDataFrame([("G9", "CCCCCCCCC")], "gene string, kmer string")
    risks = cassette.self_origin(units, proteins, spark.createDataFrame([("G1",), ("G9",)], "gene string"))
    assert {(r.unit, r.clause, r.gene) for r in risks.collect()} == {("u1", "target", "G1"), ("u3", "exact", "G9"), ("u4", "near", "G9")}
    assert {r.unit for r in cassette.screen(units, risks).collect()} == {"u2", "u4"}
    with pytest.raises(ValueError, match="radius"):
        cassette.self_origin(units, proteins, proteins, radius=2)


def test_known_sets_and_expression(spark):
    rows = spark.createDataFrame([("A", 1), ("A", 0), ("B", 0), ("C", 1), ("C", 1)], "pep string, label int")
    assert sorted((r.pep, r.label) for r in ranking.labelled_sets(rows, "pep", "label").collect()) == [("A", 1), ("B", 0), ("C", 1)]
    ref = spark.createDataFrame([("PMEL", "gene", "Skin", 44.1), ("PMEL", "gene", "Lung", 0.4), ("KTWGQYWQV", "peptide", "SKCM", 12.5)], "key string, key_type string, context string, median_tpm double")
    df = spark.createDataFrame([("KTWGQYWQV", "PMEL"), ("AAA", "PMEL"), ("AAA", "X")], "pep string, gene string")
    got = [(r.tpm, r.tpm_source) for r in ranking.expression_value(df, ref, peptide="pep", gene="gene", tumor="SKCM", tissue="Skin").orderBy("tpm").collect()]
    assert got == [(None, None), (12.5, "peptide"), (44.1, "gene")]
    with pytest.raises(ValueError, match="tissue"):
        ranking.expression_value(df, ref, peptide="pep", gene="gene", tumor=None, tissue=None)


def test_survival_has_all_terms(spark):
    from seqloom.plans import table_queries

    rng = np.random.default_rng(3)
    rows = [(key, int(b), float(x)) for key, n in (("a", 700), ("b", 3)) for b, x in zip(rng.integers(0, 3, n), rng.integers(0, 500, n) / 1000)]
    got = {(r.key, r.k): r.p_ge_k for r in portfolio.survival(spark.createDataFrame(rows, "key string, block int, p double"), "p", "block", 0.7, ["key"]).collect()}
    want = {}
    for key in "ab":
        total = np.ones(1)
        for b in {r[1] for r in rows if r[0] == key}:
            inner = np.ones(1)
            for x in [r[2] / 0.7 for r in rows if r[:2] == (key, b)]:
                inner = np.convolve(inner, [1 - x, x])
            inner *= 0.7
            inner[0] += 0.3
            total = np.convolve(total, inner)
        want |= {(key, k): t for k, t in enumerate(np.cumsum(total[::-1])[::-1])}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    sf = "/root/testdata/sf0.001"
    n = dict(spark.read.parquet(f"{sf}/customer.parquet").groupBy("c_nationkey").count().collect())
    assert dict(table_queries.survival(spark, sf).groupBy("c_nationkey").count().collect()) == {k: v + 1 for k, v in n.items()}


def test_running_aggregates_by_ranges(spark):
    rng = random.Random(4)
    values = [None, float("nan"), 0.0, 1.0, 1.0, *(rng.gauss(0, 3) for _ in range(60))]
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice(values), rng.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, g string, v double, n int")
    for keys in ([], ["g"]):
        for falling in (False, True):
            w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("v") if falling else F.asc_nulls_first("v"), "id").rowsBetween(Window.unboundedPreceding, -1)
            want = {r.id: (r.s or 0, r.m) for r in df.select("id", F.sum("n").over(w).alias("s"), F.max("n").over(w).alias("m")).collect()}
            got = ordered.before(df, "v", {"s": ("sum", "n"), "m": ("max", "n")}, keys, ties=["id"], falling=falling).collect()
            assert len(got) == len(rows) and {r.id: (r.s, r.m) for r in got} == want
        w = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("v"), "id")
        want = {r.id: (str(r.a), str(r.b)) for r in df.select("id", F.lag("v").over(w).alias("a"), F.lead("v").over(w).alias("b")).collect()}
        got = ordered.neighbouring(df, "v", keys, ["id"]).collect()
        assert len(got) == len(rows) and {r.id: (str(r._before), str(r._after)) for r in got} == want
    assert ordered.before(df.limit(0), "v", {"s": ("sum", "n")}, ["g"], ties=["id"]).collect() == []
    plan = ordered.before(df, "v", {"s": ("sum", "n")}, ties=["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "_range" in plan.split("windowspecdefinition(")[1]


@pytest.mark.parametrize("cells,unit", [(4096, 4096), (27, 3), (1, 5)])
def test_front_by_cells_equals_plain(spark, cells, unit):
    rng = random.Random(11)
    rows = [tuple(float(rng.randint(0, 12)) for _ in range(3)) for _ in range(500)]
    rows += [(x, y, 30.0 - x - y) for x in map(float, range(10)) for y in map(float, range(10))] + [(20.0, 20.0, -5.0)] * 3 + [(float("inf"), -9.0, -9.0)]
    want = {r for r in rows if not any(all(a >= b for a, b in zip(o, r, strict=True)) and o != r for o in rows)}
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(5)
    got = [tuple(r) for r in portfolio._front_by_cells(df, ["a", "b", "c"], cells, unit).collect()]
    assert len(got) == len(want) and set(got) == want


def test_fronts_of_nulls_and_empty_tables(spark):
    odd = spark.createDataFrame([(1, 1.0, 2.0, 3.0), (2, None, 9.0, 9.0), (3, float("nan"), 0.0, 0.0), (4, 0.5, 2.0, 3.0), (5, 1.0, 2.0, 3.0)], "id int, a double, b double, _objective0 double")
    assert {r.id for r in portfolio.pareto_front(odd.withColumnRenamed("_objective0", "c"), ["a", "b", "c"]).collect()} == {1, 3, 5}
    assert portfolio.pareto_front(odd.limit(0), ["a", "b", "id"]).count() == 0
