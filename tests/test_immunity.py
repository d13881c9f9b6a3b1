"""Heads, channels, sources and reports against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from seqloom.functions import alleles, tissues
from seqloom.functions import sequences as S
from seqloom.operators import cassette, immunity, neighbours, reports

SCALE = {r: i / 7 - 1 for i, r in enumerate(S.RESIDUES)}
WEIGHTS = {"anchor": {r: i / 10 for i, r in enumerate(S.RESIDUES)}, "tcrface": {r: -i / 9 for i, r in enumerate(S.RESIDUES)}}


def plain_groove(n):
    return {i % n for i in (0, 1, 2, -2, -1)}


def test_heads_of_faces(spark):
    rng = random.Random(5)
    peps = ["".join(rng.choice(S.RESIDUES) for _ in range(n)) for n in (3, 4, 5, 6, 8, 9, 11, 15)] + ["ACXDEFGH"]
    df = spark.createDataFrame([(p,) for p in peps], "pep string")
    got = {r.pep: r for r in df.select("pep", immunity.llr("pep", WEIGHTS).alias("llr"), immunity.burial("pep", SCALE).alias("mean"), immunity.burial("pep", SCALE, per_residue=False).alias("total"), *immunity.scale_design("pep", {"k": SCALE})).collect()}
    for p in peps:
        at = plain_groove(len(p))
        face = [SCALE.get(c, 0) for i, c in enumerate(p) if i not in at]
        want = sum(WEIGHTS["anchor" if i in at else "tcrface"].get(c, 0) for i, c in enumerate(p))
        r = got[p]
        assert r.llr == pytest.approx(want) and r.total == pytest.approx(sum(face)) and r.k_tcr == pytest.approx(sum(face))
        assert (r.mean is None) if not face else r.mean == pytest.approx(sum(face) / len(face))
        assert r.k_all == pytest.approx(r.k_anchor + r.k_tcr)
    two = spark.createDataFrame([("AAAKFVAAWTLKAAA",), ("AAAA",), (None,)], "pep string").select("pep", immunity.groove("pep", "mhc2").alias("at"), immunity.core_llr("pep", WEIGHTS).alias("z")).collect()
    assert list(two[0].at) == [4, 7, 9, 12] and two[1].z is None and two[2].z is None
    assert two[0].z == pytest.approx(sum(WEIGHTS["anchor" if i in (0, 3, 5, 8) else "tcrface"][c] for i, c in enumerate("FVAAWTLKA")))


def test_posterior_and_blocks(spark):
    df = spark.createDataFrame([(1.0, 2.0), (0.5, None)], "x double, y double")
    model = [{"feature": "x", "block": "a", "coef": 2.0, "mu": 0.5, "sigma": 0.5}, {"feature": "y", "block": "b", "coef": -1.0, "mu": 1.0, "sigma": 2.0}]
    rows = [immunity.head(df, model, intercept=0.3, prevalence=0.03, blocks=b).orderBy(F.desc("x")).collect() for b in (None, ["a"], ["b"])]
    off = 0.3 - math.log(0.03 / 0.97)
    for whole, a, b in zip(*rows, strict=True):
        assert whole.score == pytest.approx(a.score + b.score + off)
    assert rows[0][0].score == pytest.approx(2.0 - 0.5 + off)
    p = df.select(immunity.posterior("x", 0.1).alias("p"), immunity.posterior(F.col("x") * 1e6, 0.1).alias("q")).first()
    assert p.p == pytest.approx(1 / (1 + math.exp(-(1 + math.log(0.1 / 0.9))))) and p.q == pytest.approx(1)
    for bad in (lambda: immunity.posterior("x", 1.0), lambda: immunity.head(df, model, intercept=0, prevalence=0.0), lambda: immunity.head(df, model, intercept=0, prevalence=0.1, blocks=["c"])):
        with pytest.raises(ValueError):
            bad()


def test_channels_and_safety(spark):
    rng = random.Random(6)
    peps = lambda n: ["".join(rng.choice("ACD") for _ in range(rng.choice((8, 9)))) for _ in range(n)]
    queries, refs = [*peps(12), "ACDXACDAC"], [(c, p, f"S{i % 5}") for c in ("self", "viral") for i, p in enumerate(peps(40))]
    refs.append(refs[0])
    key = {"anchor": lambda p: "".join(c for i, c in enumerate(p) if i in plain_groove(len(p))), "tcr": lambda p: "".join(c for i, c in enumerate(p) if i not in plain_groove(len(p)))}
    want = {}
    for q in queries:
        if "X" in q:
            continue
        for comp in ("self", "viral"):
            for ch, d in (("anchor", 2), ("tcr", 1)):
                first = {}
                for c, p, s in sorted(refs):
                    if c == comp and len(p) == len(q):
                        first.setdefault(key[ch](p), (p, s))
                near = sorted((sum(a != b for a, b in zip(key[ch](q), k, strict=True)), *m) for k, m in first.items())
                near = [x for x in near if x[0] <= d]
                want[q, comp, ch] = (len(near), round(math.log1p(1e6 * len(near) / len(first)), 9), *(near[0] if near else (None, None, None)))
    df = spark.createDataFrame([(q,) for q in queries], "pep string")
    found = immunity.channel_search(df, immunity.channel_references(spark.createDataFrame(refs, "component string, pep string, source string")), {"anchor": 2, "tcr": 1})
    got = {(r.pep, r.component, r.channel): (r.n, round(r.density, 9), r.subs, r.mimic, r.source) for r in found.collect()}
    assert got == want and any(v[0] for v in want.values())
    expression = spark.createDataFrame([("G0", "gene", "heart", 9.0), ("G0", "gene", "lung", 9.0), ("G0", "gene", "skin", 1.0), ("S1", "gene", "liver", 2.0), ("S1", "peptide", "SKCM", 5.0)], "key string, key_type string, context string, median_tpm double")
    rows = immunity.safety(found, spark.createDataFrame([("S0", "G0")], "source string, gene string"), expression, top=2).collect()
    assert len(rows) == sum(1 for k, v in want.items() if k[1] == "self" and v[0])
    for r in rows:
        assert [tuple(p) for p in r.profile] == {"S0": [("heart", 9.0), ("lung", 9.0)], "S1": [("liver", 2.0)]}.get(r.source, [])
        assert r.gene == ("G0" if r.source == "S0" else r.source)


def test_find_sources(spark):
    proteins = [("p", "aacdefghiACDEFGHK"), ("q", "ACDEFGHI"), ("x", "ACDEXGHI"), ("e", "")]
    peps = [" acdefghi ", "ACDEFGHI", "", None, "WWWWW"]
    df, prot = spark.createDataFrame([(p,) for p in peps], "pep string"), spark.createDataFrame(proteins, "name string, seq string")
    rows = {(r.name, r.offset): (r.query, r.window, r.n_subs, [tuple(m) for m in r.mutations]) for r in neighbours.find_sources(df, prot).collect()}
    q = "ACDEFGHI"
    assert rows == {("p", 1): (q, q, 0, []), ("q", 0): (q, q, 0, []), ("p", 9): (q, "ACDEFGHK", 1, [(7, "I", "K")])}
    assert [r.offset for r in neighbours.find_sources(df, prot, exclude_exact=True).collect()] == [9]
    assert neighbours.find_sources(df.limit(0), prot).collect() == []


def test_reports(spark):
    res = spark.createDataFrame([("A", "x", "thymus"), ("A", "x", "self"), ("A", "x", "viral"), ("B", "x", "neoag"), ("B", "y", "viral"), ("B", "y", "viral")], "binder string, allele string, category string")
    binders = spark.createDataFrame([("A", "x"), ("A", "x"), ("B", "x"), ("B", "y"), ("C", "x")], "binder string, allele string")
    assert reports.patient_summary(res, binders, ["neoag", "thymus", "viral"]).first().asDict() == {"n_strong_binders": 4, "n_neoag_mimic": 1, "n_thymus_mimic": 1, "n_viral_mimic": 2, "n_tolerance_risk": 1, "n_foreign_mimic": 2}
    assert set(reports.patient_summary(res.limit(0), binders, ["viral"]).first()) == {4, 0}
    by = reports.patient_summary(res.withColumn("who", F.lit("u")), binders.withColumn("who", F.lit("v")), ["viral"], ["who"])
    assert {(r.who, r.n_strong_binders, r.n_viral_mimic) for r in by.collect()} == {("u", 0, 2), ("v", 4, 0)}
    sets = reports.reference_sets({"thymus": (binders.withColumnRenamed("binder", "pep"), "self"), "viral": (res.withColumnRenamed("binder", "pep"), "foreign")})
    assert sets.count() == 5 and {tuple(r) for r in sets.select("category", "kind").distinct().collect()} == {("thymus", "self"), ("viral", "foreign")}
    e = spark.createDataFrame([("G", "gene", "Lung"), ("H", "gene", "Bladder"), ("P", "peptide", "SKCM"), ("G", "gene", "Lung")], "key string, key_type string, context string")
    assert [r.context for r in reports.contexts(e, "gene").collect()] == ["Bladder", "Lung"] and [r.context for r in reports.contexts(e, "peptide").collect()] == ["SKCM"]


def test_names_contexts_and_segments(spark):
    names = spark.createDataFrame([("HLA-A02:01",), ("HLA-B*07:02",), ("H-2-Kb",), (None,)], "n string")
    assert [r[0] for r in names.select(alleles.starred("n")).collect()] == ["HLA-A*02:01", "HLA-B*07:02", "H-2-Kb", None]
    assert [r[0] for r in names.select(alleles.starred("n", "mhc2")).collect()] == ["HLA-A02:01", "HLA-B*07:02", "H-2-Kb", None]
    t = spark.createDataFrame([(" ov",), ("none",), (None,)], "t string").select(tissues.matched_tissues("t")).collect()
    assert [r[0] for r in t] == [["Ovary", "Fallopian Tube"], [], []]
    rows = [("Somatic", "AC(D)EF", "", "", ""), ("Somatic", "ACDEF", "", "", ""), ("Fusion", "", "ACD|E|FG", "", ""), ("CNV", "", "ACD|FG*HI", "", ""), ("Fusion", "", "ACD|*F", "", ""), ("Fusion", "", "ACDF", "", ""), ("Isoform", "", "", "chr1:5-9:2-5", "ACDEFGH"), ("Isoform", "", "", "20-50", "ACDEFGH"), ("Isoform", "", "", "x-5", "ACD"), ("Isoform", "", "", "2-5", ""), ("Other", "", "", "", "")]
    df = spark.createDataFrame(rows, "k string, m string, w string, s string, q string")
    got = [r[0] and tuple(r[0]) for r in df.select(S.centred_context(*map(F.col, "kmwsq"))).collect()]
    assert got == [("ACDEF", 2), None, ("ACDEFG", 3), ("ACDFG", 3), None, None, ("ACDEFGH", 3), ("ACDEFGH", 6), None, None, None]
    cut = cassette.split_cassette(spark.createDataFrame([("G.G", "ACDG.GG.GEF"), ("G.G", ""), ("G.G", None)], "sp string, seq string"), "seq", "G.G").collect()
    assert [(r.segment, r.pep, r.mutation_index) for r in cut] == [(0, "ACD", 1), (1, "EF", 1)]
