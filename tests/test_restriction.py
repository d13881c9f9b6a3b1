"""Kernels, votes, scans and ranked windows against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from seqloom.functions.sequences import RESIDUES
from seqloom.operators import portfolio, restriction


def test_groove_kernel_and_clusters(spark):
    rng = random.Random(4)
    base = "".join(rng.choice(RESIDUES) for _ in range(34))
    seqs = {f"A{i}": base[:i] + "X" * (i % 3) + base[i + i % 3 :] for i in range(6)} | {f"B{i}": "".join(rng.choice(RESIDUES) for _ in range(34)) for i in range(4)} | {"SHORT": "AAA"}
    seqs["A9"] = "W" + base[1:]
    penalties = {(a, b): (0.0 if a == b else 0.5 + (ord(a) + ord(b)) % 3) for a in RESIDUES for b in RESIDUES}
    weights = [1.0 + k % 2 for k in range(34)]
    df = spark.createDataFrame(list(seqs.items()), "allele string, seq string")

    def plain(s, t, pen):
        return math.exp(-sum(w * pen(a, b) for a, b, w in zip(s, t, weights) if "X" not in (a, b)) / 2.0)

    for given, pen in ((None, lambda a, b: float(a != b)), (penalties, lambda a, b: penalties[a, b])):
        k = restriction.groove_kernel(df, given, weights=weights)
        got = {(r.allele, r.other): r.k for r in k.collect()}
        want = {(a, b): plain(s, t, pen) for a, s in seqs.items() for b, t in seqs.items() if a != b and len(s) == len(t)}
        assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in want)
    near = [(r.other, r.place) for r in restriction.groove_neighbours(k, 2).where("allele = 'A0'").orderBy("place").collect()]
    assert len(near) == 2 and near[0][0].startswith("A")
    named = {r.allele: r.cluster for r in restriction.groove_clusters(k, df, 0.5).collect()}
    assert named.keys() == seqs.keys() and len({named[f"A{i}"] for i in range(6)}) == 1 and named["SHORT"] == "SHORT" and named["B0"] == "B0"


def _panel(spark):
    rng = random.Random(7)
    rows = []
    for allele, (a, b) in {"X": ("KLD", "VY"), "Y": ("RMN", "PW"), "Z": ("AAG", "CC")}.items():
        rows += [(a + "".join(rng.choice(RESIDUES) for _ in range(4)) + b, allele) for _ in range(30)]
    return spark.createDataFrame(rows, "epitope string, allele string")


def test_restriction_votes_gate_and_ranks(spark):
    panel = _panel(spark)
    q = spark.createDataFrame([("KLDAAAAVY",), ("RMNAAAAPW",), ("WWWWWWWWW",)], "query string")
    first = {r["query"]: r for r in restriction.restriction(q, panel).where("place = 1").collect()}
    assert first["KLDAAAAVY"].allele == "X" and first["RMNAAAAPW"].allele == "Y" and first["KLDAAAAVY"].binder and "WWWWWWWWW" not in first
    rows = [("WWWWWWWWW", "X", 0.2, 1.5, 3.0), ("WWWWWWWWW", "Y", 0.5, 30.0, 1.0), ("WWWWWWWWW", "Z", -0.5, None, None), ("KLDAAAAVY", "X", -0.1, 50.0, 9.0)]
    scores = spark.createDataFrame(rows, "query string, allele string, score double, pct_rank double, length_rank double")
    told = lambda *c, **k: {(r["query"], r.allele): tuple(r[x] for x in c) for r in restriction.restriction(q, panel, scores=scores, **k).collect()}
    # class I: votes beyond chance, or a score above 0; by score
    assert told("binder", "place") == {("WWWWWWWWW", "Y"): (True, 1), ("WWWWWWWWW", "X"): (True, 2), ("WWWWWWWWW", "Z"): (False, 3), ("KLDAAAAVY", "X"): (True, 1)}
    # calibrated: the same gate; by percent rank
    assert told("binder", "place", "band", calibrated=True) == {("WWWWWWWWW", "X"): (True, 1, "weak"), ("WWWWWWWWW", "Y"): (True, 2, "none"), ("WWWWWWWWW", "Z"): (False, 3, "none"), ("KLDAAAAVY", "X"): (True, 1, "none")}
    # class II: a percent rank of at most 2 within the length, whatever the score
    assert {k: v[0] for k, v in told("binder", cls="mhc2").items() if k[0] == "WWWWWWWWW"} == {("WWWWWWWWW", "X"): False, ("WWWWWWWWW", "Y"): True, ("WWWWWWWWW", "Z"): False}
    asked = spark.createDataFrame([("KLDAAAAVY", "X"), ("KLDAAAAVY", "Y"), ("WWWWWWWWW", "X")], "query string, allele string")
    assert {(r["query"], r.allele): r.binder for r in restriction.is_binder(asked, panel).collect()} == {("KLDAAAAVY", "X"): True, ("KLDAAAAVY", "Y"): False, ("WWWWWWWWW", "X"): False}
    assert {r["query"]: r.presented for r in restriction.is_presented(restriction.restriction(q, panel, scores=scores)).collect()} == {"WWWWWWWWW": True, "KLDAAAAVY": True}


def test_scan_with_corrections(spark):
    panel = _panel(spark)
    proteins = spark.createDataFrame([("P1", "WWW" + "KLDAAAAVY" + "WWWW"), ("P2", "RMNAAAAPW"), ("P3", "AAX")], "name string, seq string")
    plain = {(r.name, r.offset, r.allele) for r in restriction.scan_proteins(proteins, panel, [9]).collect()}
    assert {("P1", 3, "X"), ("P2", 0, "Y")} <= plain
    for kind in ("bonferroni", "bh"):
        kept = {(r.name, r.offset, r.allele) for r in restriction.scan_proteins(proteins, panel, [9], correction=kind).collect()}
        assert {("P1", 3, "X"), ("P2", 0, "Y")} <= kept <= plain
    with pytest.raises(ValueError, match="unknown correction"):
        restriction.scan_proteins(proteins, panel, [9], correction="other")


def test_windows_are_ranked_and_written(spark):
    rng = random.Random(11)
    wild = "".join(rng.choice(RESIDUES) for _ in range(23))
    mutant = wild[:11] + ("A" if wild[11] != "A" else "C") + wild[12:]
    head = f"Somatic:chr1:5:G:A:missense_variant:{wild[:11]}({wild[11]}){wild[12:]}:{mutant[:11]}({mutant[11]}){mutant[12:]}:10.3:ENSG1:ENST1:GENE:UNI"
    seq = mutant[3:20]
    records = spark.createDataFrame([(head, seq.lower()), ("CNV:chr2:1:2:w:3:0.5", "ACDEFXGHIKLMNPQ")], "header string, seq string")
    alleles = ["HLA-A02:01", "HLA-B07:02"]
    score = lambda p, a: float(sum(map(ord, p)) * (3 + alleles.index(a)) % 101)
    cut = [(h, s[i : i + k], i) for h, s in ((head, seq), ("CNV:chr2:1:2:w:3:0.5", "ACDEFXGHIKLMNPQ")) for k in (8, 9, 10, 11) for i in range(len(s) - k + 1) if set(s[i : i + k]) <= set(RESIDUES)]
    beside = wild[3:20]
    peptides = sorted({p for _, p, _ in cut})
    back = [(a, float(x)) for a in alleles for x in range(0, 101)]
    scores = spark.createDataFrame([(p, a, score(p, a)) for p in peptides for a in alleles], "peptide string, allele string, score double")
    nm = lambda p, a: 50.0 + score(p, a)
    wilds = {beside[i : i + len(p)] for h, p, i in cut if h == head}
    affinity = spark.createDataFrame([(p, a, nm(p, a)) for p in sorted({*peptides, *wilds}) for a in alleles], "peptide string, allele string, nm double")
    got = restriction.predict_windows(records, scores, spark.createDataFrame(back, "allele string, score double"), "mhc1", threshold=30.0, affinity=affinity)
    rank = lambda p, a: 100.0 * (100 - score(p, a)) / 101
    want = {}
    for h, p, i in cut:
        r, a = min((rank(p, a), a) for a in alleles)
        if r <= 30.0:
            w = beside[i : i + len(p)] if h == head and beside[i : i + len(p)] != p else None
            n = sum(rank(p, b) <= 30.0 for b in alleles)
            want[h, p, i] = (a, round(r, 6), n, w, None if w is None else round(nm(p, a) / nm(w, a), 6))
    rows = got.collect()
    assert {(r.header, r.peptide, r.offset): (r.allele, round(r.percent_rank, 6), r.n_alleles_presenting, r.wt_peptide, None if r.agretopicity is None else round(r.agretopicity, 6)) for r in rows} == want and len(rows) == len(want)
    assert all(r.synth_peptide == r.model_peptide == r.peptide and len(r.alleles_presenting.split(";")) == r.n_alleles_presenting for r in rows)
    table = restriction.scored_table(got, "mhc1")
    assert table.columns == list(restriction.SCORED_COLUMNS) and len(table.columns) == 57
    one = table.where("gene_name = 'GENE'").first()
    assert one.best_allele in ("HLA-A*02:01", "HLA-B*07:02") and one.seq == mutant and one.ref_seq == wild and one.score == "" and one.tpm == "10.3"


def test_class_two_windows_carry_their_cores(spark):
    rng = random.Random(2)
    protein = "".join(rng.choice(RESIDUES) for _ in range(40))
    head = f"Somatic:c:1:G:A:missense_variant::{protein}:1:g:t:G:u"
    records = spark.createDataFrame([(head, protein[10:30])], "header string, seq string")
    cut = restriction.windows_of(records, "mhc2")
    scores = cut.select("peptide").distinct().select("peptide", F.lit("DRB1_0101").alias("allele"), F.lit(1.0).alias("score"))
    rows = restriction.predict_windows(records, scores, spark.createDataFrame([("DRB1_0101", 0.0)], "allele string, score double"), "mhc2").collect()
    assert len(rows) == 6
    for r in rows:
        at = protein.index(r.peptide) + r.core_offset
        assert r.core == protein[at : at + 9] and r.synth_peptide == protein[max(0, at - 6) : at + 15] and r.model_peptide == protein[max(0, at - 2) : at + 11]


def test_effective_size_is_bounded_by_the_trials():
    assert portfolio.n_effective(0.5, 0.75) == pytest.approx(2.0) and portfolio.n_effective(0.5, 0.99, 3) == 3.0 and math.isnan(portfolio.n_effective(0.5, 1.0)) and math.isnan(portfolio.n_effective(1.0, 0.5))
