"""Ranked candidates against a plain version."""

import math

import pytest

from seqloom.operators import candidates

MODEL = [{"feature": f, "coef": c, "mu": m, "sigma": s} for f, c, m, s in (("pres", 1.0, 0.5, 2.0), ("d_occupancy", 2.0, 0.1, 0.5), ("wt_absent", -0.5, 0.2, 1.0), ("expr", 0.3, 1.0, 1.5), ("expr_missing", -0.2, 0.0, 1.0), ("C_phys_buried", 0.7, 0.4, 0.2), *((c, 0.1, 0.0, 1.0) for c in candidates.CHANNELS))]
SCALE = {"A": 0.5, "C": 1.0, "D": -0.5}


def channels(spark, drop=()):
    table = spark.createDataFrame([("AACDAACD", 0.25), ("AACDAACD", 0.5), ("DDDDDDDDD", float("nan"))], "peptide string, value double")
    by_allele = spark.createDataFrame([("AACDAACD", "A1", 3.0)], "peptide string, allele string, value double")
    return {k: v for k, v in zip(candidates.CHANNELS, (table, table, by_allele), strict=True) if k not in drop}


def test_a_channel_or_feature_that_nobody_supplies_is_an_error(spark):
    rows = spark.createDataFrame([("AACDAACD", "A1")], "peptide string, allele string")
    with pytest.raises(ValueError, match="C_corpus_self"):
        candidates.fill_channels(rows, channels(spark, ("C_corpus_self",)))
    with pytest.raises(ValueError, match="peptide and value"):
        candidates.fill_channels(rows, {"x": rows}, ["x"])
    table = spark.createDataFrame([("AACD", "A1")], "epitope string, best_allele string")
    with pytest.raises(ValueError, match="C_phys_buried"):
        candidates.rank_table(table, MODEL, channels(spark))
    with pytest.raises(ValueError, match="prevalence"):
        candidates.ranked(rows, [], prevalence=0.0)


def test_scored_tables_are_ranked(spark):
    head = "epitope string, best_allele string, gene_name string, tpm string, affinity string, type string, subtype string, score string"
    data = [(" aacdaacd", "A1", "G1", "3.0", "50", "Somatic", "missense_variant", "0.5"), ("DDDDDDDDD", "A1", "G2", "", "nan", "Fusion", "x", "bad"), ("CCCCAAAADD", "A2", "G3", None, "1000", "", "frameshift_variant", ""), ("C3C", "A2", "G3", "1", "1", "", "", ""), ("", "A2", "", "", "", "", "", ""), ("DDDDDDDDD", "A1", "G2", "", "nan", "Fusion", "x", "bad")]
    ranks = spark.createDataFrame([("AACDAACD", "A1", 0.5, 0.25), ("CCCCAAAADD", "A2", 0.0, None)], "peptide string, allele string, presentation_rank double, binder_rank double")
    genes = spark.createDataFrame([("G3", 7.0), ("G1", 99.0)], "gene string, tpm double")
    known = spark.createDataFrame([("DDDDDDDDD", "viral", 2), ("DDDDDDDDD", "screened", 1)], "peptide string, set string, priority int")
    got = candidates.rank_table(spark.createDataFrame(data, head), MODEL, channels(spark), ranks, expression=[genes], scales={"C_phys_buried": SCALE}, known=known, prevalence=0.25).collect()
    assert len(got) == 4 and sum(r.p_response for r in got) / 4 == pytest.approx(0.25, abs=1e-6)

    def z(feature, value):
        m = next(m for m in MODEL if m["feature"] == feature)
        return m["coef"] * (value - m["mu"]) / m["sigma"] if value is not None else 0.0

    def face(p):
        inside = {i % len(p) for i in (0, 1, 2, -2, -1)}
        values = [SCALE.get(c, 0) for i, c in enumerate(p) if i not in inside]
        return sum(values) / len(values)

    of = {r.peptide: r for r in got}
    a, c, d = of["AACDAACD"], of["CCCCAAAADD"], of["DDDDDDDDD"]
    want = z("pres", -math.log10(0.5)) + z("d_occupancy", 10 / 60) + z("wt_absent", 1.0) + z("expr", math.log1p(3)) + z("expr_missing", 0.0) + z("C_phys_buried", face("AACDAACD")) + 0.1 * (0.5 + 0.5 + 3.0)
    assert a.score == pytest.approx(want) and a.imputed == "" and a.variant_type == "missense" and a.score_builtin == 0.5 and (a.core, a.core_offset, a.core_source) == ("AACDAACD", 0, "footprint")
    want = z("pres", 4.0) + z("d_occupancy", 10 / 1010) + z("wt_absent", 1.0) + z("expr", math.log1p(7)) + z("expr_missing", 1.0) + z("C_phys_buried", face("CCCCAAAADD"))
    assert c.score == pytest.approx(want) and c.imputed.split(";") == list(candidates.CHANNELS) and c.variant_type == "frameshift"
    assert d.imputed.split(";") == ["pres", "d_occupancy", "expr", *candidates.CHANNELS] and d.known == "screened" and d.score_builtin is None and d.variant_type == "fusion"
    order = sorted({r.score for r in got}, reverse=True)
    assert all(r.rank == order.index(r.score) + 1 and r.listing == (0 if r.peptide == "DDDDDDDDD" else 1) for r in got)


def test_predictions_are_ranked_by_their_own_ranks(spark):
    rows = spark.createDataFrame([("AACDAACD", "A1", "G1", "2", 0.5, 50.0, 500.0), ("CCCCAAAADD", "A2", "G2", "", 1.0, None, None)], "peptide string, allele string, gene_name string, tpm string, percent_rank double, affinity_nm double, wt_affinity_nm double")
    model = [{"feature": f, "coef": 1.0, "mu": 0.0, "sigma": 1.0} for f in ("pres", "d_occupancy", "agretopicity", "expr")]
    got = {r.peptide: r for r in candidates.rank_predictions(rows, model, {}, wanted=()).collect()}
    assert got["AACDAACD"].score == pytest.approx(-math.log10(0.5) + 10 / 60 - 10 / 510 + math.log10(10) + math.log1p(2)) and got["AACDAACD"].wt_absent == 0
    assert got["CCCCAAAADD"].score == pytest.approx(0.0) and got["CCCCAAAADD"].imputed == "d_occupancy;agretopicity;expr" and got["CCCCAAAADD"].rank == 2
