"""Known values of column functions, and properties of masks, cores and codons."""

import pytest
from pyspark.sql import functions as F

from seqloom.functions import alleles, scoring
from seqloom.functions import sequences as S
from seqloom.operators import cassette, recognition, tiling


def one(spark, column, **values):
    types = {str: "string", int: "int", float: "double"}
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {types[type(v)]}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("pep", "core", "offset"), [("SIINFEKL", "SIINFEKL", 0), ("GILGFVFTL", "GILGFVFTL", 0), ("GILGFVFTLA", "GILGFFTLA", 0), ("PKYVKQNTLKLAT", "YVKQNTLKL", 2), ("AAAKFVAAWTLKAAA", "FVAAWTLKA", 4)])
def test_binding_core(spark, pep, core, offset):
    got = one(spark, S.binding_core("p"), p=pep)
    assert (got.core, got.offset) == (core, offset)


def test_masks_and_anchors(spark):
    at = S.anchor_indices("p", F.lit("mhc1"))
    assert one(spark, at, p="KLEEEEEEV") == [1, 8]
    assert one(spark, S.masked("p", at, inside=True), p="KLEEEEEEV") == "KXEEEEEEX"
    assert one(spark, S.masked("p", at, inside=False), p="KLEEEEEEV") == "XLXXXXXXV"
    assert one(spark, S.anchor_indices("p"), p="AAAKFVAAWTLKAAA") == [4, 7, 9, 12]
    assert one(spark, F.array(*S.claimed_positions(F.length("p"), [1, 2, -1, -9])), p="KLEEEEEEV") == [0, 1, 8, None]


def test_face_codes_and_classes(spark):
    assert len(one(spark, S.face_codes("p", 3), p="SIINFEKL")) == 3
    assert one(spark, S.face_codes("p", 3), p="SIIXXXKL") == []
    assert one(spark, S.infer_class("p"), p="A" * 11) == "mhc1" and one(spark, S.infer_class("p"), p="A" * 12) == "mhc2"


def test_codons(spark):
    cds = "AAATTTTGGTTTCAATTTAAAGGG"
    assert one(spark, S.slippery_codons("c"), c=cds) == [1, 3]
    assert one(spark, S.slippery_codons("c"), c="TTTTTCTTTTTT") == [0, 2]
    fixed = one(spark, S.deslip("c"), c=cds)
    assert one(spark, S.slippery_codons("c"), c=fixed) == [] and one(spark, S.translate("c"), c=fixed) == one(spark, S.translate("c"), c=cds) == "KFWFQFKG"
    assert one(spark, S.deslip("c"), c="TTTTA") == "TTTTA"  # a site needs a whole codon after it
    assert one(spark, S.deslip("c"), c=" uuuUUA ") == "TTCTTA" and one(spark, S.slippery_codons("c"), c="uuucca") == [0]
    assert one(spark, S.translate("c"), c="ATGNNN") == "MX"
    for p in ("MKTAYIAKQRFFFFFFGGGG", "PPPPPPPP"):
        back = cassette.back_translate(p)
        assert one(spark, S.translate("c"), c=back) == p


def test_windows_and_flanks(spark):
    cut = S.centred_cut(F.col("s"), F.col("o"), 5)
    assert tuple(one(spark, cut, s="ABCDEFGHI", o=4)) == ("CDEFG", 2) and tuple(one(spark, cut, s="ABCDEFGHI", o=0)) == ("ABCDE", 0) and tuple(one(spark, cut, s="ABCDEFGHI", o=8)) == ("EFGHI", 4)
    assert one(spark, S.aligned_window(F.col("m"), F.col("w"), F.lit("CDX")), m="ABCDXF", w="ABCDEF") == "CDE"
    assert one(spark, S.aligned_window(F.col("m"), F.col("w"), F.lit("CDX")), m="ABCDXF", w="ABCDE") is None
    assert one(spark, S.flank_identity(F.col("a"), F.lit(1), F.col("b"), F.lit(1), F.lit(2), 1), a="XAAY", b="XAAZ") == 0.5
    assert one(spark, S.flank_identity(F.col("a"), F.lit(0), F.col("b"), F.lit(0), F.lit(2), 2), a="AA", b="AA") == 0.0


def test_tile_crosses_blocks_and_drops_other_letters(spark):
    seq = "".join("ACDEFGHIKLMNPQRSTVWY"[(i * i) % 20] for i in range(1500)) + "XACD"
    df = spark.createDataFrame([(1, seq), (2, "AC"), (3, None), (4, "ACXDE")], "id int, seq string")
    got = sorted((r.id, r.offset, r.kmer) for r in tiling.tile(df, "seq", [3, 9]).collect())
    want = sorted((i, o, s[o : o + k]) for i, s in ((1, seq), (2, "AC"), (4, "ACXDE")) for k in (3, 9) for o in range(len(s) - k + 1) if "X" not in s[o : o + k])
    assert got == want
    assert tiling.tile(df.limit(0), "seq", [3]).count() == 0


def test_junction_windows(spark):
    df = spark.createDataFrame([("AAAA", "GG", "CCCC")], "l string, s string, r string")
    got = {r.window for r in tiling.junction_windows("l", "r", "s", [3], df).collect()}
    assert got == {"AAG", "AGG", "GGC", "GCC"}


def test_scores(spark):
    assert one(spark, scoring.occupancy_gain("m", "w"), m=3.0, w=90.0) == pytest.approx(0.6692, abs=1e-4)
    assert one(spark, scoring.occupancy_gain("m", F.lit(None)), m=3.0) == pytest.approx(0.7692307692)
    assert one(spark, scoring.fisher("a", "b"), a=0.5, b=0.5) == pytest.approx(2 * 0.69314718056)
    assert one(spark, scoring.fisher("a", F.lit(None)), a=0.5) is None
    assert [one(spark, S.neglog10("p"), p=p) for p in (0.0, 1.0, 0.01)] == [4.0, 0.0, 2.0]
    nm = one(spark, scoring.unit_to_affinity(scoring.affinity_to_unit("x")), x=123.0)
    assert nm == pytest.approx(123.0)


def test_linear_refuses_missing_features(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 3.0)], "a double, b double")
    model = [{"feature": "a", "coef": 2.0, "mu": 1.0, "sigma": 1.0}, {"feature": "b", "coef": 1.0, "mu": 1.0, "sigma": 2.0}]
    assert [(r.score, r.imputed) for r in scoring.linear(df, model).orderBy("a").collect()] == [(0.0, "b"), (3.0, "")]
    with pytest.raises(ValueError, match="c"):
        scoring.linear(df, [*model, {"feature": "c", "coef": 1.0, "mu": 0.0, "sigma": 1.0}])


SOMATIC = "Somatic:chr1:9715752:G:A:missense_variant:LINSQI(S)LLIG:LINSQI(N)LLIG:10.34:ENSG00000171608:ENST00000377346:PIK3CD:A0A8V8TML5"
HEADERS = [
    (SOMATIC, "missense", {"gene_name": "PIK3CD", "tpm": "10.34", "subtype": "missense_variant", "uniprot_id": "A0A8V8TML5", "gene_id": "ENSG00000171608", "mut_window": "LINSQI(N)LLIG"}),
    ("Fusion:RGS6--XYLT1:INFRAME:AQGSGDQ|DPHPSPL:ENST1--ENST2:ENSG1--ENSG2:--:0.3655:12:0", "fusion", {"gene_name": "RGS6--XYLT1", "subtype": "INFRAME", "ffpm": "0.3655", "transcript_id": "ENST1--ENST2", "tpm": ""}),
    ("Isoform:STRG.35712.1|ENST00000324225|ENSG00000149577|SIDT2|Q8NBJ9-1|22.121262|3.332689|5.124321|975:124-1098:0-133", "isoform", {"gene_name": "SIDT2", "uniprot_id": "Q8NBJ9-1", "cov": "22.121262", "fpkm": "3.332689", "tpm": "5.124321", "span": "975:124-1098:0-133"}),
    ("CNV:chr6:32530190:59610:MVCLKLPGGSY|I|SLSETCLLLW:26:0.14:79:6:0:0", "cnv", {"chrom": "chr6", "sv_len": "59610", "cnv_score": "26", "tpm": "0.14", "gene_name": ""}),
    ("Whatever:GENEA|GENEB|stuff", "whatever", {"type": "Whatever", "gene_name": "", "tpm": ""}),
    ("", "", {"type": ""}),
]


def test_headers_and_products(spark):
    df = spark.createDataFrame([(k, h) for k, (h, _, _) in enumerate(HEADERS)] + [(99, None)], "k int, h string")
    rows = {r.k: r for r in df.select("k", *alleles.header_fields("h")).withColumn("product", alleles.product(F.col("type"), F.col("subtype"))).collect()}
    for k, (_, product, fields) in enumerate(HEADERS):
        assert rows[k]["product"] == product and {f: rows[k][f] for f in fields} == fields
    assert all(rows[99][f] == "" for f in alleles.FIELDS)
    kinds = {"frameshift_variant": "frameshift", "inframe_deletion": "inframe_deletion", "stop_lost": "stop_lost", "start_lost": "start_lost", "protein_altering_variant": "protein_altering", "SPLICE_ACCEPTOR": "splice_acceptor"}
    assert {c: one(spark, alleles.product(F.lit("Somatic"), F.col("c")), c=c) for c in kinds} == kinds


def test_allele_names(spark):
    assert [one(spark, alleles.normalize("a"), a=a) for a in ("HLA-A*02:01", "H-2Kb", "H-2-Kb", "A*02:01")] == ["HLA-A02:01", "H-2-Kb", "H-2-Kb", "A02:01"]
    key = lambda a, b: one(spark, alleles.class2_key(F.col("a"), F.col("b")), a=a, b=b)
    assert [key("HLA-DRA*01:01", "HLA-DRB1*01:01"), key("HLA-DPA1*01:03", "HLA-DPB1*04:01"), key("I-Ab", ""), key("", "HLA-DPB1*11:01"), key("H-2-IAb", "")] == ["DRB1_0101", "HLA-DPA10103-DPB10401", "H-2-IAb", "-DPB11101", "H-2-IAb"]
    name = lambda a: one(spark, alleles.class2_from_name("a", F.lit("HLA-DPA10201")), a=a)
    assert [name(a) for a in ("HLA-DRB1*15:01", "HLA-DQA1*05:01/DQB1*03:01", "HLA-DPB1*11:01", "H2-IAb", "I-Ab", "DRB1_1501")] == ["DRB1_1501", "HLA-DQA10501-DQB10301", "HLA-DPA10201-DPB11101", "H-2-IAb", "H-2-IAb", "DRB1_1501"]
    report = lambda k, m: one(spark, alleles.class2_report("k", m), k=k)
    keys = ("DRB1_0101", "DRB3_0202", "HLA-DQA10501-DQB10301", "HLA-DPA10103-DPB10401", "-DPB11101", "HLA-A02:01", "H-2-IAb")
    assert [report(k, "beta") for k in keys] == ["DRB1*01:01", "DRB3*02:02", "DQB1*03:01", "DPB1*04:01", "DPB1*11:01", "HLA-A02:01", "H-2-IAb"]
    assert [report(k, "isotype") for k in keys] == ["DR", "DR", "DQ", "DP", "DP", "HLA-A02:01", "H-2"]
    known = spark.createDataFrame([("HLA-A02:01:01",), ("HLA-A02:01:02",), ("HLA-B07:02",), ("DRB1_0101",)], "allele string")
    names = spark.createDataFrame([("A*02:01",), ("B*07:02",), ("HLA-B*07:02",), ("ZZ:99:99",), ("HLA-DRB1*01:01",)], "name string")
    got = {r.name: (r.resolved, r.exact) for r in alleles.resolve(names, known, class2=True).collect()}
    assert got == {"A*02:01": ("HLA-A02:01:01", False), "B*07:02": ("HLA-B07:02", True), "HLA-B*07:02": ("HLA-B07:02", True), "ZZ:99:99": (None, False), "HLA-DRB1*01:01": ("DRB1_0101", True)}


def test_runs(spark):
    scale = {"I": 1.0, "D": -1.0}
    ones = F.transform(F.split("p", ""), lambda _: F.lit(1.0))
    a = one(spark, recognition.weighted_aggregate(recognition.scale_values(F.col("p"), scale), ones, 0.5), p="AAIIDDAA")
    b = one(spark, recognition.weighted_aggregate(recognition.scale_values(F.col("p"), scale), ones, 0.5), p="AAIDIDAA")
    assert (a.run_max, a.run_n, b.run_max, b.run_n) == (2, 1, 1, 2) and a.run_frac == b.run_frac == 0.25 and a.sum == 0.0
