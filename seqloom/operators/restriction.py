"""Restriction of peptides by alleles: groove kernels and clusters, votes with gates, scans of proteins, and windows ranked over alleles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import alleles as A
from seqloom.functions import sequences as S
from seqloom.operators import calibration, counts, density, neighbours, tiling

#: Lengths of windows that are ranked and of those that are scanned, by class; letters on either side of a core in the peptides to make and to model; columns of the scored table.
WINDOW_LENGTHS = {"mhc1": (8, 9, 10, 11), "mhc2": (15,)}
SCAN_LENGTHS = {"mhc1": (8, 9, 10, 11), "mhc2": (13, 14, 15, 16, 17, 18)}
MAKE_FLANK, MODEL_FLANK = 6, 2
SCORED_COLUMNS = (
    "type", "subtype", "chrom", "pos", "gene_name", "gene_id", "transcript_id", "uniprot_id", "tpm", "ffpm", "epitope",
    "epitope_context", "cluster_consensus", "group", "best_allele", "agretopicity", "affinity", "affinity_percentile",
    "CDR3", "TCR-score", "cellular_prevalence", "rna_alts", "rna_cov", "ref_seq", "seq", "junction_reads", "spanning_frags",
    "isoform", "orf_len", "cov", "fpkm", "sv_len", "cnv_score", "paired_ref", "paired_alt", "single_ref", "single_alt", "ref", "alt",
    "d_signature", "scaled_tpm", "scaled_ffpm", "score_expr_gene", "score_expr_local_total", "score_expr_local_ratio",
    "score_expr_local", "score_agretopicity", "score_affinity", "score_affinity_percentile",
    "score_agretopicity_scaled", "score_expr_gene_scaled", "score_expr_local_scaled",
    "score_affinity_percentile_scaled", "score_signature", "score", "is_driver", "driver_class",
)


def groove_kernel(grooves: DataFrame, penalties: Mapping[tuple[str, str], float] | None = None, *, h: float = 2.0, weights: Sequence[float] = (), allele: str = "allele", seq: str = "seq") -> DataFrame:
    """allele, other, k = exp(-distance / h) for pairs of different alleles, by places that neither has as X.

    A place costs its weight if the residues differ, or its weight times their penalty. All pairs: grooves are a panel of
    hundreds of alleles, and equal sequences are compared once; the caller's table bounds the work, not the data.
    """
    distinct = grooves.select(F.col(seq).alias("s")).distinct()
    pairs = distinct.join(distinct.select(F.col("s").alias("t")), F.length("s") == F.length("t"))
    cost = F.create_map(*(F.lit(x) for (a, b), v in penalties.items() for x in (a + b, float(v)))) if penalties else None
    w = F.array(*map(F.lit, map(float, weights))) if weights else None

    def place(p: Column, i: Column) -> Column:
        x, y = p["x"], p["y"]
        paid = F.coalesce(F.try_element_at(cost, F.concat(x, y)), F.lit(0.0)) if penalties else (x != y).cast("double")
        return F.when((x == "X") | (y == "X"), 0.0).otherwise(paid * (F.coalesce(F.get(w, i), F.lit(1.0)) if weights else F.lit(1.0)))

    distance = F.aggregate(F.transform(F.arrays_zip(F.split("s", "").alias("x"), F.split("t", "").alias("y")), place), F.lit(0.0), lambda a, x: a + x)
    kernel = pairs.select("s", "t", F.exp(-distance / h).alias("k"))
    named = grooves.select(F.col(allele).alias("allele"), F.col(seq).alias("s"))
    other = grooves.select(F.col(allele).alias("other"), F.col(seq).alias("t"))
    return named.join(kernel, "s").join(other, "t").where(F.col("allele") != F.col("other")).select("allele", "other", "k")


def groove_neighbours(kernel: DataFrame, top: int = 10, least: float = 0.0) -> DataFrame:
    """The `top` most similar others of each allele with a kernel above `least`: allele, other, k, place."""
    w = Window.partitionBy("allele").orderBy(F.desc("k"), "other")
    return kernel.where(F.col("k") > least).withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def groove_clusters(kernel: DataFrame, grooves: DataFrame, threshold: float = 0.5, *, allele: str = "allele") -> DataFrame:
    """allele, cluster: single linkage of kernels of at least the threshold, named by the least allele."""
    edges = kernel.where(F.col("k") >= threshold).select(F.col("allele").alias("a"), F.col("other").alias("b"))
    return density.connected(edges, grooves.select(F.col(allele).alias("id"))).select(F.col("id").alias(allele), F.col("component").alias("cluster"))


def restriction(queries: DataFrame, panel: DataFrame, *, cls: str = "mhc1", alpha: float = 0.05, top: int = 10, scores: DataFrame | None = None, calibrated: bool = False) -> DataFrame:
    """query, allele, vote, enrichment, n_votes, binder, place: the alleles that present each query, best first.

    Votes of neighbours gate: a binder has votes beyond chance at alpha. Without scores they rank as well. scores (query, allele,
    score) puts alleles without votes in, and ranks by score, to three decimals, then by vote; then a binder is also what scores above 0
    in class I, and in class II, whose best frame grows with the length, what has a percent rank of at most 2 among null strings of
    the query's own length (column length_rank). calibrated ranks by the percent rank instead (column pct_rank; p_present stays
    where it is given). panel: epitope, allele. Ties go to the first allele in order.
    """
    voted = counts.enrichment(neighbours.votes(queries, panel, cls=cls), counts.group_shares(panel, "allele"))
    chance = F.coalesce(F.col("enrichment") >= -F.log10(F.lit(alpha)), F.lit(False))
    each = voted.select("query", "allele", "vote", "enrichment", F.col("votes").alias("n_votes"))
    order = [F.desc("vote"), F.desc("enrichment"), F.asc("allele")]
    if scores is None:
        rows = each.withColumn("binder", chance)
    else:
        more = [c for c in ("length_rank", "pct_rank", "p_present") if c in scores.columns]
        rows = scores.select("query", "allele", F.round("score", 3).alias("score"), (F.col("score") > 0).alias("_above"), *more).join(each, ["query", "allele"], "left").fillna({"vote": 0.0, "enrichment": 0.0, "n_votes": 0})
        plausible = F.col("_above") if cls == "mhc1" else F.col("length_rank") <= 2.0
        rows = rows.withColumn("binder", ((F.col("n_votes") > 0) & chance) | F.coalesce(plausible, F.lit(False))).drop("_above")
        order = [F.desc_nulls_last("score"), F.desc("vote"), F.asc("allele")]
        if calibrated:
            rows = rows.withColumn("band", calibration.band("pct_rank"))
            order = [F.asc_nulls_last("pct_rank"), F.asc("allele")]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("place") <= top)


def is_binder(queries: DataFrame, panel: DataFrame, *, cls: str = "mhc1", alpha: float = 0.05) -> DataFrame:
    """queries (query, allele) with binder: whether the allele has votes for the query beyond chance."""
    found = restriction(queries.select("query").distinct(), panel, cls=cls, alpha=alpha, top=1 << 30).select("query", "allele", "binder")
    return queries.join(found, ["query", "allele"], "left").withColumn("binder", F.coalesce("binder", F.lit(False)))


def is_presented(restricted: DataFrame) -> DataFrame:
    """query, presented: whether any allele binds it."""
    return restricted.groupBy("query").agg(F.max("binder").alias("presented"))


def scan_proteins(proteins: DataFrame, panel: DataFrame, lengths: Sequence[int], *, name: str = "name", seq: str = "seq", cls: str = "mhc1", alpha: float = 0.05, correction: str | None = None) -> DataFrame:
    """name, offset, query, allele, enrichment, n_votes: windows with voted alleles beyond chance.

    correction: None (alpha for each), "bonferroni" (alpha over the number of voted tests) or "bh" (false discovery). Distinct
    windows are voted on once, wherever and however often they stand.
    """
    if correction not in (None, "bonferroni", "bh"):
        raise ValueError(f"unknown correction {correction!r}")
    cut = tiling.tile(proteins.select(name, seq), seq, list(lengths), kmer="query")
    voted = restriction(cut.select("query").distinct(), panel, cls=cls, alpha=alpha, top=1 << 30).where("n_votes > 0").select("query", "allele", "enrichment", "n_votes")
    tests = cut.join(voted, "query").withColumn("p", F.pow(F.lit(10.0), -F.col("enrichment")))
    if correction is None:
        kept = tests.where(F.col("enrichment") >= -F.log10(F.lit(alpha)))
    else:
        kept = (calibration.bonferroni(tests, "p", alpha) if correction == "bonferroni" else calibration.bh_cut(tests, "p", alpha)).where("significant")
    return kept.select(name, "offset", "query", "allele", "enrichment", "n_votes")


def predict_windows(records: DataFrame, scores: DataFrame, background: DataFrame, cls: str, *, threshold: float = 2.0, affinity: DataFrame | None = None) -> DataFrame:
    """Epitopes of variant windows: one row for each window of a record whose best allele has a percent rank within the threshold.

    records: header, seq. scores: peptide, allele, score of every window and its wild type (a model's output, see
    `windows_of`). background: allele, score. affinity: peptide, allele, nm. The best allele has the lowest percent rank, the
    first of equals; windows that differ from the wild type at their place have its peptide, affinity and ratios.
    """
    cut = windows_of(records, cls)
    ranked = calibration.percent_rank(scores.where(F.col("score").isNotNull()), background, ["allele"]).where(F.col("pct_rank").isNotNull())
    best = ranked.groupBy("peptide").agg(
        F.min(F.struct("pct_rank", "allele")).alias("_b"),
        F.count_if(F.col("pct_rank") <= threshold).alias("n_alleles_presenting"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("pct_rank") <= threshold, F.struct("pct_rank", "allele")))), lambda x: x["allele"]), ";").alias("alleles_presenting"),  # the alleles of a patient
    ).where(F.col("_b.pct_rank") <= threshold)
    found = cut.join(best, "peptide").select(*cut.columns, F.col("_b.allele").alias("allele"), F.col("_b.pct_rank").alias("percent_rank"), "n_alleles_presenting", "alleles_presenting")
    found = found.withColumn("band", calibration.band("percent_rank"))
    at = S.anchor_indices("peptide", F.lit(cls))
    core = S.binding_core("peptide", F.lit(cls))
    found = found.withColumn("anchors", at).withColumn("tcr_facing", S.masked("peptide", at, inside=True)).withColumn("core", core["core"]).withColumn("core_offset", core["offset"])
    for column, flank in (("synth_peptide", MAKE_FLANK), ("model_peptide", MODEL_FLANK)):
        start = F.greatest(F.lit(0), F.col("_base") + F.col("offset") + F.col("core_offset") - flank)
        cut_out = F.substring(F.col("_protein"), start + 1, F.col("_base") + F.col("offset") + F.col("core_offset") + 9 + flank - start)
        found = found.withColumn(column, F.col("peptide") if cls == "mhc1" else F.coalesce(cut_out, F.col("peptide")))
    found = found.drop("_protein", "_base")
    nm = affinity if affinity is not None else scores.select("peptide", "allele", F.lit(None).cast("double").alias("nm")).limit(0)
    own = nm.groupBy("peptide", "allele").agg(F.min("nm").alias("affinity_nm"))
    wild = own.withColumnRenamed("peptide", "wt_peptide").withColumnRenamed("affinity_nm", "wt_affinity_nm")
    found = found.join(own, ["peptide", "allele"], "left").join(wild, ["wt_peptide", "allele"], "left")
    ratio = F.when((F.col("wt_affinity_nm") > 0) & F.col("affinity_nm").isNotNull(), F.col("affinity_nm") / F.col("wt_affinity_nm"))
    return found.withColumn("agretopicity", ratio)


def windows_of(records: DataFrame, cls: str) -> DataFrame:
    """records (header, seq) tiled: header and its fields, the protein around the window and the window's place in it, variant_type, peptide, offset, wt_peptide (null where the window is the wild type's own, or there is none)."""
    seq = F.upper(F.trim("seq"))
    mutant, wild = F.upper(S.strip_marker("mut_window")), F.upper(S.strip_marker("wt_window"))
    named = records.select("header", seq.alias("seq"), *A.header_fields("header")).withColumn("variant_type", A.product(F.col("type"), F.col("subtype")))
    placed = named.withColumn("_wild", F.when((F.col("mut_window") != "") & (F.col("wt_window") != ""), S.aligned_window(mutant, wild, F.col("seq"))))
    protein = F.when(mutant != "", mutant).otherwise(F.col("seq"))
    placed = placed.withColumn("_protein", protein).withColumn("_base", F.greatest(F.instr(protein, F.col("seq")) - 1, F.lit(0)))
    cut = tiling.tile(placed, "seq", list(WINDOW_LENGTHS[cls]), kmer="peptide")
    beside = F.substring(F.col("_wild"), F.col("offset") + 1, F.length("peptide"))
    return cut.withColumn("wt_peptide", F.when((beside != F.col("peptide")) & S.is_standard(beside), beside)).drop("_wild")


def scored_table(predictions: DataFrame, cls: str) -> DataFrame:
    """The predictions under the names and in the order of the scored table, all as strings; what other modules fill stays empty."""
    starred = F.when(F.lit(cls == "mhc1") & ~F.col("allele").contains("*"), F.regexp_replace("allele", r"^(HLA-[A-Z])(\d)", "$1*$2")).otherwise(F.col("allele"))
    said = {c: F.col(c) for c in ("type", "subtype", "chrom", "pos", "gene_name", "gene_id", "transcript_id", "uniprot_id", "tpm", "ref", "alt")}
    said |= {"epitope": F.col("peptide"), "epitope_context": S.strip_marker("mut_window"), "best_allele": starred, "affinity": S.blank_nan("affinity_nm"), "affinity_percentile": F.col("percent_rank"), "agretopicity": S.blank_nan("agretopicity"), "ref_seq": S.strip_marker("wt_window"), "seq": S.strip_marker("mut_window")}
    return predictions.select(*(F.coalesce(said[c].cast("string"), F.lit("")).alias(c) if c in said else F.lit("").alias(c) for c in SCORED_COLUMNS))
