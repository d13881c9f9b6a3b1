"""The ranking of a donor's candidates: features of predictions or of a scored table, injected channels, one linear score, ranks and chances.

Channels are DataFrames that the caller supplies, by peptide, or by peptide and allele. A channel or a feature that the model
declares and nobody supplies is an error; a value that a candidate lacks counts as the mean of the fit, and is named.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import alleles as A
from seqloom.functions import scoring
from seqloom.functions import sequences as S
from seqloom.operators import calibration, immunity, ranking

#: Channels that a caller supplies, and responders among the candidates of a pool.
CHANNELS = ("C_corpus_thymus", "C_corpus_self", "C_corpus_viral")
PREVALENCE = 37.0 / 615.0


def fill_channels(rows: DataFrame, channels: Mapping[str, DataFrame], wanted: Sequence[str] = CHANNELS) -> DataFrame:
    """rows (peptide, allele) with a column for each wanted channel; channels: by name, tables of peptide, allele where it matters, and value.

    A wanted channel that is not there is an error; a candidate that a channel does not have gets null. Of repeated keys the largest
    value counts. Channels are joined, however large they are.
    """
    missing = [c for c in wanted if c not in channels]
    if missing:
        raise ValueError(f"channels not supplied: {', '.join(missing)}; all of {', '.join(wanted)} are needed")
    for name in wanted:
        table = channels[name]
        keys = [k for k in ("peptide", "allele") if k in table.columns]
        if "peptide" not in keys or "value" not in table.columns:
            raise ValueError(f"channel {name} needs the columns peptide and value")
        rows = rows.join(table.groupBy(*keys).agg(F.max(S.blank_nan(F.col("value").cast("double"))).alias(name)), keys, "left")
    return rows


def _number(c: Column) -> Column:
    """A finite number, else null."""
    return S.blank_nan(c.cast("string").try_cast("double"))


def features(rows: DataFrame, *, expression: Sequence[DataFrame] = (), scales: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """rows with pres, binder, occupancy, d_occupancy, wt_absent, agretopicity, expr, expr_missing, and the burial of each peptide on each scale.

    rows: peptide, gene, presentation_rank, binder_rank, affinity_nm, wt_affinity_nm, tpm; what is null, NaN or below 0 is unknown.
    expression: tables of tpm by peptide or gene, in the order in which they stand in for a value that was not observed, which is
    then flagged.
    """
    nm, wt = _number(F.col("affinity_nm")), _number(F.col("wt_affinity_nm"))
    wt = F.when(wt > 0, wt)
    out = rows.withColumn("_tpm", _number(F.col("tpm")))
    observed = F.col("_tpm")
    stand_in = F.lit(None).cast("double")
    for i, table in enumerate(expression):
        keys = [k for k in ("peptide", "gene") if k in table.columns]
        out = out.join(table.groupBy(*keys).agg(F.max(F.col("tpm").cast("double")).alias(f"_e{i}")), keys, "left")
        stand_in = F.coalesce(stand_in, F.col(f"_e{i}"))
    out = out.select(
        *rows.columns,
        *(F.when(_number(F.col(c)).isNotNull(), S.neglog10(_number(F.col(c)))).alias(name) for c, name in (("presentation_rank", "pres"), ("binder_rank", "binder"))),
        scoring.occupancy(nm).alias("occupancy"),
        scoring.occupancy_gain(nm, wt).alias("d_occupancy"),
        F.when(wt.isNull(), 1.0).otherwise(0.0).alias("wt_absent"),
        F.when(nm > 0, scoring.agretopicity(wt, nm)).alias("agretopicity"),
        F.log1p(F.coalesce(observed, stand_in)).alias("expr"),
        F.when(observed.isNull(), 1.0).otherwise(0.0).alias("expr_missing"),
    )
    for name, scale in (scales or {}).items():
        out = out.withColumn(name, immunity.burial("peptide", scale))
    return out


def ranked(rows: DataFrame, model: Sequence[Mapping], *, known: DataFrame | None = None, prevalence: float = PREVALENCE) -> DataFrame:
    """rows with score, imputed (names of features that a row lacks, joined by semicolons), p_response, rank (dense, by falling score), known and listing.

    model: feature, coef, mu, sigma. p_response is the score shifted so that its mean chance over all rows is the prevalence, which moves no
    rank. known: peptide, set, priority; known candidates have listing 0, others
    1: a list in order of listing and rank has them first, and no rank moves.
    """
    if not 0 < prevalence < 1:
        raise ValueError("a prevalence lies between 0 and 1")
    scored = scoring.linear(rows, model)
    named = scored.withColumn("known", F.lit(None).cast("string")) if known is None else ranking.known_set(scored, known, "peptide")
    shift = calibration.prevalence_shift(named, "score", prevalence)
    tiered = named.withColumn("p_response", scoring.sigmoid(F.col("score") + shift)).withColumn("listing", F.col("known").isNull().cast("int"))
    return ranking.dense_tiers(tiered, "score", "listing")


def rank_predictions(predictions: DataFrame, model: Sequence[Mapping], channels: Mapping[str, DataFrame], *, wanted: Sequence[str] = CHANNELS, expression: Sequence[DataFrame] = (), scales=None, known: DataFrame | None = None, prevalence: float = PREVALENCE) -> DataFrame:
    """Predicted windows (see restriction.predict_windows) as ranked candidates; tpm and gene come from their headers."""
    has = set(predictions.columns)
    either = lambda *names: F.coalesce(*(F.col(n) for n in names if n in has), F.lit(None).cast("double"))
    rows = predictions.withColumn("gene", F.col("gene_name")).withColumn("presentation_rank", either("presentation_rank", "percent_rank")).withColumn("binder_rank", either("binder_rank"))
    return ranked(fill_channels(features(rows, expression=expression, scales=scales), channels, wanted), model, known=known, prevalence=prevalence)


def rank_table(table: DataFrame, model: Sequence[Mapping], channels: Mapping[str, DataFrame], ranks: DataFrame | None = None, *, cls: str = "mhc1", wanted: Sequence[str] = CHANNELS, expression: Sequence[DataFrame] = (), scales=None, known: DataFrame | None = None, prevalence: float = PREVALENCE) -> DataFrame:
    """A scored table (epitope, best_allele, gene_name, tpm, affinity, type, subtype, score, …, as strings) as ranked candidates.

    Rows whose epitope has other signs than letters are left out. ranks: peptide, allele, presentation_rank, binder_rank of a scorer
    of one's own; without it both are unknown. The table has no wild type: the gain of occupancy is the mutant's own. Its own score
    is kept as score_builtin. variant_type is the table's, if it has one, else the product of type and subtype; core is that of the
    place, as the table has no register.
    """
    has = set(table.columns)
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in has else F.lit("")
    own = F.when(text("variant_type") != "", text("variant_type")).otherwise(A.product(text("type"), text("subtype")))
    rows = table.select(
        F.upper(text("epitope")).alias("peptide"), text("best_allele").alias("allele"), text("gene_name").alias("gene"), _number(text("tpm")).alias("tpm"), _number(text("affinity")).alias("affinity_nm"),
        F.lit(None).cast("double").alias("wt_affinity_nm"), _number(text("score")).alias("score_builtin"), own.alias("variant_type"),
    ).where(F.col("peptide").rlike(r"^\p{L}+$"))
    core = S.binding_core("peptide", F.lit(cls))
    rows = rows.withColumn("core", core["core"]).withColumn("core_offset", core["offset"]).withColumn("core_source", F.when(F.coalesce(F.col("core"), F.lit("")) == "", "").otherwise("heuristic" if cls == "mhc2" else "footprint"))
    if ranks is None:
        rows = rows.withColumn("presentation_rank", F.lit(None).cast("double")).withColumn("binder_rank", F.lit(None).cast("double"))
    else:
        rows = rows.join(ranks.groupBy("peptide", "allele").agg(F.min("presentation_rank").alias("presentation_rank"), F.min("binder_rank").alias("binder_rank")), ["peptide", "allele"], "left")
    return ranked(fill_channels(features(rows, expression=expression, scales=scales), channels, wanted), model, known=known, prevalence=prevalence)
