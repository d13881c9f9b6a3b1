"""Ranking candidates: best group per item, tiers, tops, known sets, expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators import ordered


def top(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key; order has to be total for a repeatable result."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def restriction_order(calibrated: bool) -> list[Column]:
    """Lowest percent rank first; without calibration the most votes, then the strongest enrichment."""
    return [F.asc_nulls_last("pct_rank"), F.asc("allele")] if calibrated else [F.desc("vote"), F.desc("enrichment"), F.asc("allele")]


def best_group(df: DataFrame, keys: Sequence[str], group: str, rank: str, threshold: float) -> DataFrame:
    """keys, best (lowest rank, the first group of equals), best_rank, n_presenting and presenting (sorted, ;-joined) at or below the threshold."""
    r = F.col(rank)
    agg = df.groupBy(*keys).agg(F.min(F.when(r.isNotNull(), F.struct(r.alias("r"), F.col(group).alias("g")))).alias("_b"), F.count_if(r <= threshold).alias("n_presenting"), F.array_join(F.array_sort(F.collect_set(F.when(r <= threshold, F.col(group)))), ";").alias("presenting"))
    return agg.select(*keys, F.col("_b.g").alias("best"), F.col("_b.r").alias("best_rank"), "n_presenting", "presenting")


def dense_tiers(df: DataFrame, score: str, tier: str, keys: Sequence[str] = ()) -> DataFrame:
    """df with rank, dense by falling score, nulls last; tier orders the listing only, and is ranked before the score in position.

    Ranks are counts of the distinct scores above, by ranges of scores.
    """
    distinct = df.select(*keys, score).distinct().withColumn("_one", F.lit(1))
    scores = ordered.before(distinct, score, {"rank": ("sum", "_one")}, keys, falling=True).withColumn("rank", F.col("rank") + 1)
    on = F.lit(True)
    s = scores.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(score).alias("_score"), "rank")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(s, on & F.col(score).eqNullSafe(F.col("_score"))).drop("_score", *(f"_{k}" for k in keys))


def known_set(df: DataFrame, sets: DataFrame, key: str, *, sets_key: str | None = None) -> DataFrame:
    """df with known: the set of the least priority that has the key; sets: key, set, priority."""
    k = sets_key or key
    first = sets.groupBy(F.col(k).alias("_k")).agg(F.min(F.struct("priority", "set")).alias("_s")).select("_k", F.col("_s.set").alias("known"))
    return df.join(first, F.col(key) == F.col("_k"), "left").drop("_k")


def labelled_sets(rows: DataFrame, key: str, label: str) -> DataFrame:
    """key, label: distinct, without negatives (0) that are positive (1) in any source."""
    d = rows.select(key, label).distinct()
    return d.join(d.where(F.col(label) == 1).select(key), key, "left_anti").unionByName(d.where(F.col(label) == 1))


def expression_value(df: DataFrame, reference: DataFrame, *, peptide: str, gene: str, tumor: str | None, tissue: str | None) -> DataFrame:
    """df with tpm and tpm_source: of the peptide in the tumour type, else of the gene in the tissue; one context of them has to be given."""
    if tumor is None and tissue is None:
        raise ValueError("a tumour type or a tissue is needed")
    ref = lambda kind, context, name: reference.where((F.col("key_type") == kind) & (F.col("context") == context)).groupBy("key").agg(F.max("median_tpm").alias(name))
    p = ref("peptide", tumor or "", "_p").withColumnRenamed("key", peptide)
    g = ref("gene", tissue or "", "_g").withColumnRenamed("key", gene)
    out = df.join(p, peptide, "left").join(g, gene, "left")
    return out.withColumn("tpm", F.coalesce("_p", "_g")).withColumn("tpm_source", F.when(F.col("_p").isNotNull(), "peptide").when(F.col("_g").isNotNull(), "gene")).drop("_p", "_g")


def impute(df: DataFrame, value: str, reference: str) -> DataFrame:
    """df with value filled from reference, and <value>_missing: 1 where value itself was null."""
    return df.withColumn(f"{value}_missing", F.col(value).isNull().cast("int")).withColumn(value, F.coalesce(value, reference))


def essential_genes(expression: DataFrame, tissues: Sequence[str], floor: float) -> DataFrame:
    """gene, tissues: essential tissues, by beginning of their name, in which a gene reaches the floor."""
    hit = F.lit(False)
    for t in tissues:
        hit = hit | F.col("context").startswith(t)
    return expression.where((F.col("key_type") == "gene") & hit & (F.col("median_tpm") >= floor)).groupBy(F.col("key").alias("gene")).agg(F.array_join(F.array_sort(F.collect_set("context")), ";").alias("tissues"))
