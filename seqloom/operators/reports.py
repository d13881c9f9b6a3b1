"""Tables that people read: reference sets, counts for each patient, contexts of an expression table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The table of mimics; categories that count towards tolerance, and those that are neither foreign nor self.
MIMIC_COLUMNS = ("binder", "allele", "category", "n_exact", "n_near", "top_mimic", "top_subs", "e_value", "n_hits")
TOLERANCE = ("thymus", "self")
NOT_FOREIGN = ("thymus", "self", "neoag")


def reference_sets(sets: Mapping[str, tuple[DataFrame, str]], *, pep: str = "pep") -> DataFrame:
    """category, kind, pep: distinct strings of named sets, each a table and its kind (self or foreign)."""
    out = None
    for category, (df, kind) in sets.items():
        one = df.select(F.lit(category).alias("category"), F.lit(kind).alias("kind"), pep).distinct()
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no reference sets")
    return out


def patient_summary(results: DataFrame, binders: DataFrame, categories: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """keys, n_strong_binders, n_<category>_mimic, n_tolerance_risk, n_foreign_mimic: distinct pairs of binder and allele.

    results: binder, allele, category; binders: binder, allele. A binder without mimics counts among the binders; a category
    that is not named counts as foreign only.
    """
    each = results.where("category IS NOT NULL").groupBy(*keys, "binder", "allele").agg(
        *(F.max((F.col("category") == c).cast("int")).alias(f"_{i}") for i, c in enumerate(categories)),
        F.max(F.col("category").isin(*TOLERANCE).cast("int")).alias("_t"),
        F.max((~F.col("category").isin(*NOT_FOREIGN)).cast("int")).alias("_f"),
    )
    names = [*(f"n_{c}_mimic" for c in categories), "n_tolerance_risk", "n_foreign_mimic"]
    flags = [*(f"_{i}" for i in range(len(categories))), "_t", "_f"]
    counted = each.groupBy(*keys).agg(*(F.sum(f).alias(n) for f, n in zip(flags, names, strict=True)))
    total = binders.select(*keys, "binder", "allele").distinct().groupBy(*keys).agg(F.count("*").alias("n_strong_binders"))
    both = total.join(counted, list(keys), "full") if keys else total.join(F.broadcast(counted))  # one row each
    return both.select(*keys, *(F.coalesce(n, F.lit(0)).alias(n) for n in ("n_strong_binders", *names)))


def contexts(expression: DataFrame, kind: str) -> DataFrame:
    """context: those that an expression table has for genes (tissues) or peptides (tumour types), in order."""
    return expression.where(F.col("key_type") == kind).select("context").distinct().orderBy("context")
