"""Heads over the part of a string that a receptor sees: role weights, scales, linear heads by block, and search by channel."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import scoring
from seqloom.functions import sequences as S
from seqloom.operators import neighbours, recognition

#: Places that face the groove in a class I string, from either end, and in a class II core; the end of the logit.
GROOVE = (0, 1, 2, -2, -1)
CORE_GROOVE = (0, 3, 5, 8)
CLIP = 60.0


def groove(pep: str | Column, cls: str = "mhc1", register: Column | None = None) -> Column:
    """Zero-based places that face the groove: five fixed ones for class I; pockets of the core, of the given or best register, for class II."""
    p = F.col(pep) if isinstance(pep, str) else pep
    if cls == "mhc2":
        start = S.best_register(p) if register is None else register
        return F.transform(F.array(*map(F.lit, CORE_GROOVE)), lambda i: i + start)
    return F.array_distinct(F.array(*(F.pmod(F.lit(i), F.length(p)) for i in GROOVE)))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def llr(pep: str | Column, weights: Mapping[str, Mapping[str, float]], at: Column | None = None) -> Column:
    """Log-likelihood ratio without a prior: of each place the weight of its residue in "anchor" or "tcrface"; other letters add nothing."""
    p = F.upper(F.col(pep) if isinstance(pep, str) else pep)
    inside = groove(p) if at is None else at
    parts = {role: recognition.scale_values(p, weights[role]) for role in ("anchor", "tcrface")}
    here = F.zip_with(parts["anchor"], parts["tcrface"], lambda a, t: F.struct(a.alias("a"), t.alias("t")))
    return _sum(F.transform(here, lambda v, i: F.when(F.array_contains(inside, i), v["a"]).otherwise(v["t"])))


def posterior(score: str | Column, prior: float) -> Column:
    """The probability at an explicit prior of a score that carries none."""
    if not 0.0 < prior < 1.0:
        raise ValueError(f"a prior lies between 0 and 1, not {prior!r}")
    z = (F.col(score) if isinstance(score, str) else score) + math.log(prior / (1.0 - prior))
    return scoring.sigmoid(F.least(F.greatest(z, F.lit(-CLIP)), F.lit(CLIP)))


def core_llr(pep: str | Column, weights: Mapping[str, Mapping[str, float]], register: Column | None = None) -> Column:
    """llr of the nine-letter core of a class II string, for ranking among such; null where there is no core."""
    p = F.upper(F.col(pep) if isinstance(pep, str) else pep)
    start = S.best_register(p) if register is None else register
    core = F.when((start >= 0) & (start <= F.length(p) - 9), F.substring(p, start + 1, F.lit(9)))
    return llr(core, weights, F.array(*map(F.lit, CORE_GROOVE)))


def burial(pep: str | Column, scale: Mapping[str, float], at: Column | None = None, *, per_residue: bool = True) -> Column:
    """Mean (or sum) of a scale over the places off the groove; the mean is null where there are none."""
    p = F.col(pep) if isinstance(pep, str) else pep
    inside = groove(p) if at is None else at
    face = F.filter(recognition.scale_values(p, scale), lambda _, i: ~F.array_contains(inside, i))
    return _sum(face) / F.nullif(F.size(face), F.lit(0)) if per_residue else _sum(face)


def scale_design(pep: str | Column, scales: Mapping[str, Mapping[str, float]], at: Column | None = None) -> list[Column]:
    """Of each scale the sums over the groove, the face and the whole string: <scale>_anchor, <scale>_tcr, <scale>_all."""
    p = F.col(pep) if isinstance(pep, str) else pep
    inside = groove(p) if at is None else at
    out = []
    for name, scale in scales.items():
        values = recognition.scale_values(p, scale)
        out.append(_sum(F.filter(values, lambda _, i: F.array_contains(inside, i))).alias(f"{name}_anchor"))
        out.append(_sum(F.filter(values, lambda _, i: ~F.array_contains(inside, i))).alias(f"{name}_tcr"))
        out.append(_sum(values).alias(f"{name}_all"))
    return out


def head(df: DataFrame, model: Sequence[Mapping], *, intercept: float, prevalence: float, blocks: Sequence[str] | None = None, score: str = "score") -> DataFrame:
    """df with the score of a linear head over standardised features, rows of feature, block, coef, mu, sigma.

    The whole head has its corpus's own base rate taken out. Of given blocks it is the exact partial sum, without the
    intercept, so that the parts and intercept - logit(prevalence) add up to the whole.
    """
    if not 0.0 < prevalence < 1.0:
        raise ValueError(f"a prevalence lies between 0 and 1, not {prevalence!r}")
    if blocks is not None and (unknown := set(blocks) - {m["block"] for m in model}):
        raise ValueError(f"no block {', '.join(sorted(unknown))}")
    kept = [m for m in model if blocks is None or m["block"] in blocks]
    base = intercept - math.log(prevalence / (1.0 - prevalence)) if blocks is None else 0.0
    return scoring.linear(df, kept, intercept=base, score=score, imputed="_imputed").drop("_imputed")


def _channels(df: DataFrame, pep: str, cls: str) -> DataFrame:
    """df of standard strings, once for the groove (anchor) and once for the face (tcr), with the letters of that channel in _key."""
    at = groove(pep, cls)
    cut = lambda inside: F.array_join(F.filter(S.chars(pep), lambda _, i: F.array_contains(at, i) == F.lit(inside)), "")
    both = F.array(*(F.struct(F.lit(name).alias("channel"), cut(inside).alias("_key")) for name, inside in (("anchor", True), ("tcr", False))))
    return df.where(S.is_standard(pep) & F.array_max(at).isNotNull()).withColumn("_z", F.explode(both)).select(*df.columns, "_z.channel", "_z._key")


def channel_references(refs: DataFrame, cls: str = "mhc1") -> DataFrame:
    """component, channel, length, _key, pep, source: distinct projections of reference windows (component, pep, source), with the first window of each."""
    each = _channels(refs.select("component", "pep", "source"), "pep", cls).withColumn("length", F.length("pep"))
    first = each.groupBy("component", "channel", "length", "_key").agg(F.min(F.struct("pep", "source")).alias("_m"))
    return first.select("component", "channel", "length", "_key", "_m.pep", "_m.source")


def channel_search(queries: DataFrame, references: DataFrame, radius: Mapping[str, int], cls: str = "mhc1") -> DataFrame:
    """pep, component, channel, n, density, subs, mimic, source: of queries (pep) the projections of each component of their length within the channel's radius.

    density is log1p of the hits by a million projections of that length; where nothing is near, n is 0 and the nearest is
    null. Components that have no window of the length are absent: they were not looked at. Projections of all components
    are joined once for each channel, by pieces, so a hit is a row before it is counted.
    """
    asked = _channels(queries.select("pep").distinct(), "pep", cls).withColumn("length", F.length("pep"))
    size = references.groupBy("component", "channel", "length").agg(F.count("*").alias("windows"))
    found = None
    for channel, d in radius.items():
        tag = lambda df: df.where(F.col("channel") == channel).select("_key")  # noqa: B023, E731
        near = neighbours.hamming_join(tag(asked).withColumnRenamed("_key", "query"), tag(references).withColumnRenamed("_key", "ref"), d).withColumn("channel", F.lit(channel))
        found = near if found is None else found.unionByName(near)
    hits = asked.join(found, (asked["_key"] == found["query"]) & (asked["channel"] == found["channel"])).select("pep", asked["channel"], "length", "ref", "dist")
    r = references.select("component", "channel", "length", F.col("_key").alias("ref"), F.col("pep").alias("mimic"), "source")
    best = hits.join(r, ["channel", "length", "ref"]).groupBy("pep", "component", "channel").agg(F.count("*").alias("n"), F.min(F.struct("dist", "mimic", "source")).alias("_m"))
    looked = asked.select("pep", "channel", "length").join(size, ["channel", "length"])
    out = looked.join(best, ["pep", "component", "channel"], "left")
    n = F.coalesce("n", F.lit(0))
    return out.select("pep", "component", "channel", n.alias("n"), F.log1p(1e6 * n / F.col("windows")).alias("density"), F.col("_m.dist").alias("subs"), F.col("_m.mimic").alias("mimic"), F.col("_m.source").alias("source"))


def safety(found: DataFrame, symbols: DataFrame, expression: DataFrame, *, components: Sequence[str] = ("self", "thymus"), top: int = 5) -> DataFrame:
    """pep, component, channel, subs, mimic, source, gene, profile: where the nearest mimics of the tolerance side are expressed.

    symbols (source, gene) names the gene of a source, which else stands for itself; profile is the array of the `top`
    tissues (tissue, tpm) of highest expression, empty for a gene without any.
    """
    genes = expression.where("key_type = 'gene'").select(F.col("key").alias("gene"), F.struct(F.col("median_tpm").alias("tpm"), F.col("context").alias("tissue")).alias("z"))
    w = Window.partitionBy("gene").orderBy(F.desc("z.tpm"), "z.tissue")  # a gene has one row for each tissue
    first = genes.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("_r", "z.tissue", "z.tpm"))).alias("_p"))
    profile = first.select("gene", F.transform("_p", lambda p: F.struct(p["tissue"].alias("tissue"), p["tpm"].alias("tpm"))).alias("profile"))
    names = symbols.groupBy("source").agg(F.min("gene").alias("_gene"))
    hits = found.where(F.col("component").isin(*components) & F.col("mimic").isNotNull()).join(names, "source", "left").withColumn("gene", F.coalesce("_gene", "source"))
    none = F.array().cast(profile.schema["profile"].dataType)
    return hits.join(profile, "gene", "left").select("pep", "component", "channel", "subs", "mimic", "source", "gene", F.coalesce("profile", none).alias("profile"))
