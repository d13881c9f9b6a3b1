"""Units of a construct: cutting, joining to contexts, junction costs, order, safety, maps."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.alleles import TRACTS
from seqloom.functions.sequences import CODONS
from seqloom.operators.neighbours import hamming_join


def back_translate(pep: str, usage: dict[str, float] | None = None, most_run: int = 4) -> str:
    """Codons by falling usage, the first that makes no run of one base longer than most_run; of all too long the one that makes the shortest."""
    by: dict[str, list[str]] = {}
    for codon, r in CODONS.items():
        by.setdefault(r, []).append(codon)

    def run(s: str) -> int:
        best = now = 1
        for a, b in pairwise(s):
            now = now + 1 if a == b else 1
            best = max(best, now)
        return best

    out = ""
    for r in pep:
        options = sorted(by.get(r, ["NNN"]), key=lambda c: (-(usage or {}).get(c, 0.0), c))
        lengths = [run(out[-most_run:] + c) for c in options]
        out += next((c for c, n in zip(options, lengths, strict=True) if n <= most_run), options[lengths.index(min(lengths))])
    return out


def back_translated(df: DataFrame, pep: str, usage: dict[str, float] | None = None, most_run: int = 4) -> DataFrame:
    """df with cds; a codon depends on those before it, so the fold runs in Python, in Arrow batches."""

    @F.pandas_udf("string")
    def codons_of(s: pd.Series) -> pd.Series:
        return s.map(lambda p: None if p is None else back_translate(p, usage, most_run))

    return df.withColumn("cds", codons_of(pep))


def in_context(units: DataFrame, contexts: DataFrame, seed: int = 8) -> DataFrame:
    """units (pep, gene, p) joined to contexts (context_id, context, gene_name) that contain them: one row per unit, the same gene first, then the lowest id.

    The first `seed` letters of a unit are found among the windows of a context, and the rest is verified.
    """
    cut = contexts.where(F.length("context") >= seed).select("context_id", "context", "gene_name", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("context") - (seed - 1)), lambda i: F.substring(F.col("context"), i, F.lit(seed)))).alias("offset", "_seed"))
    found = units.withColumn("_seed", F.substring("pep", 1, seed)).join(cut, "_seed").where(F.substring(F.col("context"), F.col("offset") + 1, F.length("pep")) == F.col("pep"))
    best = F.min(F.struct((F.col("gene") != F.col("gene_name")).alias("other"), "context_id", "offset", "context")).alias("_b")
    return found.groupBy("pep", "gene", "p").agg(best).select("pep", "gene", "p", "_b.context_id", "_b.context", "_b.offset", (~F.col("_b.other")).alias("same_gene"))


def novel_registers(units: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """unit, gene, register, novel: the distinct windows of every unit, and whether one of their places holds what its variant made.

    units: unit, gene, peptide, mutation_index (zero-based), kind of product. A point product is novel at that place alone, so a
    window has to contain it; a tract, a frameshift or a fusion, is novel from there on, so a window has to reach it. A window that
    stands at several places is novel if one of them is.
    """
    sized = units.withColumn("_n", F.explode(F.array(*map(F.lit, lengths)))).where(F.length("peptide") >= F.col("_n"))
    each = sized.withColumn("_at", F.explode(F.sequence(F.lit(0), F.length("peptide") - F.col("_n"))))
    wide = F.lower(F.trim(F.coalesce("kind", F.lit("")))).isin(*TRACTS)
    new = (F.col("_at") + F.col("_n") > F.col("mutation_index")) & (wide | (F.col("_at") <= F.col("mutation_index")))
    return each.select("unit", "gene", F.substring(F.col("peptide"), F.col("_at") + 1, F.col("_n")).alias("register"), new.alias("novel")).groupBy("unit", "gene", "register").agg(F.max("novel").alias("novel"))


def self_origin(units: DataFrame, proteins: DataFrame, essential: DataFrame, *, radius: int = 1) -> DataFrame:
    """unit, clause, gene: reasons against a unit. units: unit, gene, register, novel (see novel_registers); proteins: gene, kmer; essential: gene.

    target: the unit's own gene is essential. exact: a novel register stands in an unrelated essential gene. near: a register is
    within one substitution of one, which is reported and withdraws nothing. A radius beyond 1 is refused: every string is near
    another then.
    """
    if radius > 1:
        raise ValueError("a radius beyond 1 is not supported")
    target = units.select("unit", "gene").distinct().join(essential.select("gene"), "gene").select("unit", F.lit("target").alias("clause"), "gene")
    risky = proteins.join(essential.select("gene"), "gene").select(F.col("gene").alias("_g"), "kmer").distinct()
    registers = units.select("unit", "gene", "register", "novel").distinct()
    exact = registers.where("novel").join(risky, F.col("register") == F.col("kmer")).where(F.col("gene") != F.col("_g")).select("unit", F.lit("exact").alias("clause"), F.col("_g").alias("gene"))
    out = target.unionByName(exact)
    if radius:
        pairs = hamming_join(registers.select(F.col("register").alias("query")), risky.select(F.col("kmer").alias("ref")), 1, least=1)
        near = registers.join(pairs, F.col("register") == F.col("query")).join(risky, F.col("ref") == F.col("kmer")).where(F.col("gene") != F.col("_g")).select("unit", F.lit("near").alias("clause"), F.col("_g").alias("gene"))
        out = out.unionByName(near)
    return out.distinct()


def screen(units: DataFrame, risks: DataFrame) -> DataFrame:
    """Units without a reason that withdraws them (target or exact)."""
    return units.join(risks.where(F.col("clause") != "near").select("unit").distinct(), "unit", "left_anti")


def offtarget_cost(risks: DataFrame) -> DataFrame:
    """unit, cost: distinct pairs of clause and gene."""
    return risks.groupBy("unit").agg(F.count_distinct("clause", "gene").alias("cost"))


def order_units(costs: DataFrame, group: str = "cassette") -> DataFrame:
    """group, unit, position: an order of units of low worst and then summed junction cost; costs: group, left, right, cost.

    Greedy from each start, then two-opt. A construct is short, so its costs form one group; they are made in SQL before.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        cost = {(a, b): c for a, b, c in zip(pdf.left, pdf.right, pdf.cost, strict=True)}
        names = sorted({*pdf.left, *pdf.right})

        def total(path: Sequence) -> tuple[float, float]:
            each = [cost.get(p, 0.0) for p in pairwise(path)]
            return (max(each, default=0.0), sum(each))

        best = None
        for first in names:
            path, left = [first], [n for n in names if n != first]
            while left:
                path.append(min(left, key=lambda n: (cost.get((path[-1], n), 0.0), n)))
                left.remove(path[-1])
            better = True
            while better:
                better = False
                for i in range(len(path)):
                    for j in range(i + 2, len(path) + 1):
                        other = path[:i] + path[i:j][::-1] + path[j:]
                        if total(other) < total(path):
                            path, better = other, True
            if best is None or (total(path), path) < (total(best), best):
                best = path
        return pd.DataFrame({group: pdf[group].iloc[0], "unit": best, "position": range(len(best))})

    kind = costs.schema[group].dataType.simpleString()
    unit = costs.schema["left"].dataType.simpleString()
    return costs.select(group, "left", "right", "cost").groupBy(group).applyInPandas(lambda pdf: one(pdf), f"{group} {kind}, unit {unit}, position int")


def overlaps(a: DataFrame, b: DataFrame, *, width: int, keys: Sequence[str] = ()) -> DataFrame:
    """a_id, b_id of closed intervals (id, start, end) that overlap: each is dealt to the buckets of `width` that it touches, and a pair is made in the bucket where the later of the two begins."""
    cut = lambda df, p: df.select(*keys, F.col("id").alias(f"{p}_id"), F.col("start").alias(f"{p}_s"), F.col("end").alias(f"{p}_e"), F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("_b"))
    both = cut(a, "a").join(cut(b, "b"), [*keys, "_b"])
    return both.where((F.col("a_s") <= F.col("b_e")) & (F.col("b_s") <= F.col("a_e")) & (F.col("_b") == F.floor(F.greatest("a_s", "b_s") / width))).select(*keys, "a_id", "b_id")


def map_summary(features: DataFrame) -> DataFrame:
    """unit, n_class1, n_class2, n_alleles, self_help (both classes in one unit); features: unit, cls, allele."""
    return features.groupBy("unit").agg(F.count_if(F.col("cls") == "mhc1").alias("n_class1"), F.count_if(F.col("cls") == "mhc2").alias("n_class2"), F.count_distinct("allele").alias("n_alleles")).withColumn("self_help", (F.col("n_class1") > 0) & (F.col("n_class2") > 0))


def split_cassette(df: DataFrame, seq: str, spacer: str) -> DataFrame:
    """df with one row for each part of a cassette between spacers, empty ones left out: segment, pep, mutation_index (its middle)."""
    if not spacer:
        raise ValueError("a spacer is needed")
    parts = F.filter(F.split(seq, "\\Q" + spacer.replace("\\E", "\\E\\\\E\\Q") + "\\E"), lambda s: s != "")
    return df.select("*", F.posexplode(parts).alias("segment", "pep")).withColumn("mutation_index", F.floor(F.length("pep") / 2).cast("int"))
