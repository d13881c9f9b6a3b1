"""Features of the part of a string that a T cell sees: compositions by role, weighted scales, runs, table lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.sequences import anchor_indices


def roles(pep: Column, anchors: Column | None = None) -> Column:
    """array<string>: anchor or face for each place."""
    at = anchor_indices(pep) if anchors is None else anchors
    return F.transform(F.split(pep, ""), lambda _, i: F.when(F.array_contains(at, i), F.lit("anchor")).otherwise(F.lit("face")))


def role_counts(df: DataFrame, pep: str) -> DataFrame:
    """pep, role, residue, n: long format, no column for what does not occur."""
    d = df.select(pep).distinct().withColumn("_z", F.arrays_zip(roles(F.col(pep)).alias("role"), F.split(pep, "").alias("residue")))
    return d.select(pep, F.explode("_z").alias("z")).groupBy(pep, F.col("z.role").alias("role"), F.col("z.residue").alias("residue")).agg(F.count("*").alias("n"))


def table_score(counts: DataFrame, table: DataFrame, pep: str) -> DataFrame:
    """pep, score: counts times the weights of (role, residue, w); a pair without a weight adds nothing."""
    return counts.join(table, ["role", "residue"], "left").groupBy(pep).agg(F.sum(F.col("n") * F.coalesce("w", F.lit(0.0))).alias("score"))


def scale_values(pep: Column, scale: Mapping[str, float]) -> Column:
    """array<double>: value of each residue, 0 for others."""
    table = F.create_map(*(F.lit(x) for k, v in scale.items() for x in (k, float(v))))
    return F.transform(F.split(pep, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), F.lit(0.0)))


def weighted_aggregate(values: Column, weights: Column, threshold: float) -> Column:
    """struct<sum, mean, low, high, run_max, run_n, run_frac>: weighted sum and mean, and extremes and runs at or above the threshold where the weight is not 0."""
    pairs = F.zip_with(values, weights, lambda v, w: F.struct(v.alias("v"), w.alias("w")))
    used = F.filter(pairs, lambda p: p["w"] > 0)
    total = F.aggregate(used, F.lit(0.0), lambda a, p: a + p["v"] * p["w"])
    weight = F.aggregate(used, F.lit(0.0), lambda a, p: a + p["w"])
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"), F.lit(0).alias("n"), F.lit(0).alias("at"))
    runs = F.aggregate(
        used,
        start,
        lambda a, p: F.when(
            p["v"] >= threshold,
            F.struct((a["now"] + 1).alias("now"), F.greatest(a["most"], a["now"] + 1).alias("most"), (a["n"] + (a["now"] == 0).cast("int")).alias("n"), (a["at"] + 1).alias("at")),
        ).otherwise(F.struct(F.lit(0).alias("now"), a["most"].alias("most"), a["n"].alias("n"), a["at"].alias("at"))),
    )
    v = F.transform(used, lambda p: p["v"])
    return F.struct(total.alias("sum"), (total / F.nullif(weight, F.lit(0.0))).alias("mean"), F.array_min(v).alias("low"), F.array_max(v).alias("high"), runs["most"].alias("run_max"), runs["n"].alias("run_n"), (runs["at"] / F.nullif(F.size(used), F.lit(0))).alias("run_frac"))


def contact_weights(pep: Column, profile: Mapping[int, Sequence[float]], pooled: Sequence[float]) -> Column:
    """Weights of the places of a string: the shares of its length, those below 1 / (2 L) as 0, the others scaled to a mean of 1; all 1 where none is left.

    A length that the profile lacks takes the pooled shape by relative places, interpolated between its points and made shares.
    """
    n, points = F.length(pep), F.array(*(F.lit(float(w)) for w in pooled))
    last = len(pooled) - 1

    def between(i: Column) -> Column:
        x = (i + 0.5) / n * len(pooled) - 0.5
        low = F.greatest(F.lit(0), F.least(F.lit(last), F.floor(x).cast("int")))
        return F.get(points, low) * (1 - (x - low)) + F.get(points, F.least(F.lit(last), low + 1)) * (x - low)

    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    shape = F.transform(F.sequence(F.lit(0), n - 1), between)
    shares = F.transform(F.array(shape), lambda s: F.transform(s, lambda x: x / F.when(total(s) == 0, 1.0).otherwise(total(s))))[0]
    for length, raw in sorted(profile.items()):
        shares = F.when(n == length, F.array(*(F.lit(float(w)) for w in raw))).otherwise(shares)
    kept = F.transform(shares, lambda w: F.when(w >= 1 / (2 * n), w).otherwise(0.0))

    def scaled(k: Column) -> Column:
        left = F.filter(k, lambda w: w > 0)
        return F.when(F.size(left) == 0, F.transform(k, lambda w: F.lit(1.0))).otherwise(F.transform(k, lambda w: w / (total(left) / F.size(left))))

    return F.when(n > 0, F.transform(F.array(kept), scaled)[0]).otherwise(F.array().cast("array<double>"))


def context_score(df: DataFrame, table: DataFrame, pep: str, before: str, after: str, flank: int = 3) -> DataFrame:
    """df with context: summed log odds of the residues around and at the ends of a string; table: place (B-1 … A+3, N1 …, C1 …), residue, value."""
    p, b, a = F.col(pep), F.col(before), F.col(after)
    places = [(f"B-{i}", F.substring(b, -i, 1)) for i in range(1, flank + 1)] + [(f"A+{i}", F.substring(a, i, 1)) for i in range(1, flank + 1)]
    places += [(f"N{i}", F.substring(p, i, 1)) for i in range(1, flank + 1)] + [(f"C{i}", F.substring(p, -i, 1)) for i in range(1, flank + 1)]
    rows = df.select(pep, before, after).distinct().withColumn("_p", F.explode(F.array(*(F.struct(F.lit(n).alias("place"), r.alias("residue")) for n, r in places))))
    score = rows.select(pep, before, after, "_p.*").join(table, ["place", "residue"], "left").groupBy(pep, before, after).agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("context"))
    return df.join(score, [pep, before, after], "left")


def best_span(df: DataFrame, protein: str, core_at: str, core_len: int, lengths: dict[int, float], table: DataFrame) -> DataFrame:
    """df with start, end, score: of all spans of the given lengths (with log priors) around a core the one of the best context and length, the first of equals."""
    prior = F.create_map(*(F.lit(x) for kv in lengths.items() for x in kv))
    spans = df.withColumn("_len", F.explode(F.array(*map(F.lit, lengths)))).withColumn("_left", F.explode(F.sequence(F.lit(0), F.col("_len") - core_len)))
    spans = spans.withColumn("start", F.col(core_at) - F.col("_left")).withColumn("end", F.col("start") + F.col("_len")).where((F.col("start") >= 0) & (F.col("end") <= F.length(protein)))
    spans = spans.withColumn("_pep", F.substring(F.col(protein), F.col("start") + 1, F.col("_len"))).withColumn("_before", F.substring(F.col(protein), F.greatest(F.lit(1), F.col("start") - 2), F.least(F.lit(3), F.col("start")))).withColumn("_after", F.substring(F.col(protein), F.col("end") + 1, F.lit(3)))
    scored = context_score(spans, table, "_pep", "_before", "_after").withColumn("score", F.col("context") + F.element_at(prior, F.col("_len")))
    return scored.groupBy(*df.columns).agg(F.min(F.struct((-F.round("score", 9)).alias("s"), "start", "end")).alias("_b")).select(*df.columns, F.col("_b.start").alias("start"), F.col("_b.end").alias("end"), (-F.col("_b.s")).alias("score"))


def observed_spans(cores: DataFrame, ligands: DataFrame, seed: int = 9) -> DataFrame:
    """core, protein, start, end, support: ligands that contain a core and stand around it in its protein.

    Ligands are cut into windows of the core's length, so containment is an equi-join.
    """
    cut = ligands.select("ligand").where(F.length("ligand") >= seed).select("ligand", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("ligand") - (seed - 1)), lambda i: F.substring(F.col("ligand"), i, F.lit(seed)))).alias("_at", "core"))
    found = cores.join(cut, "core").withColumn("start", F.col("core_at") - F.col("_at")).withColumn("end", F.col("start") + F.length("ligand"))
    there = (F.col("start") >= 0) & (F.substring(F.col("protein"), F.col("start") + 1, F.length("ligand")) == F.col("ligand"))
    return found.where(there).groupBy("core", "protein", "start", "end").agg(F.count("*").alias("support"))
