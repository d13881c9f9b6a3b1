"""Grouped counts, shrinkage between groups, information and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def anchor_preferences(panel: DataFrame, anchors: list[int], *, by_length: bool = False, pep: str = "epitope", group: str = "allele", weight: str | None = None) -> DataFrame:
    """anchor, [length,] group, residue, cnt: summed weights of residues at signed anchor places."""
    place = F.when(F.col("anchor") > 0, F.col("anchor")).otherwise(F.length(pep) + F.col("anchor") + 1)
    rows = panel.withColumn("anchor", F.explode(F.array(*map(F.lit, anchors)))).where((place >= 1) & (place <= F.length(pep)))
    keys = ["anchor", *(["length"] if by_length else []), group, "residue"]
    rows = rows.withColumn("length", F.length(pep)).withColumn("residue", F.substring(F.col(pep), place, F.lit(1)))
    return rows.groupBy(*keys).agg(F.sum(F.col(weight) if weight else F.lit(1.0)).alias("cnt"))


def length_preferences(panel: DataFrame, *, pep: str = "epitope", group: str = "allele") -> DataFrame:
    return panel.groupBy(group, F.length(pep).alias("length")).agg(F.count("*").alias("cnt"))


def group_shares(df: DataFrame, group: str) -> DataFrame:
    """group, n, share of all rows."""
    counted = df.groupBy(group).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return counted.join(F.broadcast(total)).withColumn("share", F.col("n") / F.col("total")).drop("total")  # one row


def corpus_stats(df: DataFrame, seq: str) -> tuple[DataFrame, DataFrame]:
    """residue, n and length, n."""
    residues = df.select(F.explode(F.split(seq, "")).alias("residue")).where("residue <> ''").groupBy("residue").agg(F.count("*").alias("n"))
    return residues, df.groupBy(F.length(seq).alias("length")).agg(F.count("*").alias("n"))


def shrink(prefs: DataFrame, kernel: DataFrame, tau: float, *, group: str = "allele", keys: tuple[str, ...] = ("anchor",), value: str = "residue") -> DataFrame:
    """keys, group, value, p = (n pi + tau m) / (n + tau): a group's shares pi drawn towards the kernel-weighted shares m of its likes.

    kernel: group, other, k. Rows are shares of a group that has the key; values that only its likes have are included.
    """
    w = Window.partitionBy(*keys, group)
    own = prefs.withColumn("n", F.sum("cnt").over(w)).withColumn("pi", F.col("cnt") / F.col("n"))
    spread = kernel.join(own.select(*keys, F.col(group).alias("other"), value, "cnt"), "other").groupBy(*keys, group, value).agg(F.sum(F.col("k") * F.col("cnt")).alias("m"))
    spread = spread.withColumn("m", F.col("m") / F.sum("m").over(w))
    sizes = own.select(*keys, group, "n").distinct()
    full = spread.join(sizes, [*keys, group]).join(own.select(*keys, group, value, "pi"), [*keys, group, value], "left")
    return full.select(*keys, group, value, ((F.col("n") * F.coalesce("pi", F.lit(0.0)) + tau * F.col("m")) / (F.col("n") + tau)).alias("p"))


def mutual_information(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: mi in bits."""
    joint = df.groupBy(x, y).agg(F.count("*").alias("n"))
    nx, ny = joint.groupBy(x).agg(F.sum("n").alias("nx")), joint.groupBy(y).agg(F.sum("n").alias("ny"))
    total = joint.agg(F.sum("n").alias("total"))
    each = joint.join(nx, x).join(ny, y).join(F.broadcast(total))  # one row
    return each.agg(F.sum(F.col("n") / F.col("total") * F.log2(F.col("n") * F.col("total") / (F.col("nx") * F.col("ny")))).alias("mi"))


def anchor_weights(grooves: DataFrame, residues: DataFrame, length: int, *, prune: bool = False, tolerance: float = 0.0) -> DataFrame:
    """pos, mi, w: how much each place of the grooves tells of an anchor's residue, in bits, and as weights of mean 1 over all places (1 where nothing tells anything).

    grooves: allele, seq, of which those of the given length count; residues: allele, residue. With prune, a place weighs 0 if
    another that tells more of the anchor explains it: its own information is no more than what the two places share, less the
    tolerance. Information of all pairs of places is one aggregate, whose size is that of the alphabet, and pruning a join of edges.
    """
    rows = grooves.where(F.length("seq") == length).select("allele", "seq").distinct().join(residues.select("allele", F.col("residue").alias("y")), "allele")
    each = rows.select("allele", "y", F.posexplode(F.split("seq", "")).alias("pos", "x"))
    n = rows.agg(F.count("*").alias("total"))

    def information(joint: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
        of = lambda c: F.sum("n").over(Window.partitionBy(*keys, c))
        part = F.col("n") / F.col("total") * F.log2(F.col("n") * F.col("total") / (F.col("_a") * F.col("_b")))
        return joint.withColumn("_a", of(a)).withColumn("_b", of(b)).join(F.broadcast(n)).groupBy(*keys).agg(F.greatest(F.round(F.sum(part), 12), F.lit(0.0)).alias("mi"))  # one row

    told = F.broadcast(rows.sparkSession.range(length).select(F.col("id").cast("int").alias("pos"))).join(information(each.groupBy("pos", "x", "y").agg(F.count("*").alias("n")), ["pos"], "x", "y"), "pos", "left").select("pos", F.coalesce("mi", F.lit(0.0)).alias("mi"))
    kept = told.withColumn("w", F.col("mi"))
    if prune:
        other = each.select("allele", F.col("pos").alias("q"), F.col("x").alias("z"))
        joint = each.join(other, "allele").where("pos <> q").groupBy("pos", "q", "x", "z").agg(F.count("*").alias("n"))
        shared = information(joint, ["pos", "q"], "x", "z").withColumnRenamed("mi", "shared")
        better = shared.join(told, "pos").join(told.select(F.col("pos").alias("q"), F.col("mi").alias("more")), "q").where((F.col("mi") > 0) & (F.col("more") > F.col("mi")) & (F.col("mi") <= F.col("shared") - tolerance))
        kept = told.join(better.select("pos", F.lit(0.0).alias("none")).distinct(), "pos", "left").select("pos", "mi", F.coalesce("none", "mi").alias("w"))
    mean = F.sum("w").over(Window.partitionBy(F.lit(0))) / length  # a row for each place of a groove
    return kept.select("pos", "mi", F.when(mean > 0, F.col("w") / mean).otherwise(1.0).alias("w"))


def motif(df: DataFrame, pep: str, length: int, *, group: str) -> DataFrame:
    """group, pos, residue, freq, bits: position weights of strings of one length, bits = log2 20 - entropy of the place."""
    rows = df.where(F.length(pep) == length).select(group, F.posexplode(F.split(pep, "")).alias("pos", "residue"))
    counted = rows.groupBy(group, "pos", "residue").agg(F.count("*").alias("n"))
    w = Window.partitionBy(group, "pos")
    shares = counted.withColumn("freq", F.col("n") / F.sum("n").over(w))
    return shares.withColumn("bits", F.log2(F.lit(20.0)) + F.sum(F.col("freq") * F.log2("freq")).over(w)).drop("n")


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X >= k) of a binomial, by the exact sum of its terms from k to n; 1 at k <= 0."""
    start = F.greatest(k, F.lit(1)).cast("int")
    # the first term by sums of logs, each next one from the one before
    lead = F.aggregate(F.sequence(F.lit(1), start), F.lit(0.0), lambda a, i: a + F.ln((n - start + i) / i)) + start * F.ln(p) + (n - start) * F.ln(1 - p)
    terms = F.aggregate(
        F.sequence(start, F.greatest(start, n.cast("int"))),
        F.struct(F.exp(lead).alias("term"), F.lit(0.0).alias("sum")),
        lambda a, i: F.struct((a["term"] * (n - i) / (i + 1) * p / (1 - p)).alias("term"), (a["sum"] + a["term"]).alias("sum")),
        lambda a: a["sum"],
    )
    return F.when(k <= 0, 1.0).when(k > n, 0.0).when(p >= 1, 1.0).when(p <= 0, 0.0).otherwise(F.least(F.lit(1.0), terms))


def enrichment(votes: DataFrame, shares: DataFrame, *, group: str = "allele", floor: float = 1e-300) -> DataFrame:
    """votes (query, group, votes, n) with vote share and -log10 of the binomial tail against the group's share of the panel."""
    each = votes.join(shares.select(group, "share"), group)
    return each.withColumn("vote", F.col("votes") / F.col("n")).withColumn("enrichment", -F.log10(F.greatest(binomial_tail(F.col("votes"), F.col("n"), F.col("share")), F.lit(floor)))).drop("share")


def coverage(labels: DataFrame, universe: DataFrame, label: str) -> DataFrame:
    """One row: n_labels, n_covered, gini, entropy ratio of the counts of all labels of the universe, zeros included."""
    counted = universe.select(label).distinct().join(labels.groupBy(label).agg(F.count("*").alias("n")), label, "left").select(label, F.coalesce("n", F.lit(0)).alias("n"))
    # labels of one count have consecutive ranks; distinct counts are no more than the root of twice the rows
    alike = counted.groupBy("n").agg(F.count("*").alias("c")).withColumn("b", F.coalesce(F.sum("c").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranks = F.col("c") * F.col("b") + (F.col("c") * (F.col("c") + 1) / 2)
    sums = alike.agg(F.sum("c").alias("m"), F.sum(F.col("n") * F.col("c")).alias("total"), F.sum(ranks * F.col("n")).alias("weighted"), F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("c"))), F.lit(0)).alias("covered"), F.sum(F.when(F.col("n") > 0, F.col("c") * F.col("n") * F.ln("n")).otherwise(0.0)).alias("nlogn"))
    m, t = F.col("m"), F.col("total")
    entropy = F.ln(t) - F.col("nlogn") / t
    return sums.select(m.alias("n_labels"), F.col("covered").alias("n_covered"), F.when((m > 1) & (t > 0), 2 * F.col("weighted") / (m * F.nullif(t, F.lit(0))) - (m + 1) / m).otherwise(0.0).alias("gini"), F.when((m > 1) & (t > 0), entropy / F.ln(m)).otherwise(1.0).alias("entropy_ratio"))


def dispersion(df: DataFrame, m: str, k: str) -> DataFrame:
    """One row: pooled p, sample variance of k / m, mean binomial variance, their ratio."""
    r = F.col(k) / F.col(m)
    pooled = df.agg((F.sum(k) / F.sum(m)).alias("p"), F.var_samp(r).alias("variance"), F.avg(1 / F.col(m)).alias("inverse"))
    expected = F.col("p") * (1 - F.col("p")) * F.col("inverse")
    return pooled.select("p", "variance", expected.alias("binomial_variance"), (F.col("variance") / F.nullif(expected, F.lit(0.0))).alias("ratio"))
