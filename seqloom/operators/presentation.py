"""Position profiles of groups, their scores, registers and mixtures by expectation maximisation."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.sequences import RESIDUES


def _kept(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"{spark.conf.get('spark.sql.warehouse.dir')}/_rounds"
    path = f"{base.rstrip('/')}/profiles-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def background(df: DataFrame, pep: str) -> DataFrame:
    """residue, bg: shares over all places, each of the twenty with a pseudocount of 1."""
    seen = df.select(F.explode(F.split(pep, "")).alias("residue")).groupBy("residue").agg(F.count("*").alias("n"))
    all_ = df.sparkSession.createDataFrame([(r,) for r in RESIDUES], "residue string").join(seen, "residue", "left").select("residue", (F.coalesce("n", F.lit(0)) + 1).alias("n"))
    return all_.join(F.broadcast(all_.agg(F.sum("n").alias("t")))).select("residue", (F.col("n") / F.col("t")).alias("bg"))  # one row


def profiles(counts: DataFrame, bg: DataFrame, keys: list[str], pseudo: float) -> DataFrame:
    """keys, residue, logodds = ln((cnt + pseudo bg) / (n + pseudo) / bg) for all twenty residues; counts: keys, residue, cnt."""
    sizes = counts.groupBy(*keys).agg(F.sum("cnt").alias("n"))
    full = sizes.join(F.broadcast(bg)).join(counts, [*keys, "residue"], "left")  # twenty rows
    return full.select(*keys, "residue", F.ln((F.coalesce("cnt", F.lit(0.0)) + pseudo * F.col("bg")) / (F.col("n") + pseudo) / F.col("bg")).alias("logodds"))


def place_counts(df: DataFrame, pep: str, group: str, start: Column, width: int, weight: Column | None = None) -> DataFrame:
    """pos, group, residue, cnt over `width` places from a zero-based start."""
    each = df.select(group, F.col(pep), start.alias("_s"), (weight if weight is not None else F.lit(1.0)).alias("_w"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("pos"))
    return each.groupBy("pos", group, F.substring(F.col(pep), F.col("_s") + F.col("pos") + 1, F.lit(1)).alias("residue")).agg(F.sum("_w").alias("cnt"))


def frame_scores(df: DataFrame, table: DataFrame, pep: str, group: str, width: int) -> DataFrame:
    """pep, group, start, score: summed log odds of every frame; rows shorter than a frame have none."""
    d = df.select(pep, group).distinct().where(F.length(pep) >= width)
    frames = d.withColumn("start", F.explode(F.sequence(F.lit(0), F.length(pep) - width)))
    each = frames.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).withColumn("residue", F.substring(F.col(pep), F.col("start") + F.col("pos") + 1, F.lit(1)))
    return each.join(table, ["pos", group, "residue"]).groupBy(pep, group, "start").agg(F.sum("logodds").alias("score"))


def best_frames(scores: DataFrame, pep: str, group: str) -> DataFrame:
    """pep, group, start, score: the best frame, the leftmost of equals (scores are compared at nine decimals)."""
    best = F.min(F.struct((-F.round("score", 9)).alias("s"), "start")).alias("_b")
    return scores.groupBy(pep, group).agg(best).select(pep, group, F.col("_b.start").alias("start"), (-F.col("_b.s")).alias("score"))


def register_em(panel: DataFrame, pep: str, group: str, start: Column, *, width: int = 9, pseudo: float = 5.0, rounds: int = 8) -> tuple[DataFrame, DataFrame]:
    """(pep, group, start) and the profile they give: score frames, take the best, count again, until no start changes or the rounds are over."""
    bg = _kept(background(panel, pep))
    at = _kept(panel.select(pep, group, start.alias("start")).where(F.length(pep) >= width))
    table = None
    for _ in range(rounds):
        table = _kept(profiles(place_counts(at, pep, group, F.col("start"), width), bg, ["pos", group], pseudo))
        after = _kept(at.select(pep, group).distinct().join(best_frames(frame_scores(at, table, pep, group, width), pep, group), [pep, group]).select(pep, group, "start"))
        moved = after.join(at.withColumnRenamed("start", "_old"), [pep, group]).where("start <> _old").limit(1).count()
        at = after
        if not moved:
            break
    return at, table


def mixture_em(panel: DataFrame, pep: str, group: str, start: Column, *, parts: int = 3, width: int = 9, pseudo: float = 5.0, rounds: int = 3) -> DataFrame:
    """pep, group, part, share: responsibilities of `parts` profiles for every string, begun by crc32 of the string modulo parts."""
    bg = _kept(background(panel, pep))
    rows = _kept(panel.select(pep, group, start.alias("start")).where(F.length(pep) >= width).distinct())
    resp = _kept(rows.select(pep, group, "start", (F.crc32(pep) % parts).cast("int").alias("part"), F.lit(1.0).alias("share")))
    w = Window.partitionBy(pep, group)
    for _ in range(rounds):
        keyed = resp.withColumn("_g", F.struct(group, "part"))
        counts = place_counts(keyed, pep, "_g", F.col("start"), width, F.col("share")).select("pos", F.col(f"_g.{group}").alias(group), F.col("_g.part").alias("part"), "residue", "cnt")
        table = _kept(profiles(counts, bg, ["pos", group, "part"], pseudo))
        prior = resp.groupBy(group, "part").agg(F.sum("share").alias("_n")).withColumn("_prior", F.ln(F.col("_n") / F.sum("_n").over(Window.partitionBy(group))))
        each = rows.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).withColumn("residue", F.substring(F.col(pep), F.col("start") + F.col("pos") + 1, F.lit(1)))
        score = each.join(table, ["pos", group, "residue"]).groupBy(pep, group, "start", "part").agg(F.sum("logodds").alias("score")).join(prior.select(group, "part", "_prior"), [group, "part"])
        z = F.col("score") + F.col("_prior")
        soft = score.withColumn("_e", F.exp(z - F.max(z).over(w)))
        resp = _kept(soft.select(pep, group, "start", "part", (F.col("_e") / F.sum("_e").over(w)).alias("share")))
    return resp.select(pep, group, "part", "share")


def fit_tau(shares: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tau: prior strength by moments from (keys, residue, n, p): n of a group and its share p."""
    m = shares.groupBy(*keys, "residue").agg((F.sum(F.col("n") * F.col("p")) / F.sum("n")).alias("m"), F.var_samp("p").alias("v"), F.avg(1 / F.col("n")).alias("inv"))
    one = (F.col("m") * (1 - F.col("m")) - F.col("v")) / F.greatest(F.col("v") - F.col("m") * (1 - F.col("m")) * F.col("inv"), F.lit(1e-6))
    return m.where("v IS NOT NULL").groupBy(*keys).agg(F.greatest(F.lit(0.0), F.avg(one)).alias("tau"))


def offset_prior(starts: DataFrame, pep: str, group: str) -> DataFrame:
    """length, group, start, logprior: ln of the smoothed share of each start among strings of a length, 0.5 added to each possible one."""
    seen = starts.groupBy(F.length(pep).alias("length"), group, "start").agg(F.count("*").alias("n"))
    width = starts.agg(F.min(F.length(pep) - F.col("start")).alias("w"))
    all_ = seen.select("length", group).distinct().join(F.broadcast(width)).select("length", group, F.explode(F.sequence(F.lit(0), F.col("length") - F.col("w"))).alias("start"))
    full = all_.join(seen, ["length", group, "start"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + 0.5)
    return full.select("length", group, "start", F.ln(F.col("n") / F.sum("n").over(Window.partitionBy("length", group))).alias("logprior"))


def contracted_affinity(weights: DataFrame, pockets: DataFrame) -> DataFrame:
    """allele, pos, residue, energy: pair weights (pos, residue, contact, letter, w) summed over an allele's pocket letters (allele, contact, letter), once for all."""
    return weights.join(pockets, ["contact", "letter"]).groupBy("allele", "pos", "residue").agg(F.sum("w").alias("energy"))


def pair_scores(df: DataFrame, table: DataFrame, pep: str, allele: str = "allele") -> DataFrame:
    """pep, allele, energy: lookups of each place of a core in a contracted table."""
    each = df.select(pep, allele).distinct().select(pep, allele, F.posexplode(F.split(pep, "")).alias("pos", "residue"))
    return each.join(table, [allele, "pos", "residue"], "left").groupBy(pep, allele).agg(F.sum(F.coalesce("energy", F.lit(0.0))).alias("energy"))


def ridge(df: DataFrame, features: list[str], target: str, penalty: float) -> dict[str, float]:
    """Coefficients with an unpenalised intercept: the normal equations are one aggregate of (features + 1)^2 sums, solved on the driver."""
    import numpy as np

    x = [*(F.col(f).cast("double") for f in features), F.lit(1.0)]
    n = len(x)
    row = df.agg(*(F.sum(x[i] * x[j]).alias(f"a{i}_{j}") for i in range(n) for j in range(i, n)), *(F.sum(x[i] * F.col(target)).alias(f"b{i}") for i in range(n))).first()
    a = np.array([[row[f"a{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)], float)
    b = np.array([row[f"b{i}"] for i in range(n)], float)
    w = np.linalg.solve(a + penalty * np.diag([1.0] * (n - 1) + [0.0]), b)
    return dict(zip([*features, "intercept"], w.tolist(), strict=True))
