"""Exact k-mer densities of reference sets, kernels over codes, groups of sequences that share a window."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.sequences import RESIDUES, face_codes


def code_counts(df: DataFrame, pep: str, k: int, *, weight: str | None = None, face: Callable[[str, int], Column] = face_codes) -> DataFrame:
    """code, cnt: summed weights of the packed face k-mers of all rows; face: how a string's are cut, such as face_kmers of a class or mask."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.select(F.explode(face(pep, k)).alias("code"), w.alias("_w")).groupBy("code").agg(F.sum("_w").alias("cnt"))


def contract(counts: DataFrame, kernel: DataFrame, k: int) -> DataFrame:
    """code, cnt with the kernel (x, y, w over residue codes) applied along each of the k places: k joins of at most 20^k rows."""
    table = counts
    for i in range(k):
        unit = 20**i
        digit = F.pmod(F.floor(F.col("code") / unit), F.lit(20)).cast("int")
        spread = table.withColumn("x", digit).join(F.broadcast(kernel), "x")  # 400 rows
        table = spread.select((F.col("code") + (F.col("y") - F.col("x")) * unit).cast("bigint").alias("code"), (F.col("cnt") * F.col("w")).alias("cnt")).groupBy("code").agg(F.sum("cnt").alias("cnt"))
    return table


def density(queries: DataFrame, counts: DataFrame, pep: str, k: int, *, face: Callable[[str, int], Column] = face_codes) -> DataFrame:
    """pep, density: mean count of its face k-mers, cut as those of the counts, by the total; null for a string without any."""
    total = counts.agg(F.sum("cnt").alias("_n"))
    each = queries.select(pep).distinct().select(pep, F.explode_outer(face(pep, k)).alias("code"))
    found = each.join(counts, "code", "left").groupBy(pep).agg(F.sum(F.coalesce("cnt", F.lit(0.0))).alias("_s"), F.count("code").alias("_c"))
    return found.join(F.broadcast(total)).select(pep, F.when(F.col("_c") > 0, F.col("_s") / (F.col("_c") * F.col("_n"))).alias("density"))  # one row


def kernel_rows(spark, similarity: dict[tuple[str, str], float]) -> DataFrame:
    """x, y, w from a table of residue pairs."""
    return spark.createDataFrame([(RESIDUES.index(a), RESIDUES.index(b), float(w)) for (a, b), w in similarity.items()], "x int, y int, w double")


def log_odds(channels: list[Column], means: list[float], deviations: list[float], coefs: list[float]) -> Column:
    """Sum of coef times standardised channel; null when one of them is unmeasured."""
    total = F.lit(0.0)
    for c, m, s, k in zip(channels, means, deviations, coefs, strict=True):
        total = total + (c - m) / s * k
    return total


def connected(edges: DataFrame, nodes: DataFrame, *, rounds: int = 50) -> DataFrame:
    """id, component: the least id that each node reaches over edges (a, b); every round is written to the shared checkpoint folder, or the warehouse where none is set."""
    spark = edges.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"{spark.conf.get('spark.sql.warehouse.dir')}/_rounds"

    def kept(df: DataFrame) -> DataFrame:
        path = f"{base.rstrip('/')}/components-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    both = kept(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = kept(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("component")))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("_n"))
        step = labels.join(near, "id").select("id", F.col("component").alias("_old"), F.least("component", "_n").alias("component"))
        after = kept(step)
        hop = after.select(F.col("id").alias("component"), F.col("component").alias("_to"))
        after = kept(after.join(hop, "component").select("id", F.least("component", "_to").alias("component"), "_old"))
        if after.where("component <> _old").limit(1).count() == 0:
            return nodes.select("id").distinct().join(after.select("id", "component"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        labels = after.select("id", "component")
    raise RuntimeError("components have not settled")


def shared_window_edges(df: DataFrame, id_col: str, windows: str) -> DataFrame:
    """a, b: each row of (id, array of windows) tied to the least id of every window it has, which connects all that share one."""
    each = df.select(F.col(id_col).alias("b"), F.explode(F.array_distinct(windows)).alias("w"))
    return each.join(each.groupBy("w").agg(F.min("b").alias("a")), "w").where("a < b").select("a", "b").distinct()


def locus_weights(df: DataFrame, pep: str, w: int = 7) -> DataFrame:
    """pep, weight: 1 over the number of distinct strings connected by shared windows of w letters."""
    d = df.select(pep).distinct()
    cut = d.withColumn("_w", F.when(F.length(pep) >= w, F.transform(F.sequence(F.lit(1), F.length(pep) - (w - 1)), lambda i: F.substring(F.col(pep), i, F.lit(w)))).otherwise(F.array().cast("array<string>")))
    groups = connected(shared_window_edges(cut, pep, "_w"), d.select(F.col(pep).alias("id")))
    return groups.join(groups.groupBy("component").agg((1.0 / F.count("*")).alias("weight")), "component").select(F.col("id").alias(pep), "weight")
