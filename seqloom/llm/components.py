"""Connected components of an edge table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import Scratch

MAX_ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """v, label: the least vertex that each vertex of an edge can reach. Every round is written to the shared folder.

    A round gives each vertex the least label around it, then the label of its label, so that distances halve. No edges
    give an empty result; loops and repeated edges change nothing. A vertex of many edges is one side of a join whose
    other side is unique, and its least label is pre-aggregated.
    """
    # written before both directions are read from it: computed twice, edges that may differ from run to run would go one way only
    fixed, rounds = Scratch(edges.sparkSession), Scratch(edges.sparkSession)
    one = fixed.stored(edges.select(F.col(a).alias("v"), F.col(b).alias("u")).distinct(), "edges")
    both = one.unionByName(one.select(F.col("u").alias("v"), F.col("v").alias("u")))
    labels = rounds.stored(both.groupBy("v").agg(F.min("u").alias("u")).select("v", F.least("v", "u").alias("label")), "labels")
    for _ in range(MAX_ROUNDS):
        around = both.join(labels.select(F.col("v").alias("u"), "label"), "u").groupBy("v").agg(F.min("label").alias("around"))
        near = labels.join(around, "v").select("v", F.col("label").alias("old"), F.least("label", "around").alias("label"))
        near = rounds.stored(near, "labels")
        jump = near.select(F.col("v").alias("label"), F.col("label").alias("to"))
        after = rounds.stored(near.join(jump, "label").select("v", F.least("label", "to").alias("label"), "old"), "labels")
        rounds.drop(keep=1)
        labels = after.select("v", "label")
        if after.where(F.col("label") != F.col("old")).limit(1).count() == 0:
            fixed.drop()
            return labels
    raise RuntimeError(f"labels still change after {MAX_ROUNDS} rounds")
