"""Quality rules: an ordered decision list, learned by sequential covering from labelled text statistics.

The list is grown on two thirds of a bounded sample of labelled rows that pass the base rule, and pruned on the rest: each rule is a conjunction
of thresholds on interpretable statistics that covers rejected documents, and becomes one branch of an ordered
conditional expression (`CASE WHEN … THEN … END`). Documents that no rule covers are kept.

Cases: a null or empty text has no words and fails the base rule; repeated rows get the same verdict each; an empty
documents table gives an empty result; without labels, or labels of one value only, the list is empty and the base
rules alone decide; null labels are ignored; extra columns of the input are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import documents, labels, unused
from seqloom.llm.text_stats import COUNTS, RATIOS, text_statistics

#: Labelled rows that a fit uses at most: those whose hashed ids come first.
SAMPLE_ROWS = 12_000
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
FEATURES = ("n_words", *RATIOS)


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold

    def column(self, stats: Column) -> Column:
        value = stats[self.feature]
        return value >= F.lit(self.threshold) if self.above else value < F.lit(self.threshold)


@dataclass(frozen=True)
class Rule:
    """A conjunction of tests that rejects; precision and cover are those on the pruning rows."""

    tests: tuple[Test, ...]
    precision: float
    cover: int

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([t.holds(x) for t in self.tests])

    def __str__(self) -> str:
        return " AND ".join(f"{t.feature} {'>=' if t.above else '<'} {t.threshold:.6g}" for t in self.tests)


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, left: np.ndarray, cuts: int, depth: int) -> list[Test]:
    """Adds the test of the highest information gain (FOIL's) until no good row is covered."""
    tests: list[Test] = []
    inside = left.copy()
    while len(tests) < depth and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        best, gain = None, 1e-9
        before = np.log2(p0 / (p0 + n0))
        for f in x:
            v = x[f][inside]
            b = bad[inside]
            at = np.unique(np.quantile(v, np.linspace(0, 1, cuts)))
            at = (at[1:] + at[:-1]) / 2
            if not len(at):
                continue
            order = np.argsort(v, kind="stable")
            below = np.searchsorted(v[order], at, "left")
            cum = np.concatenate([[0], np.cumsum(b[order])])
            p_low, all_low = cum[below], below
            for above, p, total in ((False, p_low, all_low), (True, p0 - p_low, len(v) - all_low)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where((p > 0) & (total > 0), p * (np.log2(p / total) - before), -1)
                i = int(np.argmax(g))
                if g[i] > gain:
                    best, gain = Test(f, above, float(at[i])), g[i]
        if best is None:
            break
        tests.append(best)
        inside &= best.holds(x)
    return tests


def learn(x: dict[str, np.ndarray], bad: np.ndarray, *, min_precision: float = 0.97, min_cover: int = 4, max_rules: int = 24, cuts: int = 96, depth: int = 4) -> list[Rule]:
    """Sequential covering: grow a rule, cut its tail where that raises (p - n) / (p + n) on the pruning rows, keep it, remove what it covers."""
    n = len(bad)
    prune = np.zeros(n, bool)
    for rows in (np.flatnonzero(bad), np.flatnonzero(~bad)):  # a third of each label, however few there are
        prune[rows[2::3]] = True
    left = np.ones(n, bool)
    rules: list[Rule] = []
    while len(rules) < max_rules and (left & bad & ~prune).sum() >= min_cover:
        tests = _grow(x, bad, left & ~prune, cuts, depth)
        best = None
        for k in range(1, len(tests) + 1):
            hit = Rule(tuple(tests[:k]), 0, 0).holds(x) & left
            p, q = int((hit & prune & bad).sum()), int((hit & prune & ~bad).sum())
            p_all, q_all = int((hit & bad).sum()), int((hit & ~bad).sum())
            worth = (p - q) / (p + q) if p + q else -1.0
            # a rule has to hold on the pruning rows, and nearly without exception over all rows
            if p and p_all >= min_cover and p_all >= min_precision * (p_all + q_all) and p >= min_precision * (p + q) and (best is None or worth > best[0] + 1e-12):
                best = (worth, Rule(tuple(tests[:k]), p / (p + q), p_all))
        if best is None:
            # nothing that generalises starts here: set the rows of this rule aside and try the rest
            hit = Rule(tuple(tests), 0, 0).holds(x) & left & ~prune if tests else left & ~prune
            if not (hit & bad).any():
                break
            left &= ~hit
            continue
        rules.append(best[1])
        left &= ~best[1].holds(x)
    return rules


def fit(docs: DataFrame, marked: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Learns from at most sample_rows labelled rows (label 0: reject) that pass the base rule, as the list only decides on those; only their statistics reach the driver."""
    sample = (
        marked.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id", "_label")
        .limit(sample_rows)
    )
    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id")  # at most sample_rows rows
    seen = joined.select("_id", "_label", text_statistics("_text").alias("s")).where(~base_failed(F.col("s")))
    # one row of each sampled id and label, so that repeated rows do not reach the driver
    one = seen.groupBy("_id", "_label").agg(F.min(F.struct(*(F.col("s")[f].alias(f) for f in FEATURES))).alias("s"))
    rows = one.select("_id", "_label", *(F.col("s")[f].alias(f) for f in FEATURES)).toPandas().sort_values(["_id", "_label"], kind="stable")
    rows = rows.sample(frac=1, random_state=7) if len(rows) else rows
    return learn({f: rows[f].to_numpy(float) for f in FEATURES}, rows["_label"].to_numpy() == 0)


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"])


def fired(rules: list[Rule], stats: Column) -> Column:
    """The ordered conditional expression: number of the first rule that holds, from 1; 0 if none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        holds = rule.tests[0].column(stats)
        for t in rule.tests[1:]:
            holds = holds & t.column(stats)
        out = F.when(holds, F.lit(k)) if out is None else out.when(holds, F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def judge(docs: DataFrame, rules: list[Rule], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, counts, base_failed, rule (0: none), kept."""
    s = F.col("_s")
    seen = docs.select(F.col(id_col), text_statistics(F.col(text_col)).alias("_s"))
    return seen.select(F.col(id_col), *(s[c].alias(c) for c in COUNTS), base_failed(s).alias("base_failed"), fired(rules, s).alias("rule"), (~base_failed(s) & (fired(rules, s) == 0)).alias("kept"))


def keep(docs: DataFrame, rules: list[Rule], *, text_col: str = "text") -> DataFrame:
    """The documents that neither the base rules nor the list reject, with all their columns."""
    name = unused(docs, "_stats")
    s = F.col(name)
    return docs.withColumn(name, text_statistics(F.col(text_col))).where(~base_failed(s) & (fired(rules, s) == 0)).drop(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return judge(docs, fit(docs, labels(spark, sf_dir)))


QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLE_SQL: dict[str, str] = {}
