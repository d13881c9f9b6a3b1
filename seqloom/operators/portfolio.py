"""Choosing diverse sets: Pareto fronts, crowding, scalar scores, stop rules, joint survival, greedy composition."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.operators import ordered
from seqloom.operators.rounds import Rounds

#: Cells of three and more objectives at most; rows of a cell that a task holds at a time, on average.
CELLS, UNIT = 4096, 4096


def pareto_front(df: DataFrame, objectives: Sequence[str]) -> DataFrame:
    """Rows that no other row equals or exceeds in all objectives and exceeds in one; higher is better.

    Two objectives take the running maximum over ranges of distinct values of the first. More go by cells of quantiles; these
    are compared as doubles, a NaN as infinity. A row with a null objective is on no front.
    """
    if len(objectives) == 2:
        a, b = objectives
        best = df.groupBy(a).agg(F.max(b).alias("_b"))
        front = ordered.before(best, a, {"_above": ("max", "_b")}, falling=True).where(F.col("_above").isNull() | (F.col("_b") > F.col("_above")))
        return df.join(front.select(a, F.col("_b").alias(b)), [a, b], "left_semi")

    free = "_" * (1 + max(len(c) - len(c.lstrip("_")) for c in df.columns))
    names = [f"{free}objective{k}" for k in range(len(objectives))]
    each = [F.nanvl(F.col(o).cast("double"), F.lit(float("inf"))) for o in objectives]
    front = _front_by_cells(df.select(*(c.alias(n) for c, n in zip(each, names, strict=True))).dropna(), names)
    return df.join(front, [c == F.col(n) for c, n in zip(each, names, strict=True)], "left_semi")


def _front_by_cells(values: DataFrame, names: list[str], cells: int = CELLS, unit: int = UNIT) -> DataFrame:
    """Distinct rows of the front.

    Quantiles of each objective cut the space into at most `cells` cells. Where another cell with rows lies above in every
    objective, all of a cell is dominated and goes before anything is shuffled. The local fronts of the rest are held, each
    cell in units of about `unit` rows, against those of the cells that are no lower in any objective, which stream past.
    """
    spark, kinds = values.sparkSession, ", ".join(f"{n} double" for n in names)
    base = max(1, round(cells ** (1 / len(names))))
    bounds = values.approxQuantile(names, [i / base for i in range(1, base)], 0.01) if base > 1 else []
    level = lambda n, at: sum(((F.col(n) > b).cast("bigint") for b in sorted(set(at))), F.lit(0).cast("bigint"))
    cell = sum((level(n, at) * base**k for k, (n, at) in enumerate(zip(names, bounds, strict=False))), F.lit(0).cast("bigint"))
    placed = values.withColumn("cell", cell)
    codes = np.array([r.cell for r in placed.select("cell").distinct().collect()], np.int64)  # one row for each cell
    places = codes[:, None] // base ** np.arange(len(names)) % base
    keep = [k for k in range(len(codes)) if not (places > places[k]).all(1).any()]
    codes, places = codes[keep], places[keep]
    left = placed.join(F.broadcast(_longs(spark, ["cell"], [(c,) for c in codes])), "cell").select("cell", *names)

    def local(batches):
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf])
            z = held[names].to_numpy(float)
            held = held[~_dominated(z, z)]
        if held is not None:
            yield held

    fronts = Rounds(spark, "fronts").kept(left.mapInPandas(local, f"cell bigint, {kinds}").distinct())
    sizes = {r.cell: -(-r.n // unit) for r in fronts.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row for each cell
    parts = _longs(spark, ["cell", "parts"], list(sizes.items()))
    meets = [(int(codes[j]), int(c), sizes[int(c)]) for c, at in zip(codes, places, strict=True) if int(c) in sizes for j in np.flatnonzero((places >= at).all(1))]
    meets = _longs(spark, ["cell", "to", "parts"], meets)
    own = fronts.join(F.broadcast(parts), "cell").select(F.col("cell").alias("to"), F.pmod(F.xxhash64(*names), "parts").alias("part"), F.lit(0).alias("side"), *names)
    others = fronts.join(F.broadcast(meets), "cell").select("to", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), F.lit(1).alias("side"), *names)

    def run(batches):
        key, held = None, np.zeros((0, len(names)))
        for pdf in batches:
            for k, rows in pdf.groupby(["to", "part"], sort=False):
                if k != key:
                    yield pd.DataFrame(held, columns=names)
                    key, held = k, np.zeros((0, len(names)))
                z, side = rows[names].to_numpy(float), rows["side"].to_numpy()
                held = np.concatenate([held, z[side == 0]])
                held = held[~_dominated(held, z[side == 1])]
        yield pd.DataFrame(held, columns=names)

    return own.unionByName(others).repartition("to", "part").sortWithinPartitions("to", "part", "side").mapInPandas(run, kinds)


def _longs(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A small table of whole numbers, held in the plan."""
    return spark.createDataFrame(pa.table({n: pa.array([int(r[k]) for r in rows], pa.int64()) for k, n in enumerate(names)}))


def _dominated(z: np.ndarray, by: np.ndarray) -> np.ndarray:
    out = np.zeros(len(z), bool)
    for start in range(0, len(z), 256):
        block = z[start : start + 256, None, :]
        out[start : start + 256] = ((by[None] >= block).all(2) & (by[None] > block).any(2)).any(1)
    return out


def nondominated_rank(df: DataFrame, objectives: Sequence[str], fronts: int = 3) -> DataFrame:
    """df with front: 1 for the Pareto front, 2 for that of the rest, …; null beyond the last asked for."""
    rest, out = df, None
    for k in range(1, fronts + 1):
        front = pareto_front(rest, objectives).withColumn("front", F.lit(k))
        out = front if out is None else out.unionByName(front)
        rest = rest.join(front.select(*objectives).distinct(), list(objectives), "left_anti")
    return out.unionByName(rest.withColumn("front", F.lit(None).cast("int")))


def crowding(df: DataFrame, objectives: Sequence[str], row: str, keys: Sequence[str] = ()) -> DataFrame:
    """df with crowding: over the objectives, the gap between a row's neighbours by the span; infinite at either end."""
    total = F.lit(0.0)
    out = ordered.attach(df, df.groupBy(*keys).agg(*((F.max(o) - F.min(o)).alias(f"_span_{o}") for o in objectives)), keys)
    for o in objectives:
        before, after, span = F.col("_before"), F.col("_after"), F.col(f"_span_{o}")
        gap = F.when(before.isNull() | after.isNull(), float("inf")).when(span == 0, 0.0).otherwise((after - before) / span)
        out = ordered.neighbouring(out, o, keys, [row], df).withColumn(f"_gap_{o}", gap).drop("_before", "_after")
        total = total + F.col(f"_gap_{o}")
    return out.select(*df.columns, total.alias("crowding"))


def corner(df: DataFrame, objectives: Sequence[str], row: str, keys: Sequence[str] = ()) -> DataFrame:
    """df with corner: the objective in which a row ranks highest among its like, the first of equals."""
    out = ordered.attach(df.withColumn("_one", F.lit(1)), df.groupBy(*keys).agg(F.count("*").alias("_n")), keys)
    for o in objectives:
        out = ordered.before(out, o, {f"_r_{o}": ("sum", "_one")}, keys, ties=[row], of=df)
    ranks = [F.col(f"_r_{o}") / F.greatest(F.col("_n") - 1, F.lit(1)) for o in objectives]
    most = F.greatest(*ranks) if len(ranks) > 1 else ranks[0]
    return out.select(*df.columns, F.coalesce(*(F.when(r == most, F.lit(o)) for o, r in zip(objectives, ranks, strict=True))).alias("corner"))


def chebyshev(df: DataFrame, weights: dict[str, float], augment: float = 0.05) -> DataFrame:
    """df with chebyshev: augmented weighted distance from the ideal, the best value of each objective; lower is better."""
    ideal = df.agg(*(F.max(o).alias(f"_i_{o}") for o in weights))
    out = df.join(F.broadcast(ideal))  # one row
    gaps = [(F.col(f"_i_{o}") - F.col(o)) * w for o, w in weights.items()]
    most = F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
    return out.withColumn("chebyshev", most + augment * sum(gaps[1:], gaps[0])).drop(*(f"_i_{o}" for o in weights))


def select_saturating(df: DataFrame, p: str, block: str, row: str, n0: float) -> DataFrame:
    """Rows kept by the saturating stop rule: of each block in falling p, while p > (sum of p before) / (n0 + number before).

    Sums run by ranges of p; the first row of a block that fails ends it.
    """
    rows = df.where(F.col(p).isNotNull())
    summed = ordered.before(rows.withColumn("_one", F.lit(1)), p, {"_s": ("sum", p), "_n": ("sum", "_one")}, [block], ties=[row], falling=True)
    at = F.struct((-F.col(p)).alias("p"), F.col(row).alias("row"))
    ends = summed.where(F.col(p) <= F.col("_s") / (n0 + F.col("_n"))).groupBy(F.col(block).alias("_block")).agg(F.min(at).alias("_end"))
    return rows.join(ends, F.col(block).eqNullSafe(F.col("_block")), "left").where(F.col("_end").isNull() | (at < F.col("_end"))).select(*df.columns)


def expected_yield(kept: DataFrame, p: str, block: str, n0: float) -> DataFrame:
    """block, n, expected: n0 * sum of p / (n0 + n) for the rows kept."""
    return kept.groupBy(block).agg(F.count("*").alias("n"), (n0 * F.sum(p) / (n0 + F.count("*"))).alias("expected"))


def at_least_one(df: DataFrame, p: str, block: str, q: float, keys: Sequence[str] = ()) -> DataFrame:
    """keys, p_ge1 = 1 - prod over blocks of (1 - q + q prod(1 - p / q)): a block works with probability q. A p above q is an error."""
    fine = F.when(F.col(p) > q, F.raise_error(F.lit(f"a probability exceeds that of its block, {q}"))).otherwise(F.col(p))
    blocks = df.groupBy(*keys, block).agg(F.product(1 - fine / q).alias("_none"))
    return blocks.groupBy(*keys).agg((1 - F.product(1 - q + q * F.col("_none"))).alias("p_ge1"))


#: Parts that a block's probabilities are dealt out to, and the length from which polynomials are multiplied by FFT.
PARTS, FFT_FROM = 64, 128


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if min(len(a), len(b)) < FFT_FROM:
        return np.convolve(a, b)
    n = len(a) + len(b) - 1
    size = 1 << (n - 1).bit_length()
    return np.maximum(np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(b, size), size)[:n], 0.0)


def _product(polynomials: list[np.ndarray]) -> np.ndarray:
    """Pairwise, short ones first, so that factors are of like length."""
    left = sorted(polynomials, key=len)
    while len(left) > 1:
        left = [_times(left[i], left[i + 1]) if i + 1 < len(left) else left[i] for i in range(0, len(left), 2)]
    return left[0] if left else np.ones(1)


def _power(x: np.ndarray, m: int) -> np.ndarray:
    out = np.ones(1)
    while m:
        out = _times(out, x) if m & 1 else out
        m >>= 1
        x = _times(x, x) if m else x
    return out


def survival(df: DataFrame, p: str, block: str, q: float, keys: Sequence[str]) -> DataFrame:
    """keys, k, p_ge_k for k = 0 … n: convolution of the block mixtures.

    Equal p are counted first; each part of a block gives one polynomial, and a key's few polynomials meet in one group,
    which has its n + 1 terms.
    """
    fine = F.when(F.col(p) > q, F.raise_error(F.lit(f"a probability exceeds that of its block, {q}"))).otherwise(F.col(p))
    counted = df.groupBy(*keys, block, fine.cast("double").alias("_p")).agg(F.count("*").alias("_m")).withColumn("_part", F.pmod(F.xxhash64("_p"), F.lit(PARTS)))
    types = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        made = _product([_power(np.array([1 - x, x]), int(m)) for x, m in zip(pdf["_p"] / q, pdf["_m"], strict=True)])
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in (*keys, block)), made]], columns=[*keys, block, "_terms"])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = []
        for _, b in pdf.groupby(block, sort=True, dropna=False):
            inner = _product([np.asarray(t, float) for t in b["_terms"]]) * q
            inner[0] += 1 - q
            blocks.append(inner)
        tail = np.cumsum(_product(blocks)[::-1])[::-1]
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "k": range(len(tail)), "p_ge_k": tail})

    parts = counted.groupBy(*keys, block, "_part").applyInPandas(lambda pdf: part(pdf), f"{types}{block} {df.schema[block].dataType.simpleString()}, _terms array<double>")
    return parts.groupBy(*keys).applyInPandas(lambda pdf: whole(pdf), f"{types}k int, p_ge_k double")


def n_effective(p: float, p_ge1: float, trials: int | None = None) -> float:
    """Independent trials of probability p that give p_ge1, no more than there were; not a number outside of 0 < p < 1 and 0 <= p_ge1 < 1."""
    if not 0 < p < 1 or not 0 <= p_ge1 < 1:
        return float("nan")
    n = math.log1p(-p_ge1) / math.log1p(-p)
    return n if trials is None else min(n, float(trials))


def _log_beta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def betabinomial(df: DataFrame, m: str, k: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, rho, p_value: correlation of the beta-binomial with the pooled p by golden section, and half the chi-square of its likelihood ratio.

    Equal (m, k) are counted first; a key's distinct pairs form one group.
    """
    counted = df.groupBy(*keys, F.col(m).alias("m"), F.col(k).alias("k")).agg(F.count("*").alias("c")).withColumn("_k", F.lit(0))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ms, ks, cs = (pdf[c].to_numpy(float) for c in ("m", "k", "c"))
        p = min(max((ks * cs).sum() / (ms * cs).sum(), 1e-9), 1 - 1e-9)

        def loss(rho: float) -> float:
            if rho <= 1e-9:
                return -sum(c * (x * math.log(p) + (n - x) * math.log1p(-p)) for n, x, c in zip(ms, ks, cs, strict=True))
            a, b = p * (1 / rho - 1), (1 - p) * (1 / rho - 1)
            return -sum(c * (_log_beta(x + a, n - x + b) - _log_beta(a, b)) for n, x, c in zip(ms, ks, cs, strict=True))

        lo, hi, g = 1e-9, 0.999, (math.sqrt(5) - 1) / 2
        for _ in range(80):
            x1, x2 = hi - g * (hi - lo), lo + g * (hi - lo)
            lo, hi = (lo, x2) if loss(x1) < loss(x2) else (x1, hi)
        rho = (lo + hi) / 2
        ratio = max(0.0, 2 * (loss(0.0) - loss(rho)))
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in keys), rho, 0.5 * math.erfc(math.sqrt(ratio / 2))]], columns=[*keys, "rho", "p_value"])

    types = "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in keys)
    return counted.groupBy(*keys, "_k").applyInPandas(lambda pdf: one(pdf), f"{types}rho double, p_value double")


def compose(df: DataFrame, p: str, block: str, row: str, arm: str, size: int, q: float) -> DataFrame:
    """Rows chosen in each arm, one after another, each the one that adds most to P(at least one); order and p_ge1 so far.

    Only `size` rows of the highest p of an arm and block can be chosen, so no more of them reach the group of an arm.
    """
    able = df.withColumn("_r", F.row_number().over(Window.partitionBy(arm, block).orderBy(F.desc(p), row))).where(F.col("_r") <= size).drop("_r")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf.sort_values([p, row], ascending=[False, True]).to_dict("records")
        none: dict = {}
        chosen = []
        while left and len(chosen) < size:
            def total(r: dict) -> float:
                out = 1.0
                for b in {*none, r[block]}:
                    inner = none.get(b, 1.0) * (1 - r[p] / q if b == r[block] else 1.0)
                    out *= 1 - q + q * inner
                return 1 - out

            at = max(range(len(left)), key=lambda i: (total(left[i]), -i))
            r = left.pop(at)
            value = total(r)
            none[r[block]] = none.get(r[block], 1.0) * (1 - r[p] / q)
            chosen.append({**r, "position": len(chosen) + 1, "p_ge1": value})
        return pd.DataFrame(chosen)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return able.groupBy(arm).applyInPandas(lambda pdf: one(pdf), f"{fields}, position int, p_ge1 double")
