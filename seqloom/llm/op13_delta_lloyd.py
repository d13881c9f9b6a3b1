"""Centroid clustering by delta Lloyd: only what moved is compared and summed again.

Vectors become integers, floor(scale * x). The assignments of a round (owner and squared distance of each vector, beside its
integers) are written to the shared folder, and the next round starts from them. A vector is held against the centroids that
changed since; against all of them only where its own centroid changed and has come no nearer. Global sums and counts of the
clusters are kept on the driver, k x components of them: each round adds what the vectors that changed their owner carry
from one cluster to the other, as signed integers summed inside the tasks first.

All arithmetic is exact: in doubles while every product is below 2^53, otherwise in Python's integers, whose sums travel in
limbs of 30 bits. The first centroids are the vectors with the smallest hashes, found by counting hash prefixes, so that the
driver gets a bounded number of counts and then k vectors.

Cases: vectors of another length, or with null, NaN or infinite components, are left out, as are those whose scaled components
no double holds; a null id comes after all hashes; repeated rows are vectors of their own; equal hashes are ordered by the
components; ties go to the smaller number; fewer vectors than k make as many centroids as there are vectors; an empty table gives an
empty result; a distance or sum beyond 64 bits is null; extra columns are never read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import Scratch

#: Fixed values, the contract's: centroids, components, rounds, scale, seed of the hash.
CENTROIDS, DIM, ROUNDS, SCALE, SEED = 16, 64, 3, 64, 1
#: Below this, squares of components and their sums over any bounded number of components are exact in doubles.
EXACT, LIMB = 2.0**20, 30
#: Hex digits that are counted at a time; rows that are sorted at the end instead.
DIGITS, FEW = 3, 1000
LONGEST = 2**63 - 1

_STATE = "id {kind}, q array<double>, was int, cluster int, distance bigint"


def scaled(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), which a double holds exactly for every double x."""
    with np.errstate(over="ignore"):
        return np.floor(np.float64(scale) * values)


def squared(q: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Exact squared distances of each row of q to each centroid, as 64-bit integers or, where those may not hold them, as Python's."""
    most = max((abs(x) for c in centroids for x in c), default=0)
    if len(q) and max(np.abs(q).max(initial=0), most) >= EXACT:
        rows = np.array([[int(x) for x in row] for row in q], object)
        return np.array([[sum((a - b) ** 2 for a, b in zip(row, c, strict=True)) for c in centroids] for row in rows], object).reshape(len(q), len(centroids))
    c = np.array(centroids, np.float64).reshape(len(centroids), q.shape[1])
    return ((q * q).sum(1)[:, None] - 2 * (q @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)


def reassigned(q: np.ndarray, owner: np.ndarray, distance: np.ndarray, known: np.ndarray, centroids: list[list[int]], changed: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
    """Owners, distances and the number of comparisons made.

    distance: to the owner as it was, where known; changed: numbers of the centroids that differ from those that distances
    were measured to. An unchanged centroid was no nearer than the owner, so it cannot win where the owner has not gone
    further away.
    """
    owner, distance, whole, made = owner.copy(), distance.copy(), ~known, 0
    at = np.flatnonzero(known & np.isin(owner, changed))
    for k in np.unique(owner[at]):
        mine = at[owner[at] == k]
        now = squared(q[mine], [centroids[k]])[:, 0]
        made += len(mine)
        distance = distance.astype(object) if now.dtype == object else distance
        whole[mine] = now > distance[mine]
        distance[mine] = now
    for rows, numbers in ((np.flatnonzero(whole), np.arange(len(centroids))), (np.flatnonzero(~whole), np.array(changed, int))):
        if not len(rows) or not len(numbers):
            continue
        found = squared(q[rows], [centroids[k] for k in numbers])
        made += found.size
        best = found.argmin(1)  # the first of equal ones, and numbers rise
        now, number = found[np.arange(len(rows)), best], numbers[best]
        distance = distance.astype(object) if now.dtype == object else distance
        better = (whole[rows] | (now < distance[rows]) | ((now == distance[rows]) & (number < owner[rows]))).astype(bool)
        owner[rows[better]], distance[rows[better]] = number[better], now[better]
    return owner, distance, made


def limbs(values: list[int]) -> list[list[int]]:
    """Rows of signed limbs, lowest first, whose weighted sum is each of values; at least one row."""
    rows, rest, sign = [], [abs(v) for v in values], [-1 if v < 0 else 1 for v in values]
    while any(rest) or not rows:
        rows.append([s * (r & ((1 << LIMB) - 1)) for s, r in zip(sign, rest, strict=True)])
        rest = [r >> LIMB for r in rest]
    return rows


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _kept(df: DataFrame, id_col: str, vector_col: str, dim: int, scale: int) -> DataFrame:
    """id, q: the integers of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float("inf"))
    rows = df.select(F.col(id_col).alias("id"), v.alias("v")).where((F.size("v") == dim) & F.forall("v", finite))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = scaled(_vectors(b.column(1), dim), scale)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(q.ravel()), dim).cast(pa.list_(pa.float64()))], names=["id", "q"])

    return rows.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, q array<double>")


def _hash(seed: int) -> Column:
    """Null ids get what is greater than every hash."""
    return F.coalesce(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), F.lit("~"))


def first_by_hash(rows: DataFrame, n: int, seed: int) -> list[list[int]]:
    """Integers of the n rows with the smallest hashes, in order. Prefixes are counted, 16^DIGITS of them at most at a time."""
    hashed, bound, need = rows.withColumn("hash", _hash(seed)), "", n
    while True:
        digit = F.substring("hash", len(bound) + 1, DIGITS).alias("digit")
        counts = hashed.where(F.col("hash").startswith(bound)).groupBy(digit).agg(F.count("*").alias("n"), (F.min("hash") == F.max("hash")).alias("one")).collect()
        before = 0
        for r in sorted(counts, key=lambda r: r.digit):
            if before + r.n >= need:
                break
            before += r.n
        else:  # all there are
            bound = "~" if not bound else bound
            break
        bound, need = bound + r.digit, need - before
        if r.n <= FEW or r.one:
            break
    return [[int(x) for x in r.q] for r in hashed.where(F.substring("hash", 1, len(bound)) <= bound).orderBy("hash", "q").limit(n).collect()]


def _assigned(state: DataFrame, kind: str, dim: int, centroids: list[list[int]], changed: list[int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = _vectors(b.column(1), dim)
            was = b.column(2).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
            known = b.column(3).is_valid().to_numpy(zero_copy_only=False)
            owner, distance, _ = reassigned(q, was, b.column(3).fill_null(0).to_numpy(zero_copy_only=False), known, centroids, changed)
            distance = pa.array(distance if distance.dtype == np.int64 else [d if d <= LONGEST else None for d in distance], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(was, pa.int32()), pa.array(owner, pa.int32()), distance], names=["id", "q", "was", "cluster", "distance"])

    return state.select("id", "q", "cluster", "distance").mapInArrow(run, _STATE.format(kind=kind))


def _transfers(state: DataFrame, dim: int) -> dict[int, tuple[int, list[int]]]:
    """Changes of count and of sums of each cluster, from the vectors whose owner changed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = defaultdict(int), defaultdict(lambda: [0] * dim)
        for b in batches:
            q = _vectors(b.column(0), dim)
            exact = q.astype(np.int64) if np.abs(q).max(initial=0) < EXACT else np.array([[int(x) for x in row] for row in q], object).reshape(len(q), dim)
            for sign, column in ((-1, 1), (1, 2)):
                owner = b.column(column).to_numpy(zero_copy_only=False)
                for k in np.unique(owner[owner >= 0]):
                    mine = exact[owner == k]
                    counts[int(k)] += sign * len(mine)
                    sums[int(k)] = [s + sign * int(x) for s, x in zip(sums[int(k)], mine.sum(0), strict=True)]
        rows = [(k, i, counts[k] if i == 0 else 0, row) for k in counts for i, row in enumerate(limbs(sums[k]))]
        if rows:
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["cluster", "limb", "n", "v"])

    moved = state.where(F.col("was") != F.col("cluster")).select("q", "was", "cluster")
    parts = moved.mapInArrow(run, "cluster int, limb int, n bigint, v array<bigint>")
    out: dict = {}
    for r in parts.groupBy("cluster", "limb").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("v", F.lit(i))) for i in range(dim))).alias("v")).collect():
        n, v = out.get(r.cluster, (0, [0] * dim))
        out[r.cluster] = n + r.n, [x + (y << (LIMB * r.limb)) for x, y in zip(v, r.v, strict=True)]
    return out


def cluster(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, dim: int = DIM, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    scratch = Scratch(spark)
    rows = _kept(df, id_col, vector_col, dim, scale)
    centroids = first_by_hash(rows, k, seed)
    state = rows.select("id", "q", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("bigint").alias("distance"))
    sums: dict[int, tuple[int, list[int]]] = {}
    changed = list(range(len(centroids)))
    for _ in range(rounds):
        state = scratch.stored(_assigned(state, kind, dim, centroids, changed), "assignments")
        scratch.drop(keep=1)
        for i, (n, v) in _transfers(state, dim).items():
            m, w = sums.get(i, (0, [0] * dim))
            sums[i] = n + m, [x + y for x, y in zip(v, w, strict=True)]
        after = [[x // sums[i][0] for x in sums[i][1]] if sums.get(i, (0,))[0] else c for i, c in enumerate(centroids)]
        changed = [i for i, (a, b) in enumerate(zip(centroids, after, strict=True)) if a != b]
        centroids = after
    last = scratch.stored(_assigned(state, kind, dim, centroids, changed).select("id", "cluster", "distance"), "assignments")
    scratch.drop(keep=1)
    exact = lambda n, m, s: F.when(n == m, s.try_cast("bigint"))
    wide = F.col("distance").cast("decimal(38,0)")
    each = {r.cluster: r for r in last.groupBy("cluster").agg(F.count("*").alias("n"), F.count("distance").alias("m"), F.try_sum(wide).alias("s")).withColumn("own", exact(F.col("n"), F.col("m"), F.col("s"))).collect()}
    total = sum(int(r.s) for r in each.values()) if all(r.n == r.m and r.s is not None for r in each.values()) else None
    total = total if total is None or total <= LONGEST else None
    told = [(i, r.own, total, hashlib.sha256(",".join(map(str, centroids[i])).encode()).hexdigest()) for i, r in each.items()]
    of = spark.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return last.join(F.broadcast(of), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle() -> str:
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""
d{r} AS (SELECT n, num, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{r} c USING (i) GROUP BY n, num),
a{r} AS (SELECT n, arg_min(num, d * {CENTROIDS} + num) AS num, min(d) AS d FROM d{r} GROUP BY n)""")
        if r < ROUNDS:
            steps.append(f"""
t{r} AS (SELECT num, i, sum(x) AS s, count(*)::HUGEINT AS m FROM a{r} JOIN v USING (n) GROUP BY num, i),
c{r + 1} AS (SELECT num, i, coalesce((s - ((s % m) + m) % m) // m, x) AS x FROM c{r} LEFT JOIN t{r} USING (num, i))""")
    return f"""
WITH q AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor({SCALE}::DOUBLE * x::DOUBLE)::HUGEINT) AS q FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}),
v AS (SELECT n, unnest(range(1, {DIM + 1})) AS i, unnest(q) AS x FROM q),
f AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), q) - 1 AS num, q FROM q QUALIFY num < {CENTROIDS}),
c0 AS (SELECT num, unnest(range(1, {DIM + 1})) AS i, unnest(q) AS x FROM f),{",".join(steps)},
h AS (SELECT num, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY num)
SELECT vec_id, num::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY num))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM q JOIN a{ROUNDS} USING (n) JOIN h USING (num)"""


QUERIES = {"op13_delta_lloyd": op13_delta_lloyd}
ORACLE_SQL = {"op13_delta_lloyd": _oracle()}
