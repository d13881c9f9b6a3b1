"""Assembly of calibrated scorers: stored null distributions by fingerprint of the model, built only where missing, and the ranks they give.

A head is a function from pairs (pep, allele, …) to the same with `score`, higher being stronger, null or minus infinity where it
has none. Its null distribution for an allele, and for a length where ranks are to be compared across lengths, is kept as counts of
distinct scores under a key that names the head, the allele, the length, and a digest of all that the scores depend on. A build
takes the keys that are wanted and not there, scores only those, writes their rows as one part, and then lists the part in
the manifest by one rename: a part that is not listed is never read, and a build that was lost leaves nothing behind that counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import calibration, ordered
from seqloom.operators.rounds import delete

Head = Callable[[DataFrame], DataFrame]
#: Fixed value: the least percent rank that a logarithm is taken of.
FLOOR = 1e-9
KEY = ["kind", "allele", "length", "fingerprint"]
_MANIFEST = "kind string, allele string, length int, fingerprint string, part string, rows bigint, checksum bigint"
_PART = "kind string, allele string, length int, fingerprint string, score double, n bigint, m bigint"


def _draw(seed: int, no: Column, i: Column) -> Column:
    """32 even bits of a seed and two numbers, the same in every engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), no.cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("bigint")


def _bounds(weights: list[float]) -> list[int]:
    """Upper bounds of all but the last of the parts of 2^32 that weights share."""
    total, sums = sum(weights), 0.0
    out = []
    for w in weights[:-1]:
        sums += w
        out.append(int(sums / total * 2**32))
    return out


def null_peptides(spark: SparkSession, n: int, residues: Mapping[str, float], lengths: Mapping[int, float], *, seed: int = 0, each: bool = False) -> DataFrame:
    """no, pep, length: n strings of residues drawn by weight, their lengths as well; with each, n of every length, for ranks within a length. Without each, length is 0, which stands for all."""
    letters, sizes = sorted(residues), sorted(lengths)
    pick = lambda values, bounds, h: F.get(F.array(*map(F.lit, values)), F.size(F.filter(F.array(*(F.lit(b).cast("bigint") for b in bounds)), lambda b: b <= h))) if bounds else F.lit(values[0])
    rows = spark.range(n).withColumnRenamed("id", "no")
    rows = rows.withColumn("_l", F.explode(F.array(*map(F.lit, sizes))) if each else pick(sizes, _bounds([lengths[s] for s in sizes]), _draw(seed, F.col("no"), F.lit(0))))
    no = F.concat_ws(".", F.col("no").cast("string"), F.col("_l").cast("string")) if each else F.col("no")
    bounds = _bounds([residues[r] for r in letters])
    pep = F.array_join(F.transform(F.sequence(F.lit(1), F.col("_l")), lambda i: pick(letters, bounds, _draw(seed, no, i))), "")
    return rows.select("no", pep.alias("pep"), (F.col("_l") if each else F.lit(0)).alias("length"))


def fingerprints(model: DataFrame, about: str) -> DataFrame:
    """allele, fingerprint: SHA-256 of an allele's rows of a model (allele, length, table, term), to nine decimals, and of what else scores depend on."""
    said = lambda x: F.format_string("%.9f", x)
    entries = F.array_sort(F.transform(F.map_entries("table"), lambda e: F.concat_ws("=", e["key"], said(e["value"]))))
    row = F.concat_ws(";", F.col("length").cast("string"), said(F.col("term")), F.array_join(entries, ","))
    return model.groupBy("allele").agg(F.sha2(F.concat_ws("|", F.lit(about), F.array_join(F.array_sort(F.collect_list(row)), "\n")), 256).alias("fingerprint"))  # the lengths of one allele


class Calibrations:
    """Null distributions below a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def manifest(self) -> DataFrame:
        """Listed keys, each once: of two builds of one key, which have the same rows, the first part in order."""
        fs, at = self._fs(f"{self.path}/manifest")
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/*") if fs.exists(at) else self.spark.createDataFrame([], _MANIFEST)
        return rows.groupBy(*KEY).agg(F.min(F.struct("part", "rows", "checksum")).alias("m")).select(*KEY, "m.*")

    def build(self, kind: str, wanted: DataFrame, nulls: DataFrame, head: Head, positives: DataFrame | None = None) -> int:
        """Builds the keys of wanted (allele, fingerprint), for each length of nulls (pep, length), that are not listed; returns how many.

        positives: allele, pep of known ones, whose scores are kept beside the null's (for length 0 only).
        """
        keys = wanted.select(F.lit(kind).alias("kind"), "allele", "fingerprint").distinct().join(F.broadcast(nulls.select("length").distinct()))  # a row for each length
        part = f"part-{uuid.uuid4().hex}"
        at, todo_at = f"{self.path}/parts/{part}", f"{self.path}/_todo-{part}"
        keys.select(*KEY).join(self.manifest(), KEY, "left_anti").write.parquet(todo_at)
        todo = self.spark.read.parquet(todo_at)
        n = todo.count()
        if n:
            usable = F.col("score").isNotNull() & (F.col("score") > float("-inf")) & ~F.isnan("score")
            count = lambda rows, a, b: head(rows).where(usable).groupBy(*KEY, F.col("score").cast("double").alias("score")).agg(F.count("*").alias(a)).withColumn(b, F.lit(0).cast("bigint")).select(*KEY, "score", "n", "m")
            rows = count(todo.join(nulls.select("pep", "length"), "length"), "n", "m")
            if positives is not None:
                rows = rows.unionByName(count(todo.where("length = 0").join(positives.select("allele", "pep"), "allele"), "m", "n"))
            rows.groupBy(*KEY, "score").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).write.parquet(at)
            listed = todo.join(self._sums(self.spark.read.schema(_PART).parquet(at)), KEY, "left").select(*KEY, F.lit(part).alias("part"), F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"), F.coalesce("checksum", F.lit(0)).cast("bigint").alias("checksum"))
            staged = f"{self.path}/_staged-{part}"
            listed.coalesce(1).write.parquet(staged)
            fs, to = self._fs(f"{self.path}/manifest/{part}")
            fs.mkdirs(to.getParent())
            if not fs.rename(self._fs(staged)[1], to):
                raise RuntimeError(f"{to} could not be written")
        delete(self.spark, todo_at)
        return n

    @staticmethod
    def _sums(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*KEY).agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64("score", "n", "m")).alias("checksum"))

    def _parts(self) -> DataFrame:
        """Rows of all listed parts, with the part; a part that is gone has none."""
        parts = [r.part for r in self.manifest().where("rows > 0").select("part").distinct().collect()]  # one for each build
        there = [p for p in parts if self._fs(f"{self.path}/parts/{p}")[0].exists(self._fs(f"{self.path}/parts/{p}")[1])]
        if not there:
            return self.spark.createDataFrame([], f"{_PART}, part string")
        rows = self.spark.read.schema(_PART).parquet(*(f"{self.path}/parts/{p}" for p in there))
        return rows.withColumn("part", F.regexp_extract(F.col("_metadata.file_path"), r"/parts/(part-[0-9a-f]+)/", 1))

    def rows(self, kind: str, wanted: DataFrame) -> DataFrame:
        """allele, length, score, n, m of the wanted keys (allele, fingerprint) of a head."""
        keys = self.manifest().where(F.col("kind") == kind).join(wanted.select("allele", "fingerprint"), ["allele", "fingerprint"], "left_semi")
        return self._parts().join(keys.select(*KEY, "part"), [*KEY, "part"], "left_semi").select("allele", "length", "score", "n", "m")

    def check(self) -> DataFrame:
        """Every listed key with ok: whether its rows, read again, are as many as listed and have the listed checksum."""
        found = self._parts().groupBy(*KEY, "part").agg(F.count("*").alias("_r"), F.bit_xor(F.xxhash64("score", "n", "m")).alias("_c"))
        both = self.manifest().join(found, [*KEY, "part"], "left")
        return both.select(*KEY, "part", ((F.coalesce("_r", F.lit(0)) == F.col("rows")) & (F.coalesce("_c", F.lit(0)) == F.col("checksum"))).alias("ok"))


def ranked(scores: DataFrame, nulls: DataFrame, out: str, *, by_length: bool = False, pep: str = "pep") -> DataFrame:
    """scores (pep, allele, score) with the percent rank `out` in the null rows of its allele (and of its length, with by_length); null without them.

    Distinct scores of both sides are merged and their counts run by ranges of values, so that no task holds an allele's scores.
    """
    rows = scores.withColumn("_l", F.length(pep) if by_length else F.lit(0))
    own = nulls.where(F.col("n") > 0).select("allele", F.col("length").alias("_l"), "score", F.col("n").cast("bigint").alias("_n"))
    asked = rows.where("score IS NOT NULL").select("allele", "_l", F.col("score").cast("double").alias("score")).distinct().withColumn("_n", F.lit(0).cast("bigint"))
    both = own.unionByName(asked).groupBy("allele", "_l", "score").agg(F.sum("_n").alias("_n"))
    above = ordered.before(both, "score", {"_above": ("sum", "_n")}, ["allele", "_l"], falling=True)
    totals = own.groupBy("allele", "_l").agg(F.sum("_n").alias("_t"))
    known = above.join(totals, ["allele", "_l"]).select("allele", "_l", "score", (100.0 * F.coalesce("_above", F.lit(0)) / F.col("_t")).alias(out))
    return rows.withColumn("score", F.col("score").cast("double")).join(known, ["allele", "_l", "score"], "left").drop("_l")


def chances(nulls: DataFrame) -> DataFrame:
    """allele, steps: isotonic share of known ones by score, of the alleles whose null rows have some beside them."""
    both = nulls.where("length = 0")
    some = both.where("m > 0").select("allele").distinct()
    return calibration.isotonic_counts(both.join(some, "allele", "left_semi"), "score", F.col("m"), F.col("n") + F.col("m"), ["allele"])


def chance(steps: Column, score: Column, rank: Column) -> Column:
    """Share of known ones at a score; without steps what the rank leaves, 1 - rank / 100; null without either."""
    return F.when(steps.isNotNull(), calibration.step_value(steps, score)).otherwise(1 - rank / 100)


def fisher(*ranks: Column) -> Column:
    """Minus the sum of ln of percent ranks, none below FLOOR, to nine decimals, so that equal products tie; null where one is unknown."""
    each = [F.when(r.isNotNull(), -F.ln(F.greatest(r, F.lit(FLOOR)))) for r in ranks]
    return F.round(sum(each[1:], each[0]), 9)


def binder_scores(pairs: DataFrame, calibrations: Calibrations, wanted: DataFrame, nulls: DataFrame, presentation: Head, affinity: Head, *, positives: DataFrame | None = None) -> DataFrame:
    """pairs (pep, allele) with presentation_rank, affinity_rank, binder_rank, band, p_binder, for alleles that have both nulls.

    wanted: allele and the fingerprint of both heads together. The combined statistic is calibrated on the same null strings, each
    with its own two ranks, so that the correlation of the heads is in the null.
    """
    calibrations.build("presentation", wanted, nulls, presentation)
    calibrations.build("affinity", wanted, nulls, affinity)
    one, two = calibrations.rows("presentation", wanted), calibrations.rows("affinity", wanted)

    def both(rows: DataFrame) -> DataFrame:
        first = ranked(presentation(rows), one, "presentation_rank").drop("score")
        second = ranked(affinity(first), two, "affinity_rank").drop("score")
        return second.withColumn("score", fisher(F.col("presentation_rank"), F.col("affinity_rank")))

    calibrations.build("binder", wanted, nulls, lambda rows: both(rows).drop("presentation_rank", "affinity_rank"), positives)
    three = calibrations.rows("binder", wanted)
    out = ranked(both(pairs.select("pep", "allele").distinct()), three, "binder_rank").where("score IS NOT NULL").join(chances(three), "allele", "left")
    return out.select("pep", "allele", "presentation_rank", "affinity_rank", "binder_rank", calibration.band("binder_rank").alias("band"), chance(F.col("steps"), F.col("score"), F.col("binder_rank")).alias("p_binder"))
