"""Encoding of a presented string for a linear head: residues by role, zone and length bin, adjacent pairs, scales, runs.

Every feature is an expression over the string's own letters, so a whole encoding is one projection without a shuffle; tables
are of fixed size (20 residues, 400 pairs). `tallies` gives the same counts as sparse rows, for fitting tables.

Letters outside the 20 residues add to no sum; they count towards the length and the width of the face, and end a run. A string
of fewer than three letters has no places. A null string has null features, and no rows in `tallies`.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import sequences as S
from seqloom.operators import immunity

#: Zones of the face by class, ends of the length bins of class I, and the lengths at which those of class II begin.
ZONES = {"mhc1": ("tcr_n", "tcr_m", "tcr_c"), "mhc2": ("nflank", "core", "cflank")}
SHORTEST, LONGEST = 8, 11
BEGINS = (14, 16, 19)
CORE = 9


def length_bin(pep: str | Column, cls: str = "mhc1") -> Column:
    """The length within 8 to 11 for class I; for class II how many of the fixed lengths it reaches."""
    n = F.length(pep)
    if cls == "mhc1":
        return F.least(F.greatest(n, F.lit(SHORTEST)), F.lit(LONGEST))
    return sum(((n >= at).cast("int") for at in BEGINS[1:]), (n >= BEGINS[0]).cast("int"))


def places(pep: str | Column, cls: str = "mhc1", register: Column | None = None) -> Column:
    """array<string>: of each place `anchor`, or the zone of the face that it lies in.

    Class I: thirds of the face. Class II: before, inside and after the core at the register (the best one where none is
    given); without a core all places are its inside.
    """
    p = F.col(pep) if isinstance(pep, str) else pep
    first, middle, last = (F.lit(z) for z in ZONES[cls])
    if cls == "mhc1":
        inside, face = immunity.groove(p), F.length(p) - len(immunity.GROOVE)
        at = lambda i: i - 3  # noqa: E731  # the face is what lies between the third place and the last but one
        zone = lambda i: F.when(at(i) < F.floor(face / 3), first).when(at(i) < F.floor(2 * face / 3), middle).otherwise(last)
    else:
        start = S.best_register(p) if register is None else register
        inside = F.coalesce(immunity.groove(p, cls, start), F.array().cast("array<int>"))
        zone = lambda i: F.when(i < start, first).when(i >= start + CORE, last).otherwise(middle)
    role = lambda _, i: F.when(F.coalesce(F.array_contains(inside, i), F.lit(False)), F.lit("anchor")).otherwise(zone(i))
    return F.when(F.length(p) < 3, F.array().cast("array<string>")).otherwise(F.transform(S.chars(p), role))


def _keys(letters: Column, roles: Column, source: str) -> Column:
    """The letters of all places, of a role (tcr: the whole face) or zone, or the adjacent pairs of the face."""
    both = F.arrays_zip(F.slice(letters, 1, F.size(roles)).alias("ch"), roles.alias("role"))
    if source == "pair":
        after = F.when(F.size(both) > 1, F.slice(both, 2, F.greatest(F.size(both) - 1, F.lit(0)))).otherwise(F.slice(both, 1, 0))
        pairs = F.zip_with(F.slice(both, 1, F.size(after)), after, lambda x, y: F.when((x["role"] != "anchor") & (y["role"] != "anchor"), F.concat(x["ch"], y["ch"])))
        return F.filter(pairs, lambda k: k.isNotNull())
    wanted = {"all": lambda _: F.lit(True), "tcr": lambda x: x["role"] != "anchor"}.get(source, lambda x: x["role"] == source)
    return F.transform(F.filter(both, wanted), lambda x: x["ch"])


def _applied(keys: Column, weights: Mapping[str, float]) -> Column:
    table = F.create_map(*(F.lit(x) for k, w in weights.items() for x in (k, float(w))))
    return F.aggregate(keys, F.lit(0.0), lambda a, k: a + F.coalesce(F.try_element_at(table, k), F.lit(0.0)))


def _check(source: str, cls: str) -> tuple[str, int | None]:
    base, _, number = source.partition("@")
    if base not in ("all", "anchor", "tcr", "pair", *ZONES[cls]):
        raise ValueError(f"no source {base!r} in class {cls}")
    return base, int(number) if number else None


def design(df: DataFrame, pep: str, tables: Mapping[str, tuple[str, Mapping[str, float]]], scales: Mapping[str, Mapping[str, float]], *, runs: tuple[str, float] | None = None, means: Iterable[str] = (), cls: str = "mhc1", register: Column | None = None, blind: str = "") -> DataFrame:
    """df with one column for each feature.

    tables: feature -> (source, weights), a source being anchor, tcr, a zone, all or pair, perhaps followed by @ and a length
    bin, outside which the feature is 0; weights of letters in `blind` count as 0. scales: <scale>_all, <scale>_anchor and
    <scale>_tcr, of those in means also <scale>_mean over the face. runs: a scale and the value that a place of the face has
    to exceed, for run_max, run_n and run_frac; an anchor ends a run. length comes with them.
    """
    text = F.upper(F.trim(F.col(pep)))
    work = df.withColumn("_text", text).withColumn("_roles", places("_text", cls, register)).withColumn("_letters", S.chars("_text"))
    letters, roles = F.col("_letters"), F.col("_roles")
    out = {"length": F.length("_text").cast("double")}
    for feature, (source, weights) in tables.items():
        base, number = _check(source, cls)
        value = _applied(_keys(letters, roles, base), {k: w for k, w in weights.items() if not set(k) & set(blind)})
        out[feature] = value if number is None else F.when(length_bin("_text", cls) == number, value).when(F.col("_text").isNotNull(), 0.0)
    for name, scale in scales.items():
        out |= {f"{name}_{source}": _applied(_keys(letters, roles, source), scale) for source in ("all", "anchor", "tcr")}
    for name in means:
        known = F.filter(_keys(letters, roles, "tcr"), lambda ch: ch.isin(*S.RESIDUES))
        out[f"{name}_mean"] = _applied(known, scales[name]) / F.greatest(F.size(known), F.lit(1))
    if runs:
        above = [k for k, v in scales[runs[0]].items() if v > runs[1]]
        marks = F.zip_with(F.slice(letters, 1, F.size(roles)), roles, lambda ch, role: F.when((role != "anchor") & ch.isin(*above), "1").otherwise("0"))
        stretches = F.filter(F.split(F.array_join(marks, ""), "0+"), lambda x: x != "")
        out["run_max"] = F.coalesce(F.array_max(F.transform(stretches, F.length)), F.when(stretches.isNotNull(), 0)).cast("double")
        out["run_n"] = F.when(stretches.isNotNull(), F.size(stretches)).cast("double")
        out["run_frac"] = F.length(F.array_join(stretches, "")) / F.greatest(F.size(F.filter(roles, lambda r: r != "anchor")), F.lit(1))
    return work.select(*df.columns, *(v.alias(k) for k, v in out.items()))


def features(designed: DataFrame, pep: str, blocks: Mapping[str, Iterable[str]]) -> DataFrame:
    """pep, block, feature, value: a design as sparse rows, without those of value 0."""
    each = [F.struct(F.lit(b).alias("block"), F.lit(f).alias("feature"), F.col(f).alias("value")) for b, names in blocks.items() for f in names]
    return designed.select(pep, F.inline(F.array(*each))).where("value <> 0")


def tallies(df: DataFrame, pep: str, cls: str = "mhc1", register: Column | None = None) -> DataFrame:
    """pep, bin, source, key, n: how often each residue stands at the anchors and in each zone, and each adjacent pair on the face; distinct strings, only what occurs."""
    work = df.withColumn("_text", F.upper(F.trim(F.col(pep)))).withColumn("_roles", places("_text", cls, register)).withColumn("_letters", S.chars("_text"))
    sources = F.array(*(F.struct(F.lit(s).alias("source"), _keys(F.col("_letters"), F.col("_roles"), s).alias("keys")) for s in ("anchor", *ZONES[cls], "pair")))
    rows = work.dropDuplicates([pep]).select(pep, length_bin("_text", cls).alias("bin"), F.inline(sources)).select(pep, "bin", "source", F.explode("keys").alias("key"))
    return rows.where(S.is_standard("key")).groupBy(pep, "bin", "source", "key").agg(F.count("*").alias("n"))
