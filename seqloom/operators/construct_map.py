"""Maps of constructs: units, linkers and the epitopes of both classes over them, which of these overlap, and their tables and documents.

All constructs are mapped in one plan: windows are joined with the ranks of each class, and epitopes of the two classes with each
other by bins of places.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import sequences as S
from seqloom.operators import tiling
from seqloom.operators.cassette import overlaps
from seqloom.sources import sinks

#: Lengths of the windows of each class; columns of the map, in their order.
LENGTHS = {"mhc1": (8, 9, 10, 11), "mhc2": tuple(range(12, 21))}
MAP_COLUMNS = ("id", "kind", "start", "end", "length", "seq", "cls", "allele", "rank", "unit", "gene", "core", "core_start", "core_end", "overlaps", "n_overlaps")
#: Places in a bin of the overlap join.
BIN = 32


def _feature(kind: str, **columns: Column) -> list[Column]:
    """The columns of a feature but for its overlaps; what is not given is empty."""
    none = {"cls": F.lit(""), "allele": F.lit(""), "rank": F.lit(None).cast("double"), "unit": F.lit(0), "gene": F.lit(""), "core": F.lit(""), "core_start": F.lit(None).cast("int"), "core_end": F.lit(None).cast("int")}
    given = none | columns | {"kind": F.lit(kind)}
    given["length"] = given["end"] - given["start"] + 1
    return [F.col("cassette"), *(given[c].alias(c) for c in MAP_COLUMNS[:-2])]


def epitope_map(cassettes: DataFrame, units: DataFrame, ranks: dict[str, DataFrame], *, threshold: float = 2.0, lengths: dict[str, Sequence[int]] | None = None) -> DataFrame:
    """cassette and MAP_COLUMNS: units, the linkers between them, and a row for each window and allele within the percent rank; places are 1-based and inclusive.

    cassettes: cassette, sequence. units: cassette, unit (from 1), gene, allele, start, end (zero-based, the end not included), in the
    order of the sequence and apart. ranks: by class (mhc1, mhc2), tables of peptide, allele, rank; a class without a table is left out.
    An epitope belongs to the first unit that holds it whole, to none (0) where it spans a junction. Epitopes are numbered by class,
    length, place, rank and allele. Those of different classes that share a place overlap.
    """
    seq = F.col("sequence")
    placed = units.select("cassette", "unit", F.coalesce("gene", F.lit("")).alias("gene"), F.coalesce("allele", F.lit("")).alias("allele"), F.col("start").alias("lo"), F.col("end").alias("hi")).join(cassettes.select("cassette", "sequence"), "cassette")
    cut = lambda a, b: F.substring(seq, a + 1, b - a)
    own = placed.select(*_feature("unit", id=F.concat(F.lit("u"), "unit"), start=F.col("lo") + 1, end=F.col("hi"), seq=cut(F.col("lo"), F.col("hi")), allele=F.col("allele"), unit=F.col("unit"), gene=F.col("gene")))
    before = F.coalesce(F.lag("hi").over(Window.partitionBy("cassette").orderBy("unit")), F.lit(0))
    gaps = placed.withColumn("_p", before).where(F.col("lo") > F.col("_p"))
    linkers = gaps.select(*_feature("linker", id=F.concat(F.lit("l"), F.col("unit") - 1), start=F.col("_p") + 1, end=F.col("lo"), seq=cut(F.col("_p"), F.col("lo"))))
    found = None
    for cls, sizes in (lengths or LENGTHS).items():
        if ranks.get(cls) is None:
            continue
        windows = tiling.tile(cassettes.select("cassette", "sequence"), "sequence", list(sizes), standard=False, kmer="peptide")
        best = ranks[cls].where(F.col("rank") <= threshold).groupBy("peptide", "allele").agg(F.min("rank").alias("rank"))
        core = S.binding_core("peptide", F.lit(cls))
        one = windows.join(best, "peptide").select("cassette", F.lit(cls).alias("cls"), F.col("offset").cast("int").alias("lo"), "peptide", "allele", F.col("rank").cast("double").alias("rank"), core["core"].alias("core"), core["offset"].alias("at"))
        found = one if found is None else found.unionByName(one)
    if found is None:
        out = own.unionByName(linkers).withColumn("overlaps", F.array().cast("array<string>"))
        return out.select("cassette", *MAP_COLUMNS[:-1], F.lit(0).alias("n_overlaps"))
    n = F.length("peptide")
    # the unit that holds an epitope: units are few, and apart, in each cassette
    held = placed.groupBy("cassette").agg(F.array_sort(F.collect_list(F.struct("unit", "gene", "lo", "hi"))).alias("_u"))
    epitopes = found.join(held, "cassette", "left").withColumn("_in", F.get(F.filter("_u", lambda u: (u["lo"] <= F.col("lo")) & (F.col("lo") + n <= u["hi"])), F.lit(0)))
    no = F.row_number().over(Window.partitionBy("cassette").orderBy("cls", n, "lo", "rank", "allele"))
    has_core = (F.col("cls") == "mhc2") & (F.coalesce("core", F.lit("")) != "")
    epitopes = epitopes.select(*_feature("epitope", id=F.concat(F.lit("e"), no), start=F.col("lo") + 1, end=F.col("lo") + n, seq=F.col("peptide"), cls=F.col("cls"), allele=F.col("allele"), rank=F.round("rank", 4), unit=F.coalesce("_in.unit", F.lit(0)), gene=F.coalesce("_in.gene", F.lit("")), core=F.coalesce("core", F.lit("")), core_start=F.when(has_core, F.col("lo") + F.col("at") + 1), core_end=F.when(has_core, F.col("lo") + F.col("at") + 9)))
    of = lambda cls: epitopes.where(F.col("cls") == cls).select("cassette", "id", "start", "end")
    pairs = overlaps(of("mhc1"), of("mhc2"), width=BIN, keys=["cassette"]).select("cassette", F.col("a_id").alias("id"), F.col("b_id").alias("other"))
    both = pairs.unionByName(pairs.select("cassette", F.col("other").alias("id"), F.col("id").alias("other")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.substring("other", 2, 12).cast("int").alias("n"), "other"))), lambda x: x["other"])
    met = both.groupBy("cassette", "id").agg(listed.alias("overlaps"))
    out = own.unionByName(linkers).unionByName(epitopes).join(met, ["cassette", "id"], "left").withColumn("overlaps", F.coalesce("overlaps", F.array().cast("array<string>")))
    return out.select("cassette", *MAP_COLUMNS[:-1], F.size("overlaps").alias("n_overlaps"))


def unit_summary(features: DataFrame) -> DataFrame:
    """cassette, unit, n_mhc1, n_mhc2, alleles_mhc1, alleles_mhc2, n_mhc1_with_mhc2_overlap, self_help of every unit: whether a class I epitope of it overlaps one of class II."""
    e = features.where("kind = 'epitope'")
    of = lambda cls: F.col("cls") == cls
    alleles = lambda cls: F.array_sort(F.collect_set(F.when(of(cls), F.col("allele"))))
    counted = e.where("unit > 0").groupBy("cassette", "unit").agg(
        F.count_if(of("mhc1")).alias("n_mhc1"), F.count_if(of("mhc2")).alias("n_mhc2"), alleles("mhc1").alias("alleles_mhc1"), alleles("mhc2").alias("alleles_mhc2"),
        F.count_if(of("mhc1") & (F.col("n_overlaps") > 0)).alias("n_mhc1_with_mhc2_overlap"),
    )
    units = features.where("kind = 'unit'").select("cassette", "unit", "gene", "allele", F.col("seq").alias("peptide"), "start", "end")
    none = F.array().cast("array<string>")
    full = units.join(counted, ["cassette", "unit"], "left").na.fill(0, ["n_mhc1", "n_mhc2", "n_mhc1_with_mhc2_overlap"])
    return full.withColumn("alleles_mhc1", F.coalesce("alleles_mhc1", none)).withColumn("alleles_mhc2", F.coalesce("alleles_mhc2", none)).withColumn("self_help", F.col("n_mhc1_with_mhc2_overlap") > 0)


def documents(cassettes: DataFrame, features: DataFrame) -> DataFrame:
    """One row for each cassette (cassette, sequence, and spacer if given): its summary, with its units, and its features in order; ready to be written as JSON."""
    units = unit_summary(features).groupBy("cassette").agg(F.array_sort(F.collect_list(F.struct("unit", "gene", "allele", "peptide", "start", "end", "n_mhc1", "n_mhc2", "alleles_mhc1", "alleles_mhc2", "n_mhc1_with_mhc2_overlap", "self_help"))).alias("units"))
    kind = F.when(F.col("kind") == "epitope", 1).otherwise(0)
    ordered = F.array_sort(F.collect_list(F.struct(kind.alias("_k"), F.when(kind == 1, F.substring("id", 2, 12).cast("int")).otherwise(F.col("start")).alias("_n"), F.struct(*MAP_COLUMNS).alias("f"))))  # of one cassette
    count = lambda c: F.count_if((F.col("kind") == "epitope") & c)
    told = features.groupBy("cassette").agg(F.transform(ordered, lambda x: x["f"]).alias("features"), count(F.col("cls") == "mhc1").alias("n_mhc1"), count(F.col("cls") == "mhc2").alias("n_mhc2"), count(F.col("unit") == 0).alias("n_junction_spanning"))
    rows = cassettes.join(told, "cassette").join(units, "cassette", "left")
    helped = F.size(F.filter("units", lambda u: u["self_help"]))
    spacer = F.col("spacer") if "spacer" in cassettes.columns else F.lit("")
    summary = F.struct(F.size("units").alias("n_units"), spacer.alias("spacer"), F.length("sequence").alias("length_aa"), "n_mhc1", "n_mhc2", "n_junction_spanning", helped.alias("n_units_with_self_help"), "units")
    return rows.select("cassette", "sequence", spacer.alias("spacer"), summary.alias("summary"), "features")


def write_map(cassettes: DataFrame, features: DataFrame, *, tsv: str | None = None, json: str | None = None) -> None:
    """The map as a table of tabs, a line for each feature, its overlaps joined by commas, and as JSON, an object for each cassette."""
    if tsv:
        sinks.delimited(features.withColumn("overlaps", F.array_join("overlaps", ",")), tsv, columns=["cassette", *MAP_COLUMNS])
    if json:
        sinks.json_lines(documents(cassettes, features), json)
