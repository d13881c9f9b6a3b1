"""Sources: FASTA, panels, labelled sets, expression and scored tables, units, models, all as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.alleles import class2_key
from seqloom.functions.sequences import is_standard

#: Lengths of class I and class II peptides, and names under which tables give an affinity in nM.
LENGTHS = {"mhc1": (8, 11), "mhc2": (11, 25)}
AFFINITY_NAMES = ("affinity_nm", "ic50_nm", "ic50", "affinity")


def fasta(spark: SparkSession, path: str, *, whole_header: bool = False) -> DataFrame:
    """name, seq: records split at '>', so that Spark reads parts of a file side by side; .gz is read whole, as Spark does."""
    raw = spark.read.text(path, lineSep="\n>").withColumn("value", F.regexp_replace(F.regexp_replace("value", r"\r", ""), r"^>", "")).where("trim(value) <> ''")
    head = F.substring_index("value", "\n", 1)
    body = F.when(F.instr("value", "\n") > 0, F.upper(F.regexp_replace(F.substring(F.col("value"), F.instr("value", "\n") + 1, F.length("value")), r"\s", ""))).otherwise("")
    return raw.select((head if whole_header else F.regexp_extract(head, r"^(\S*)", 1)).alias("name"), body.alias("seq"))


def gene_symbols(spark: SparkSession, path: str, *, by_accession: bool = False) -> DataFrame:
    """key, gene: GN= of the headers, null without one; the key is the name or the accession between its bars."""
    h = fasta(spark, path, whole_header=True)
    name = F.regexp_extract("name", r"^(\S*)", 1)
    gene = F.regexp_extract("name", r"\bGN=(\S+)", 1)
    return h.select(F.coalesce(F.get(F.split(name, r"\|"), F.lit(1)), name).alias("key") if by_accession else name.alias("key"), F.when(gene != "", gene).alias("gene"))


def delimited(spark: SparkSession, path: str, sep: str = "\t", required: Sequence[str] = ()) -> DataFrame:
    """A table with a header, all strings; every missing required column is named at once, and a byte order mark is dropped."""
    df = spark.read.csv(path, sep=sep, header=True, enforceSchema=False)
    df = df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    return df


def panel(df: DataFrame, *, prior: Column | None = None, classes: Sequence[str] = ("mhc1", "mhc2"), species: str | None = None) -> DataFrame:
    """cls, epitope, allele, weight from raw rows: classes renamed, upper case, standard residues only, class II by its key (prior: column of the usual alpha of a beta chain, where that is to be filled), weight 1 where none is given."""
    cls = F.when(F.upper("mhc_class").isin("MHCI", "I", "MHC1"), "mhc1").when(F.upper("mhc_class").isin("MHCII", "II", "MHC2"), "mhc2")
    beta = F.col("mhc_b") if "mhc_b" in df.columns else F.lit(None).cast("string")
    alpha = F.trim(F.coalesce("mhc_a", F.lit("")))
    # a beta without its alpha has no groove
    key = F.when(cls == "mhc1", alpha).otherwise(class2_key(alpha, beta, prior))
    key = F.when((key != "") & ~key.startswith("-"), key)
    weight = F.coalesce(F.col("weight").try_cast("double"), F.lit(1.0)) if "weight" in df.columns else F.lit(1.0)
    kept = df if species is None else df.where(F.col("mhc_species") == species)
    out = kept.select(cls.alias("cls"), F.upper("epitope").alias("epitope"), key.alias("allele"), weight.alias("weight"))
    return out.where(F.col("cls").isin(*classes) & is_standard("epitope") & F.col("allele").isNotNull())


def peptides(df: DataFrame, cls: str, species: str | None = None, order: str | None = None) -> DataFrame:
    """peptide, source: rows of the class and species or without either, of a length of the class; of each peptide the source of its first row by the column `order`, else the first source in order."""
    least, most = LENGTHS[cls]
    here = F.col("mhc_class").isNull() | (F.col("mhc_class") == cls)
    if species:
        here = here & (F.col("mhc_species").isNull() | (F.col("mhc_species") == species))
    return df.where(here & F.length("peptide").between(least, most) & is_standard("peptide")).groupBy("peptide").agg((F.min("source_protein") if order is None else F.min(F.struct(order, "source_protein"))["source_protein"]).alias("source"))


def expression(df: DataFrame) -> DataFrame:
    """The eight columns of an expression reference; rows whose median is no number are dropped."""
    out = df.select("key", "key_type", "source", "context", *(F.col(c).try_cast("double").alias(c) for c in ("median_tpm", "q25_tpm", "q75_tpm")), F.col("n").try_cast("int").alias("n"))
    return out.where("median_tpm IS NOT NULL AND key IS NOT NULL")


def affinity_of(df: DataFrame):
    """Column of the first affinity that a table gives, of whatever name."""
    present = [F.col(c).try_cast("double") for c in AFFINITY_NAMES if c in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("double")


def model(spark: SparkSession, path: str, features: Sequence[str]) -> list[dict]:
    """Rows feature, coef, mu, sigma of a JSON-lines model; the features have to be exactly these."""
    rows = [r.asDict() for r in spark.read.schema("feature string, coef double, mu double, sigma double").json(path).collect()]
    found = {r["feature"] for r in rows}
    if found != set(features):
        raise ValueError(f"features differ: missing {sorted(set(features) - found)}, unknown {sorted(found - set(features))}")
    return sorted(rows, key=lambda r: list(features).index(r["feature"]))
