"""Names of alleles and of the pairs of chains that class II alleles are, and variant headers, as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of the four families of variant headers, in their order. All but the last are parted by colons; what
#: follows the type of an Isoform header is parted by bars, and its type is not among its fields.
SOMATIC = ("type", "chrom", "pos", "ref", "alt", "subtype", "wt_window", "mut_window", "tpm", "gene_id", "transcript_id", "gene_name", "uniprot_id")
FUSION = ("type", "gene_name", "subtype", "windows", "transcript_id", "gene_id", "uniprot_id", "ffpm")
CNV = ("type", "chrom", "pos", "sv_len", "windows", "cnv_score", "tpm")
ISOFORM = ("isoform", "transcript_id", "gene_id", "gene_name", "uniprot_id", "cov", "fpkm", "tpm", "span")
FIELDS = tuple(dict.fromkeys((*SOMATIC, *FUSION, *CNV, *ISOFORM)))
#: Consequence of a variant to the kind of its product; others keep their names.
PRODUCTS = {
    "missense_variant": "missense",
    "frameshift_variant": "frameshift",
    "inframe_deletion": "inframe_deletion",
    "inframe_insertion": "inframe_insertion",
    "stop_lost": "stop_lost",
    "start_lost": "start_lost",
    "protein_altering_variant": "protein_altering",
}
#: Products whose sequence no normal tissue has, and those of them of which all that follows the variant is new.
NOVEL = (*PRODUCTS.values(), "fusion")
TRACTS = ("frameshift", "fusion")


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize(name: str | Column) -> Column:
    """Key form of a name: without stars, and a mouse name with its dash: HLA-A*02:01 is HLA-A02:01, H-2Kb is H-2-Kb."""
    a = F.replace(_c(name), F.lit("*"), F.lit(""))
    return F.when(a.startswith("H-2") & (F.length(a) > 3) & (F.substring(a, 4, 1) != "-"), F.concat(F.lit("H-2-"), F.substring(a, F.lit(4), F.length(a)))).otherwise(a)


def starless(name: str | Column) -> Column:
    return F.regexp_replace(_c(name), r"[*]", "")


def class2_beta(beta: str | Column) -> Column:
    """A DP or DQ beta chain as keys spell it, by which its usual alpha chain is looked up: HLA-DPB1*11:01 is DPB11101."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(_c(beta)), "[*:]", ""), "^-+", ""), "^HLA-", "")


def class2_key(alpha: Column, beta: Column, prior: Column | None = None) -> Column:
    """DR by its beta chain alone (DRB1_0101), DP and DQ by both (HLA-DPA10103-DPB10401), mouse as H-2-IAb; without a beta the alpha as it is.

    prior: the usual alpha of that beta (class2_beta), for an absent one; null where there is none.
    """
    a, b = F.coalesce(alpha, F.lit("")), F.trim(F.coalesce(beta, F.lit("")))
    both = F.regexp_replace(a, "[*:]", "")
    first = F.when(both == "", F.coalesce(prior, F.lit("")) if prior is not None else F.lit("")).otherwise(both)
    dr = F.replace(F.replace(F.regexp_replace(b, "^HLA-", ""), F.lit("*"), F.lit("_")), F.lit(":"), F.lit(""))
    return F.when(a.startswith("I-"), F.concat(F.lit("H-2-"), F.replace(a, F.lit("-"), F.lit("")))).when(b.contains("DRB"), dr).when(b == "", a).otherwise(F.concat_ws("-", first, class2_beta(b)))


def class2_from_name(name: str | Column, prior: Column | None = None) -> Column:
    """class2_key of a name as typed: a DR beta, a pair parted by a slash, a DP or DQ beta alone, or a mouse name; others normalised."""
    a = F.trim(_c(name))
    up, slash = F.upper(a), F.instr(a, "/")
    pair = class2_key(F.trim(F.substring(a, F.lit(1), slash - 1)), F.trim(F.substring(a, slash + 1, F.length(a))), prior)
    return (
        F.when(up.startswith("H2-"), F.concat(F.lit("H-2-"), F.substring(a, F.lit(4), F.length(a))))
        .when(up.startswith("H-2"), normalize(a))
        .when(up.startswith("I-"), class2_key(a, F.lit("")))
        .when(slash > 0, pair)
        .when(up.contains("DRB"), class2_key(F.lit("DRA"), a))
        .when(up.rlike("D[PQ]B1") & ~up.rlike("D[PQ]A1"), class2_key(F.lit(""), a, prior))
        .otherwise(normalize(a))
    )


def class2_report(key: str | Column, mode: str = "pair") -> Column:
    """A class II key as it is (pair), its beta chain with star and colons (beta), or DR, DP, DQ or H-2 (isotype); other names stay."""
    if mode not in ("pair", "beta", "isotype"):
        raise ValueError(f"mode must be pair, beta or isotype, not {mode!r}")
    k = F.trim(F.coalesce(_c(key), F.lit("")))
    up = F.upper(k)
    mouse = up.startswith("H-2") | up.startswith("H2-")
    if mode == "pair":
        return k
    if mode == "isotype":
        return F.when(mouse, "H-2").when(up.contains("DR"), "DR").when(up.contains("DP"), "DP").when(up.contains("DQ"), "DQ").otherwise(k)
    chain = F.regexp_replace(F.substring_index(k, "-", -1), "[*:_]", "")
    gene, digits = F.regexp_extract(chain, r"^(D[PQR][AB]\d)(\d{4,})$", 1), F.regexp_extract(chain, r"^(D[PQR][AB]\d)(\d{4,})$", 2)
    said = F.concat(gene, F.lit("*"), F.regexp_replace(digits, r"(\d{2})(?=\d)", "$1:"))
    return F.when(mouse | (gene == "") | (said == F.substring_index(k, "-", -1)), k).otherwise(said)


def isotype(key: str | Column) -> Column:
    return F.regexp_extract(_c(key), r"(DR|DQ|DP)[AB]", 1)


def resolve(names: DataFrame, known: DataFrame, name: str = "name", allele: str = "allele", *, class2: bool = False, prior: Column | None = None) -> DataFrame:
    """names with resolved and exact: the known allele that a spelling of the name equals, else the first that begins with one; null if there is none.

    Spellings, in their order: the class II key, if asked for, the normalised name, and that with HLA- before it. Both
    searches are one equi-join with the beginnings of all known alleles, each with the first allele that has it.
    """
    n = F.trim(F.col(name))
    cand = normalize(n)
    spelled = [*([class2_from_name(n, prior)] if class2 else []), cand, F.when(~F.upper(cand).startswith("HLA-") & ~F.upper(cand).startswith("H-2"), F.concat(F.lit("HLA-"), cand))]
    asked = names.select(name).distinct().select(name, F.posexplode(F.array(*spelled)).alias("_k", "_v")).where("_v IS NOT NULL")
    k = known.select(F.col(allele).alias("_a")).distinct()
    begins = k.select("_a", F.explode(F.transform(F.sequence(F.lit(1), F.length("_a")), lambda i: F.substring(F.col("_a"), F.lit(1), i))).alias("_v")).groupBy("_v").agg(F.min("_a").alias("_first"), F.max(F.col("_a") == F.col("_v")).alias("_same"))
    hits = asked.join(begins, "_v").groupBy(name).agg(F.min(F.when(F.col("_same"), F.struct("_k", "_v"))).alias("_e"), F.min(F.struct("_k", "_first")).alias("_p"))
    found = hits.select(name, F.coalesce("_e._v", "_p._first").alias("resolved"), F.col("_e").isNotNull().alias("exact"))
    return names.join(found, name, "left").withColumn("exact", F.coalesce("exact", F.lit(False)))


def header_fields(header: str | Column) -> list[Column]:
    """One string column for each of FIELDS, "" where a family has no such field or the header is short; an unknown family has its type only."""
    h = F.coalesce(_c(header), F.lit(""))
    kind = F.substring_index(h, ":", 1)
    colons, bars = F.split(h, ":"), F.split(F.when(F.instr(h, ":") > 0, F.substring(h, F.instr(h, ":") + 1, F.length(h))).otherwise(""), r"\|")
    out = []
    for field in FIELDS:
        if field == "type":
            out.append(kind.alias(field))
            continue
        value = F.lit(None).cast("string")
        for family, parts, fields in (("Somatic", colons, SOMATIC), ("Fusion", colons, FUSION), ("CNV", colons, CNV), ("Isoform", bars, ISOFORM)):
            if field in fields:
                value = F.when(kind == family, F.get(parts, F.lit(fields.index(field)))).otherwise(value)
        out.append(F.coalesce(value, F.lit("")).alias(field))
    return out


def product(kind: Column, consequence: Column) -> Column:
    """Kind of product of a variant: its consequence for a Somatic one or one without a type, else its type, in lower case."""
    table = F.create_map(*(F.lit(x) for kv in PRODUCTS.items() for x in kv))
    k, sub = F.trim(F.coalesce(kind, F.lit(""))), F.lower(F.trim(F.coalesce(consequence, F.lit(""))))
    return F.when((k != "") & (k != "Somatic"), F.lower(k)).otherwise(F.coalesce(F.try_element_at(table, sub), sub))


def starred(name: str | Column, cls: str = "mhc1") -> Column:
    """A class I name with the star after its locus, as tables of predictions have it; all others as they are."""
    n = _c(name)
    return F.when(~F.contains(n, F.lit("*")), F.regexp_replace(n, r"^(HLA-[A-Z])(\d)", "$1*$2")).otherwise(n) if cls == "mhc1" else n
