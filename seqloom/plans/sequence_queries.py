"""Queries over strings: windows, masks, neighbours, sources. The driver's tables hold no peptides, so their letters stand in for residues: results test operators, not biology."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions import sequences as S
from seqloom.operators import counts, density, loci, neighbours, overlap, rarest, tiling
from seqloom.operators.calibration import percent_rank
from seqloom.operators.rounds import Rounds

R = S.RESIDUES


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts: an input of fewer files than cores is dealt out first, of many files each is read where it lies."""
    d = _read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    cores = spark.sparkContext.defaultParallelism
    return d.repartition(2 * cores) if len(d.inputFiles()) < cores else d


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as short sequences: names of 8 to 25 letters of standard residues, all others are dropped by the domain of the operators."""
    p = _read(spark, sf_dir, "part").select("p_partkey", "p_brand", S.letters("p_name").alias("pep"))
    return p.where(S.is_standard("pep") & F.length("pep").between(8, 25))


_D = "(SELECT doc_id, lang, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM documents)"
_P = f"(SELECT p_partkey, p_brand, pep FROM (SELECT p_partkey, p_brand, upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) AS pep FROM part) WHERE regexp_full_match(pep, '[{R}]+') AND length(pep) BETWEEN 8 AND 25)"


def _tiles(k: int) -> str:
    return f"(SELECT doc_id, lang, off, kmer FROM (SELECT doc_id, lang, off, substr(seq, off + 1, {k}) AS kmer FROM (SELECT doc_id, lang, seq, unnest(range(0, length(seq) - {k - 1})) AS off FROM {_D} WHERE length(seq) >= {k})) WHERE regexp_full_match(kmer, '[{R}]+'))"


def rare_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document the three 9-mers that are rarest in the corpus, with their percent rank among all occurrences of the same language: the top-k is the report."""
    first, back = rarest.rarest(spark, _dealt(spark, sf_dir), "doc_id", "lang", "text", 9, 3)
    # the background of a language: how often each of its k-mers occurs in the corpus
    back = back.select("lang", F.col("n_corpus").cast("double").alias("score"), F.col("texts").alias("docs"))
    ranked = percent_rank(first.withColumn("score", F.col("n_corpus").cast("double")), back, ["lang"], weight="docs")
    return ranked.select("doc_id", tiling.unpacked("code", 9).alias("kmer"), "n_corpus", F.col("first").alias("offset"), F.round("pct_rank", 6).alias("pct_rank"))


_RARE = f"""
WITH p AS (SELECT doc_id, lang, kmer, count(*) AS n_here, min(off) AS off FROM {_tiles(9)} GROUP BY ALL),
c AS (SELECT kmer, CAST(sum(n_here) AS BIGINT) AS n_corpus FROM p GROUP BY kmer),
r AS (SELECT p.*, n_corpus FROM p JOIN c USING (kmer)),
t AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n_corpus, kmer) <= 3),
b AS (SELECT lang, n_corpus, count(*) AS m FROM r GROUP BY ALL),
k AS (SELECT lang, n_corpus, 100.0 * coalesce(sum(m) OVER (PARTITION BY lang ORDER BY n_corpus DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(m) OVER (PARTITION BY lang) AS pct FROM b)
SELECT doc_id, kmer, n_corpus, off AS "offset", round(CAST(pct AS DOUBLE), 6) AS pct_rank FROM t JOIN k USING (lang, n_corpus)"""


def kmer_tile(spark, sf_dir):
    """All windows of 8 and 9 letters of part names."""
    return tiling.tile(_parts(spark, sf_dir).select("p_partkey", "pep"), "pep", [8, 9]).select("p_partkey", "kmer", F.col("offset").cast("bigint").alias("offset"))


_TILE = " UNION ALL ".join(f"SELECT p_partkey, substr(pep, CAST(o AS INT) + 1, {k}) AS kmer, o AS \"offset\" FROM (SELECT p_partkey, pep, unnest(range(0, length(pep) - {k - 1})) AS o FROM {_P})" for k in (8, 9))


def kmer_counts(spark, sf_dir):
    return tiling.letter_counts(_dealt(spark, sf_dir), "text", 5)


def decompose(spark, sf_dir):
    """Face and anchors of every part name, each with the other masked."""
    at = S.anchor_indices("pep", F.lit("mhc1"))
    return _parts(spark, sf_dir).select("p_partkey", S.masked("pep", at, inside=True).alias("tcr_facing"), S.masked("pep", at, inside=False).alias("presentation"), S.infer_class("pep").alias("cls"))


_DEC = f"""SELECT p_partkey,
 array_to_string(list_transform(string_split(pep, ''), lambda c, i: CASE WHEN i = 2 OR i = length(pep) THEN 'X' ELSE c END), '') AS tcr_facing,
 array_to_string(list_transform(string_split(pep, ''), lambda c, i: CASE WHEN i = 2 OR i = length(pep) THEN c ELSE 'X' END), '') AS presentation,
 CASE WHEN length(pep) <= 11 THEN 'mhc1' ELSE 'mhc2' END AS cls FROM {_P}"""


def binding_core(spark, sf_dir):
    c = S.binding_core("pep")
    return _parts(spark, sf_dir).select("p_partkey", c["core"].alias("core"), c["offset"].cast("bigint").alias("offset"))


def _score(s: str) -> str:
    p = lambda i: f"substr({s}, {i}, 1)"
    return f"(CASE WHEN {p(1)} IN ('F','Y','W') THEN 4 WHEN {p(1)} IN ('I','L','V','M') THEN 3 ELSE 0 END + CASE WHEN {p(4)} IN ('L','I','V','M','F','A','Q') THEN 1 ELSE 0 END + CASE WHEN {p(6)} IN ('T','S','A','G','N','V') THEN 1 ELSE 0 END + CASE WHEN {p(9)} IN ('L','I','V','A','K','Y','F') THEN 1 ELSE 0 END)"


_CORE = f"""
WITH f AS (SELECT p_partkey, pep, o, substr(pep, CAST(o AS INT) + 1, 9) AS w FROM (SELECT p_partkey, pep, unnest(range(0, length(pep) - 8)) AS o FROM {_P} WHERE length(pep) > 11)),
b AS (SELECT p_partkey, w, o FROM f QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY {_score("w")} DESC, o) = 1)
SELECT p_partkey, w AS core, o AS "offset" FROM b
UNION ALL SELECT p_partkey, CASE WHEN length(pep) <= 9 THEN pep ELSE substr(pep, 1, 5) || right(pep, 4) END, CAST(0 AS BIGINT) FROM {_P} WHERE length(pep) <= 11"""


def one_substitution(spark, sf_dir):
    """Every variant of one substitution of the documents' words of 8 letters that is itself such a word."""
    words = _read(spark, sf_dir, "documents").select(F.explode(F.split("text", "[^A-Za-z]+")).alias("w"))
    p = words.select(F.upper("w").alias("pep")).where((F.length("pep") == 8) & S.is_standard("pep")).distinct()
    return tiling.substitutions(p, "pep").join(p.select(F.col("pep").alias("variant")), "variant").select("pep", "variant", F.col("pos").cast("bigint").alias("pos"), "residue")


_SUB = f"""WITH p AS (SELECT DISTINCT pep FROM (SELECT upper(unnest(string_split_regex(text, '[^A-Za-z]+'))) AS pep FROM documents) WHERE length(pep) = 8 AND regexp_full_match(pep, '[{R}]+')),
v AS (SELECT pep, i AS pos, r AS residue, substr(pep, 1, CAST(i AS INT)) || r || substr(pep, CAST(i AS INT) + 2) AS variant FROM (SELECT pep, unnest(range(0, length(pep))) AS i FROM p), (SELECT unnest(string_split('{R}', '')) AS r) WHERE substr(pep, CAST(i AS INT) + 1, 1) <> r)
SELECT v.pep, variant, pos, residue FROM v JOIN p q ON v.variant = q.pep"""


def hamming_neighbours(spark, sf_dir):
    """Pairs of part names within two substitutions, each name counted by distance, with the score of its neighbourhood."""
    p = _parts(spark, sf_dir).select("pep").distinct()
    pairs = neighbours.hamming_join(p.select(F.col("pep").alias("query")), p.select(F.col("pep").alias("ref")), 2, least=1)
    n = neighbours.counts_by_distance(pairs, "query", 2)
    return p.join(n, F.col("pep") == F.col("query"), "left").select("pep", *(F.coalesce(f"n{d}", F.lit(0)).cast("bigint").alias(f"n{d}") for d in (1, 2)))


_HAM = f"""WITH p AS (SELECT DISTINCT pep FROM {_P}), h AS (SELECT a.pep, hamming(a.pep, b.pep) AS d FROM p a JOIN (SELECT pep AS pep FROM p) b ON length(a.pep) = length(b.pep))
SELECT pep, count(*) FILTER (d = 1) AS n1, count(*) FILTER (d = 2) AS n2 FROM h GROUP BY pep"""


def nearest_other_name(spark, sf_dir):
    """Every distinct part name, of any key, length and letters, among all others: the nearest within two substitutions."""
    p = _read(spark, sf_dir, "part").select(S.letters("p_name").alias("query")).where("query IS NOT NULL")
    return neighbours.nearest(p, p.select(F.col("query").alias("ref")), 2, least=1).select("query", F.col("dist").cast("bigint").alias("dist"), "nearest", F.col("n_within").cast("bigint").alias("n_within"))


_OTHER = """WITH p AS (SELECT DISTINCT upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) AS pep FROM part WHERE p_name IS NOT NULL),
h AS (SELECT a.pep AS query, b.pep AS ref, hamming(a.pep, b.pep) AS d FROM p a JOIN p b ON length(a.pep) = length(b.pep) AND a.pep <> b.pep),
b AS (SELECT query, min(d) AS d, arg_min(ref, (d, ref)) AS nearest, count(*) AS n FROM h WHERE d <= 2 GROUP BY query)
SELECT p.pep AS query, CAST(coalesce(d, 3) AS BIGINT) AS dist, nearest, coalesce(n, 0) AS n_within FROM p LEFT JOIN b ON p.pep = b.query"""


def exact_source(spark, sf_dir):
    """Every place where a whole benchmark passage stands in a document.

    A passage is covered by pieces of 24 letters, the last one at its end; where all of them stand on one diagonal, the whole does.
    """
    b = _read(spark, sf_dir, "benchmark").select("item_id", S.letters("text").alias("pep")).where(F.length("pep") > 0)
    k, n = F.least(F.lit(24), F.length("pep")), F.length("pep")
    sizes = sorted(r[0] for r in b.select(k).distinct().collect()) or [24]  # at most 24 numbers
    at = F.array_distinct(F.concat(F.sequence(F.lit(0), n - k, k), F.array(n - k)))
    ask = b.select("item_id", F.size(at).alias("m"), F.explode(F.transform(at, lambda i: F.struct(i.alias("i"), F.substring(F.col("pep"), i + 1, k).alias("w")))).alias("z")).select("item_id", "m", "z.i", "z.w")
    cut = tiling.windows_among(_dealt(spark, sf_dir).select("doc_id", "text"), "text", ask.select("w"), sizes, kmer="w", offset="o")
    places = ask.join(cut, "w").groupBy("item_id", "doc_id", "m", (F.col("o") - F.col("i")).alias("d")).agg(F.count("*").alias("c")).where("c = m")
    return places.groupBy("item_id", "doc_id").agg(F.count("*").alias("n"), F.min("d").cast("bigint").alias("first"))


_SRC = f"""WITH b AS (SELECT item_id, pep, least(24, length(pep)) AS k FROM (SELECT item_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS pep FROM benchmark) WHERE length(pep) > 0),
t AS (SELECT doc_id, o, substr(seq, CAST(o AS INT) + 1, CAST(k AS INT)) AS w FROM (SELECT doc_id, seq, k, unnest(range(0, length(seq) - k + 1)) AS o FROM {_D}, (SELECT DISTINCT k FROM b) WHERE length(seq) >= k)),
h AS (SELECT item_id, pep, doc_id, o FROM b JOIN t ON w = substr(pep, 1, CAST(k AS INT)))
SELECT item_id, doc_id, count(*) AS n, min(o) AS "first" FROM h JOIN {_D} USING (doc_id) WHERE substr(seq, CAST(o AS INT) + 1, length(pep)) = pep GROUP BY item_id, doc_id"""


def passage_source(spark, sf_dir):
    """Of each benchmark passage and each document with at least 24 letters in common, or the whole of a shorter passage: the longest run of letters that both have, its first place in either, and whether it is the whole passage.

    Windows are the seed; those on one diagonal that follow each other are one run, so its length is verified letter by letter.
    """
    b = _read(spark, sf_dir, "benchmark").select("item_id", S.letters("text").alias("pep")).where(F.length("pep") > 0)
    b = b.withColumn("n", F.length("pep")).withColumn("k", F.least(F.lit(24), "n"))
    sizes = sorted(r[0] for r in b.select("k").distinct().collect()) or [24]  # at most 24 numbers
    ask = b.select("item_id", "n", "k", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - F.col("k")), lambda i: F.substring(F.col("pep"), i + 1, F.col("k")))).alias("i", "w"))
    cut = tiling.windows_among(_dealt(spark, sf_dir).select("doc_id", "text"), "text", ask.select("w"), sizes, kmer="w", offset="o")
    hits = ask.join(cut, "w").select("item_id", "n", "k", "doc_id", "i", "o", (F.col("o") - F.col("i")).alias("d"))
    w = Window.partitionBy("item_id", "doc_id", "d").orderBy("i")  # no more rows than the passage has letters
    runs = hits.withColumn("r", F.col("i") - F.row_number().over(w)).groupBy("item_id", "doc_id", "n", "k", "d", "r").agg(F.count("*").alias("c"), F.min("i").alias("i"), F.min("o").alias("o"))
    best = runs.groupBy("item_id", "doc_id", "n").agg(F.min(F.struct((-(F.col("k") + F.col("c") - 1)).alias("run"), "i", "o")).alias("m"))
    run = -F.col("m.run")
    return best.select("item_id", "doc_id", run.alias("run"), F.col("m.i").cast("bigint").alias("at"), F.col("m.o").cast("bigint").alias("first"), (run == F.col("n")).alias("whole"))


_PASSAGE = f"""WITH b AS (SELECT item_id, pep, length(pep) AS n, least(24, length(pep)) AS k FROM (SELECT item_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS pep FROM benchmark) WHERE length(pep) > 0),
a AS (SELECT item_id, n, k, i, substr(pep, CAST(i AS INT) + 1, CAST(k AS INT)) AS w FROM (SELECT *, unnest(range(0, n - k + 1)) AS i FROM b)),
t AS (SELECT doc_id, o, substr(seq, CAST(o AS INT) + 1, CAST(k AS INT)) AS w FROM (SELECT doc_id, seq, k, unnest(range(0, length(seq) - k + 1)) AS o FROM {_D}, (SELECT DISTINCT k FROM b) WHERE length(seq) >= k)),
h AS (SELECT item_id, doc_id, n, k, i, o, i - row_number() OVER (PARTITION BY item_id, doc_id, o - i ORDER BY i) AS r FROM a JOIN t USING (w)),
g AS (SELECT item_id, doc_id, n, k + count(*) - 1 AS run, min(i) AS i, min(o) AS o FROM h GROUP BY item_id, doc_id, n, k, o - i, r)
SELECT item_id, doc_id, run, i AS "at", o AS "first", run = n AS whole FROM g QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY run DESC, i, o) = 1"""


def kmer_search(spark, sf_dir):
    """Part names that share at least four distinct 5-mers with another name, nearest first by the count."""
    p = _parts(spark, sf_dir).select("pep").distinct()
    return overlap.shared_kmers(p.select(F.col("pep").alias("query")), p.select(F.col("pep").alias("ref")), 5, 4).where("query <> ref")


_SEARCH = f"""WITH p AS (SELECT DISTINCT pep FROM {_P}), w AS (SELECT DISTINCT pep, substr(pep, CAST(o AS INT) + 1, 5) AS w FROM (SELECT pep, unnest(range(0, length(pep) - 4)) AS o FROM p))
SELECT a.pep AS query, b.pep AS ref, count(*) AS shared FROM w a JOIN w b USING (w) WHERE a.pep <> b.pep GROUP BY ALL HAVING count(*) >= 4"""


def position_profile(spark, sf_dir):
    """Position weights of 10-letter part names by brand: frequency and bits."""
    m = counts.motif(_parts(spark, sf_dir), "pep", 10, group="p_brand")
    return m.select("p_brand", F.col("pos").cast("bigint").alias("pos"), "residue", F.round("freq", 6).alias("freq"), F.round("bits", 6).alias("bits"))


_MOTIF = f"""WITH r AS (SELECT p_brand, i AS pos, substr(pep, CAST(i AS INT) + 1, 1) AS residue FROM (SELECT p_brand, pep, unnest(range(0, 10)) AS i FROM {_P} WHERE length(pep) = 10)),
c AS (SELECT p_brand, pos, residue, count(*) AS n FROM r GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY p_brand, pos) AS f FROM c)
SELECT p_brand, pos, residue, round(CAST(f AS DOUBLE), 6) AS freq, round(log2(20.0) + sum(f * log2(f)) OVER (PARTITION BY p_brand, pos), 6) AS bits FROM s"""


def anchor_counts(spark, sf_dir):
    """Residues at the second and last place of part names by brand and length."""
    return counts.anchor_preferences(_parts(spark, sf_dir), [2, -1], by_length=True, pep="pep", group="p_brand").select(F.col("anchor").cast("bigint").alias("anchor"), F.col("length").cast("bigint").alias("length"), "p_brand", "residue", "cnt")


_ANCH = " UNION ALL ".join(f"SELECT CAST({a} AS BIGINT) AS anchor, length(pep) AS length, p_brand, {e} AS residue, CAST(count(*) AS DOUBLE) AS cnt FROM {_P} GROUP BY ALL" for a, e in ((2, "substr(pep, 2, 1)"), (-1, "right(pep, 1)")))


def face_density(spark, sf_dir):
    """Mean count of the face 3-mers of each part name in the table of all of them, by the table's total."""
    p = _parts(spark, sf_dir)
    return density.density(p, density.code_counts(p, "pep", 3), "pep", 3).select("pep", F.round("density", 9).alias("density"))


_DENS = f"""WITH f AS (SELECT p_partkey, pep, substr(pep, 3, length(pep) - 3) AS face FROM {_P}),
w AS (SELECT p_partkey, pep, substr(face, CAST(o AS INT) + 1, 3) AS w FROM (SELECT *, unnest(range(0, length(face) - 2)) AS o FROM f)),
c AS (SELECT w, count(*) AS n FROM w GROUP BY w), t AS (SELECT sum(n) AS t FROM c),
d AS (SELECT DISTINCT pep FROM {_P}), u AS (SELECT pep, w FROM w WHERE p_partkey IN (SELECT min(p_partkey) FROM {_P} GROUP BY pep))
SELECT pep, round(CAST(sum(n) AS DOUBLE) / (count(*) * max(t)), 9) AS density FROM u JOIN c USING (w), t GROUP BY pep"""


def slippery_sites(spark, sf_dir):
    """Slippery codons of every document, its letters T, C, A and G taken as bases, and codons that deslipping changes."""
    d = _read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.upper("text"), "[^TCAG]", "").alias("cds"))
    return d.select("doc_id", F.size(S.slippery_codons("cds")).cast("bigint").alias("n_sites"), F.md5(S.deslip("cds")).alias("fixed_md5"))


_SLIP = """WITH d AS (SELECT doc_id, regexp_replace(upper(text), '[^TCAG]', '', 'g') AS cds FROM documents),
c AS (SELECT doc_id, cds, list_transform(range(0, length(cds) // 3), lambda i: substr(cds, CAST(i * 3 + 1 AS INT), 3)) AS cs FROM d),
s AS (SELECT doc_id, cds, list_transform(cs, lambda x, i: CASE WHEN x = 'TTT' AND i < len(cs) AND substr(cs[i + 1], 1, 1) IN ('T', 'C') THEN 'TTC' ELSE x END) AS fixed, cs FROM c)
SELECT doc_id, CAST(len(list_filter(list_zip(cs, fixed), lambda z: z[1] <> z[2])) AS BIGINT) AS n_sites, md5(array_to_string(fixed, '') || substr(cds, CAST(length(cds) // 3 * 3 + 1 AS INT))) AS fixed_md5 FROM s"""


def flank_likeness(spark, sf_dir):
    """Identity of the three letters around the shared middle of neighbouring part keys' names."""
    p = _parts(spark, sf_dir).where(F.length("pep") >= 10)
    q = p.select(F.col("p_partkey").alias("k2"), F.col("pep").alias("pep2"))
    j = p.join(q, F.col("p_partkey") + 1 == F.col("k2"))
    return j.select("p_partkey", F.round(S.flank_identity(F.col("pep"), F.lit(3), F.col("pep2"), F.lit(3), F.lit(4), 3), 6).alias("identity"))


def _flank() -> str:
    terms = [(d, d + 3 + 1) if d < 0 else (d, 3 + 4 + d + 1) for d in (-3, -2, -1, 0, 1, 2)]
    both = " + ".join(f"(CASE WHEN {i} <= length(a.pep) AND {i} <= length(b.pep) THEN 1 ELSE 0 END)" for _, i in terms)
    same = " + ".join(f"(CASE WHEN {i} <= length(a.pep) AND {i} <= length(b.pep) AND substr(a.pep, {i}, 1) = substr(b.pep, {i}, 1) THEN 1 ELSE 0 END)" for _, i in terms)
    return f"SELECT a.p_partkey, round(CAST({same} AS DOUBLE) / ({both}), 6) AS identity FROM {_P} a JOIN {_P} b ON a.p_partkey + 1 = b.p_partkey WHERE length(a.pep) >= 10 AND length(b.pep) >= 10"


def locus_components(spark, sf_dir):
    """Documents connected by a shared window of 40 letters that few enough share to be no phrase: here all of them, 1 over the group size as weight."""
    groups = Rounds(spark, "loci").kept(loci.components(_dealt(spark, sf_dir), "doc_id", "text", 40))
    sizes = groups.groupBy(F.col("component").alias("_c")).agg(F.count("*").alias("n"))
    return groups.join(sizes, F.col("component").eqNullSafe(F.col("_c"))).select(F.col("id").alias("doc_id"), "component", F.round(1.0 / F.col("n"), 9).alias("weight"))


QUERIES = {f.__name__: f for f in (rare_kmers, kmer_tile, kmer_counts, decompose, binding_core, one_substitution, hamming_neighbours, nearest_other_name, exact_source, passage_source, kmer_search, position_profile, anchor_counts, face_density, slippery_sites, flank_likeness, locus_components)}
#: Under its first name too.
QUERIES["nearest_name"] = nearest_other_name
#: locus_components is iterative and tested against a plain version.
ORACLE_SQL = {
    "rare_kmers": _RARE, "kmer_tile": _TILE, "kmer_counts": f"SELECT kmer, count(*) AS n FROM {_tiles(5)} GROUP BY kmer", "decompose": _DEC, "binding_core": _CORE, "one_substitution": _SUB,
    "hamming_neighbours": _HAM, "nearest_name": _OTHER, "nearest_other_name": _OTHER, "exact_source": _SRC, "passage_source": _PASSAGE, "kmer_search": _SEARCH, "position_profile": _MOTIF, "anchor_counts": _ANCH, "face_density": _DENS,
    "slippery_sites": _SLIP, "flank_likeness": _flank(),
}
