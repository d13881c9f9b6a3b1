"""Queries over all words of the documents as short sequences, over names and headers made from the tables, and over ranked windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import alleles
from seqloom.functions import sequences as S
from seqloom.operators import counts, density, neighbours, overlap, ranking, restriction

R = S.RESIDUES
#: Least lengths of words that an operator can say something of: a window of five letters, of three in a face, an eighth letter, a class I peptide.
WINDOW, FACE, EIGHTH, CLASS_I = 5, 6, 8, 8


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _words(spark: SparkSession, sf_dir: str, table: str = "documents", least: int = 1, *columns: str) -> DataFrame:
    """Distinct words of `least` letters and more, in upper case, of all texts of a table."""
    w = _read(spark, sf_dir, table).select(*columns, F.explode(F.split("text", "[^A-Za-z]+")).alias("w"))
    return w.select(*columns, F.upper("w").alias("pep")).where(F.length("pep") >= least).distinct()


def _w(table: str = "documents", least: int = 1, columns: str = "") -> str:
    return f"(SELECT DISTINCT {columns} upper(w) AS pep FROM (SELECT {columns} unnest(string_split_regex(text, '[^A-Za-z]+')) AS w FROM {table}) WHERE length(w) >= {least})"


def word_neighbours(spark, sf_dir):
    """Every word with the number of others at one and at two substitutions."""
    return neighbours.neighbour_counts(_words(spark, sf_dir), 2)


_HAM = f"""WITH p AS {_w()}, h AS (SELECT a.pep, hamming(a.pep, b.pep) AS d FROM p a JOIN p b ON length(a.pep) = length(b.pep))
SELECT pep, count(*) FILTER (d = 1) AS n1, count(*) FILTER (d = 2) AS n2 FROM h GROUP BY pep"""


def nearest_word(spark, sf_dir):
    """Every word of the benchmark and its nearest word of the documents within two substitutions, itself included."""
    q, r = _words(spark, sf_dir, "benchmark", 1).select(F.col("pep").alias("query")), _words(spark, sf_dir, "documents", 1).select(F.col("pep").alias("ref"))
    return neighbours.nearest(q, r, 2).select("query", F.col("dist").cast("bigint").alias("dist"), "nearest", F.col("n_within").cast("bigint").alias("n_within"))


_NEAR = f"""WITH q AS {_w("benchmark", 1)}, r AS {_w("documents", 1)},
h AS (SELECT q.pep AS query, r.pep AS ref, hamming(q.pep, r.pep) AS d FROM q JOIN r ON length(q.pep) = length(r.pep)),
b AS (SELECT query, min(d) AS d, arg_min(ref, (d, ref)) AS nearest, count(*) AS n FROM h WHERE d <= 2 GROUP BY query)
SELECT q.pep AS query, CAST(coalesce(d, 3) AS BIGINT) AS dist, nearest, coalesce(n, 0) AS n_within FROM q LEFT JOIN b ON q.pep = b.query"""


def word_search(spark, sf_dir):
    """Pairs of different words that share at least five distinct runs of five letters."""
    p = _words(spark, sf_dir, "documents", WINDOW)
    return overlap.shared_kmers(p.select(F.col("pep").alias("query")), p.select(F.col("pep").alias("ref")), 5, 5).where("query <> ref")


_SEARCH = f"""WITH p AS {_w("documents", WINDOW)}, w AS (SELECT DISTINCT pep, substr(pep, CAST(o AS INT) + 1, 5) AS w FROM (SELECT pep, unnest(range(0, length(pep) - 4)) AS o FROM p))
SELECT a.pep AS query, b.pep AS ref, count(*) AS shared FROM w a JOIN w b USING (w) WHERE a.pep <> b.pep GROUP BY ALL HAVING count(*) >= 5"""


def word_density(spark, sf_dir):
    """Mean count of the face 3-mers of every word of standard residues, by the total of them all."""
    p = _words(spark, sf_dir, "documents", FACE).where(S.is_standard("pep"))
    return density.density(p, density.code_counts(p, "pep", 3), "pep", 3).select("pep", F.round("density", 12).alias("density"))


_DENS = f"""WITH p AS (SELECT pep FROM {_w("documents", FACE)} WHERE regexp_full_match(pep, '[{R}]+')), f AS (SELECT pep, substr(pep, 3, length(pep) - 3) AS face FROM p),
w AS (SELECT pep, substr(face, CAST(o AS INT) + 1, 3) AS w FROM (SELECT *, unnest(range(0, length(face) - 2)) AS o FROM f)),
c AS (SELECT w, count(*) AS n FROM w GROUP BY w), t AS (SELECT sum(n) AS t FROM c)
SELECT pep, round(CAST(sum(n) AS DOUBLE) / (count(*) * max(t)), 12) AS density FROM w JOIN c USING (w), t GROUP BY pep"""


def word_flanks(spark, sf_dir):
    """Words that share their third to eighth letter: identity of the two letters on either side."""
    p = _words(spark, sf_dir, "documents", EIGHTH).withColumn("m", F.substring("pep", 3, 6))
    j = p.join(p.select(F.col("pep").alias("pep2"), "m"), "m").where(F.col("pep") < F.col("pep2"))
    return j.select("pep", "pep2", F.round(S.flank_identity(F.col("pep"), F.lit(2), F.col("pep2"), F.lit(2), F.lit(6), 2), 6).alias("identity"))


def _flank() -> str:
    places = (1, 2, 9, 10)
    seen = " + ".join(f"(CASE WHEN {i} <= length(a.pep) AND {i} <= length(b.pep) THEN 1 ELSE 0 END)" for i in places)
    same = " + ".join(f"(CASE WHEN {i} <= length(a.pep) AND {i} <= length(b.pep) AND substr(a.pep, {i}, 1) = substr(b.pep, {i}, 1) THEN 1 ELSE 0 END)" for i in places)
    return f"WITH p AS {_w('documents', EIGHTH)} SELECT a.pep, b.pep AS pep2, round(CAST({same} AS DOUBLE) / ({seen}), 6) AS identity FROM p a JOIN p b ON substr(a.pep, 3, 6) = substr(b.pep, 3, 6) AND a.pep < b.pep"


def word_mimics(spark, sf_dir):
    """Words of the benchmark against the documents' words of each language: equal ones, near ones, the nearest."""
    refs = _words(spark, sf_dir, "documents", 1, "lang").withColumnRenamed("lang", "category")
    m = neighbours.mimics(_words(spark, sf_dir, "benchmark", 1), refs, 2)
    return m.select("pep", "category", "n_exact", "n_near", "top_mimic", F.coalesce("top_subs", F.lit(0)).cast("bigint").alias("top_subs"))


_MIMICS = f"""WITH q AS {_w("benchmark", 1)}, r AS {_w("documents", 1, "lang,")},
h AS (SELECT q.pep, lang AS category, r.pep AS ref, hamming(q.pep, r.pep) AS d FROM q JOIN r ON length(q.pep) = length(r.pep))
SELECT pep, category, count(*) FILTER (d = 0) AS n_exact, count(*) FILTER (d > 0) AS n_near, arg_min(ref, (d, ref)) FILTER (d > 0) AS top_mimic, CAST(coalesce(min(d) FILTER (d > 0), 0) AS BIGINT) AS top_subs
FROM h WHERE d <= 2 GROUP BY ALL"""


def word_origin(spark, sf_dir):
    """Of every benchmark word the first word of the documents, by place and residue, of which it differs in one letter; none for a word that the documents have."""
    return neighbours.wild_type(_words(spark, sf_dir, "benchmark", 1), _words(spark, sf_dir, "documents", 1).withColumnRenamed("pep", "kmer"))


_ORIGIN = f"""WITH q AS {_w("benchmark", 1)}, r AS {_w("documents", 1)},
h AS (SELECT q.pep, r.pep AS ref, list_filter(range(1, length(q.pep) + 1), lambda i: substr(q.pep, CAST(i AS INT), 1) <> substr(r.pep, CAST(i AS INT), 1))[1] AS pos FROM q JOIN r ON length(q.pep) = length(r.pep) AND hamming(q.pep, r.pep) = 1),
b AS (SELECT pep, arg_min(ref, (pos, substr(ref, CAST(pos AS INT), 1))) AS wild FROM h WHERE contains('{R}', substr(ref, CAST(pos AS INT), 1)) GROUP BY pep)
SELECT q.pep, CASE WHEN q.pep IN (SELECT pep FROM r) THEN NULL ELSE wild END AS wild FROM q LEFT JOIN b USING (pep)"""


def word_lengths(spark, sf_dir):
    """Words by language and length."""
    return counts.length_preferences(_words(spark, sf_dir, "documents", 1, "lang"), pep="pep", group="lang").select("lang", F.col("length").cast("bigint").alias("length"), "cnt")


def residue_counts(spark, sf_dir):
    """Letters of all words."""
    return counts.corpus_stats(_words(spark, sf_dir, "documents", 1), "pep")[0]


def variant_headers(spark, sf_dir):
    """Headers of all families, made from the parts, read into their fields and products."""
    k, n, t, b = F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_type"), F.col("p_brand")
    sub = F.element_at(F.array(*map(F.lit, ("missense_variant", "frameshift_variant", "inframe_deletion", "SPLICE_ACCEPTOR"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    header = (
        F.when(F.col("p_partkey") % 5 == 0, F.concat_ws(":", F.lit("Somatic"), b, k, F.lit("G"), F.lit("A"), sub, n, t, k, b, F.lit("t"), n, F.lit("u")))
        .when(F.col("p_partkey") % 5 == 1, F.concat_ws(":", F.lit("Fusion"), n, sub, t, k, b, F.lit("u"), F.lit("0.5"), F.lit("12")))
        .when(F.col("p_partkey") % 5 == 2, F.concat_ws(":", F.lit("CNV"), b, k, F.lit("59"), t, F.lit("26"), F.lit("0.14")))
        .when(F.col("p_partkey") % 5 == 3, F.concat(F.lit("Isoform:"), F.concat_ws("|", b, k, t, n, F.lit("u"), F.lit("1.5"), F.lit("2.5"), F.lit("3.5"), F.lit("9:1-2:0-3"))))
        .otherwise(F.concat_ws(":", F.lit("Other"), n))
    )
    rows = _read(spark, sf_dir, "part").select("p_partkey", *alleles.header_fields(header))
    return rows.select("p_partkey", "type", "gene_name", "gene_id", "transcript_id", "subtype", "tpm", "ffpm", "sv_len", "span", "windows", alleles.product(F.col("type"), F.col("subtype")).alias("product"))


_SUBTYPE = "(['missense_variant', 'frameshift_variant', 'inframe_deletion', 'SPLICE_ACCEPTOR'])[p_partkey % 4 + 1]"
_HEADERS = f"""WITH p AS (SELECT p_partkey, p_partkey % 5 AS f, p_name AS n, p_type AS t, p_brand AS b, p_partkey::VARCHAR AS k, {_SUBTYPE} AS s FROM part)
SELECT p_partkey, (['Somatic', 'Fusion', 'CNV', 'Isoform', 'Other'])[f + 1] AS "type",
 CASE WHEN f IN (0, 1, 3) THEN n ELSE '' END AS gene_name, CASE WHEN f IN (0, 1) THEN b WHEN f = 3 THEN t ELSE '' END AS gene_id,
 CASE f WHEN 0 THEN 't' WHEN 1 THEN k WHEN 3 THEN k ELSE '' END AS transcript_id, CASE WHEN f IN (0, 1) THEN s ELSE '' END AS subtype,
 CASE f WHEN 0 THEN k WHEN 2 THEN '0.14' WHEN 3 THEN '3.5' ELSE '' END AS tpm, CASE f WHEN 1 THEN '0.5' ELSE '' END AS ffpm, CASE f WHEN 2 THEN '59' ELSE '' END AS sv_len,
 CASE f WHEN 3 THEN '9:1-2:0-3' ELSE '' END AS span, CASE WHEN f IN (1, 2) THEN t ELSE '' END AS windows,
 CASE f WHEN 0 THEN CASE s WHEN 'missense_variant' THEN 'missense' WHEN 'frameshift_variant' THEN 'frameshift' ELSE lower(s) END WHEN 1 THEN 'fusion' WHEN 2 THEN 'cnv' WHEN 3 THEN 'isoform' ELSE 'other' END AS product FROM p"""


def allele_keys(spark, sf_dir):
    """Keys and reports of class II names, made from the customers' numbers."""
    d = lambda c: F.lpad(F.pmod(c, F.lit(100)).cast("string"), 2, "0")
    k = F.col("c_custkey")
    field = F.concat(d(k), F.lit(":"), d(F.floor(k / 7)))
    name = (
        F.when(k % 4 == 0, F.concat(F.lit("HLA-DRB1*"), field)).when(k % 4 == 1, F.concat(F.lit("HLA-DQA1*"), field, F.lit("/DQB1*"), field))
        .when(k % 4 == 2, F.concat(F.lit("HLA-DPB1*"), field)).otherwise(F.concat(F.lit("HLA-A*"), field))
    )
    key = alleles.class2_from_name(name, F.lit("HLA-DPA10201"))
    return _read(spark, sf_dir, "customer").select("c_custkey", key.alias("key"), alleles.class2_report(key, "beta").alias("beta"), alleles.class2_report(key, "isotype").alias("isotype"))


_KEYS = """WITH c AS (SELECT c_custkey, c_custkey % 4 AS f, lpad((c_custkey % 100)::VARCHAR, 2, '0') AS x, lpad(((c_custkey // 7) % 100)::VARCHAR, 2, '0') AS y FROM customer),
k AS (SELECT c_custkey, f, x, y, CASE f WHEN 0 THEN 'DRB1_' || x || y WHEN 1 THEN 'HLA-DQA1' || x || y || '-DQB1' || x || y WHEN 2 THEN 'HLA-DPA10201-DPB1' || x || y ELSE 'HLA-A' || x || ':' || y END AS "key" FROM c)
SELECT c_custkey, "key", CASE f WHEN 0 THEN 'DRB1*' || x || ':' || y WHEN 1 THEN 'DQB1*' || x || ':' || y WHEN 2 THEN 'DPB1*' || x || ':' || y ELSE "key" END AS beta,
 CASE f WHEN 0 THEN 'DR' WHEN 1 THEN 'DQ' WHEN 2 THEN 'DP' ELSE "key" END AS isotype FROM k"""

ALLELES = (("HLA-A02:01", 2, 5), ("HLA-B07:02", 3, 7), ("HLA-C05:01", 11, 4))


def _scored(peptides: DataFrame, column: str) -> DataFrame:
    """peptide, allele, score by the second and last letter: a stand-in for a model's table."""
    a = peptides.select(F.col(column).alias("peptide")).distinct().withColumn("a", F.explode(F.array(*(F.struct(F.lit(n).alias("allele"), F.lit(x).alias("x"), F.lit(y).alias("y")) for n, x, y in ALLELES))))
    score = F.pmod(_place("peptide", 2) * F.col("a.x") + _place("peptide", 0) * F.col("a.y"), F.lit(97)).cast("double")
    return a.select("peptide", F.col("a.allele").alias("allele"), score.alias("score"))


def _place(column: str, at: int):
    """1 to 20 of the letter at a place, or of the last one at 0."""
    return F.expr(f"locate(substring({column}, {at if at else f'length({column})'}, 1), '{R}')")


def ranked_windows(spark, sf_dir):
    """Windows of the benchmark passages over three stand-in alleles: the best one by percent rank against the documents' words, within 10, in the scored table."""
    b = _read(spark, sf_dir, "benchmark").select(F.concat(F.lit("Somatic:chr1:"), F.col("item_id").cast("string")).alias("header"), S.letters("text").alias("seq"))
    background = _scored(_words(spark, sf_dir, "documents", CLASS_I).where(S.is_standard("pep")), "pep").select("allele", "score")
    scores = _scored(restriction.windows_of(b, "mhc1"), "peptide")
    found = restriction.predict_windows(b, scores, background, "mhc1", threshold=10.0)
    table = restriction.scored_table(found, "mhc1")
    return table.select("pos", "epitope", "best_allele", F.round(F.col("affinity_percentile").cast("double"), 6).alias("affinity_percentile")).groupBy("pos", "epitope", "best_allele", "affinity_percentile").agg(F.count("*").alias("n"))


def _ranked() -> str:
    score = lambda c: "CASE a " + " ".join(f"WHEN '{n}' THEN (strpos('{R}', substr({c}, 2, 1)) * {x} + strpos('{R}', right({c}, 1)) * {y}) % 97" for n, x, y in ALLELES) + " END"
    names = ", ".join(f"'{n}'" for n, _, _ in ALLELES)
    tiles = " UNION ALL ".join(f"SELECT item_id, substr(seq, CAST(o AS INT) + 1, {k}) AS pep FROM (SELECT item_id, seq, unnest(range(0, length(seq) - {k - 1})) AS o FROM b WHERE length(seq) >= {k})" for k in restriction.WINDOW_LENGTHS["mhc1"])
    return f"""WITH b AS (SELECT item_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM benchmark),
w AS (SELECT * FROM ({tiles}) WHERE regexp_full_match(pep, '[{R}]+')), al AS (SELECT unnest([{names}]) AS a),
g AS (SELECT a, {score("pep")} AS s FROM {_w("documents", CLASS_I)}, al WHERE regexp_full_match(pep, '[{R}]+')),
q AS (SELECT DISTINCT pep, a, {score("pep")} AS s FROM w, al),
c AS (SELECT a, s, count(*) AS n FROM g GROUP BY ALL), t AS (SELECT a, sum(n) AS t FROM c GROUP BY a),
r AS (SELECT q.pep, q.a, 100.0 * coalesce(sum(c.n), 0) / max(t.t) AS p FROM q JOIN t ON q.a = t.a LEFT JOIN c ON c.a = q.a AND c.s > q.s GROUP BY q.pep, q.a),
m AS (SELECT pep, arg_min(a, (p, a)) AS a, min(p) AS p FROM r GROUP BY pep)
SELECT item_id::VARCHAR AS pos, pep AS epitope, regexp_replace(a, '^(HLA-[A-Z])', '\\1*') AS best_allele, round(CAST(p AS DOUBLE), 6) AS affinity_percentile, count(*) AS n FROM w JOIN m USING (pep) WHERE p <= 10 GROUP BY ALL"""


def type_kernel(spark, sf_dir):
    """Kernels of pairs of part types of one length, by differing letters, X apart."""
    t = _read(spark, sf_dir, "part").select(F.col("p_type").alias("allele"), F.upper("p_type").alias("seq")).distinct()
    return restriction.groove_kernel(t).select("allele", "other", F.round("k", 9).alias("k"))


_KERNEL = """WITH t AS (SELECT DISTINCT p_type AS a, upper(p_type) AS s FROM part)
SELECT x.a AS allele, y.a AS other, round(exp(-coalesce(len(list_filter(range(1, length(x.s) + 1), lambda i: substr(x.s, CAST(i AS INT), 1) <> substr(y.s, CAST(i AS INT), 1) AND substr(x.s, CAST(i AS INT), 1) <> 'X' AND substr(y.s, CAST(i AS INT), 1) <> 'X')), 0) / 2.0::DOUBLE), 9) AS k
FROM t x JOIN t y ON length(x.s) = length(y.s) AND x.a <> y.a"""


def labelled_documents(spark, sf_dir):
    """Quality labels without negatives that are positive elsewhere, toxic ones read as a second source."""
    marks = _read(spark, sf_dir, "labels")
    rows = marks.select("doc_id", F.col("quality").alias("label")).unionByName(marks.select("doc_id", F.col("toxic").alias("label")))
    return ranking.labelled_sets(rows, "doc_id", "label")


_LABELLED = """WITH r AS (SELECT doc_id, quality AS label FROM labels UNION SELECT doc_id, toxic FROM labels)
SELECT DISTINCT doc_id, label FROM r WHERE label = 1 OR doc_id NOT IN (SELECT doc_id FROM r WHERE label = 1)"""

QUERIES = {f.__name__: f for f in (word_neighbours, nearest_word, word_search, word_density, word_flanks, word_mimics, word_origin, word_lengths, residue_counts, variant_headers, allele_keys, ranked_windows, type_kernel, labelled_documents)}
ORACLE_SQL = {
    "word_neighbours": _HAM, "nearest_word": _NEAR, "word_search": _SEARCH, "word_density": _DENS, "word_flanks": _flank(), "word_mimics": _MIMICS, "word_origin": _ORIGIN,
    "word_lengths": f"SELECT lang, length(pep) AS length, count(*) AS cnt FROM {_w('documents', 1, 'lang,')} GROUP BY ALL",
    "residue_counts": f"SELECT residue, count(*) AS n FROM (SELECT unnest(string_split(pep, '')) AS residue FROM {_w('documents', 1)}) GROUP BY residue",
    "variant_headers": _HEADERS, "allele_keys": _KEYS, "ranked_windows": _ranked(), "type_kernel": _KERNEL, "labelled_documents": _LABELLED,
}
