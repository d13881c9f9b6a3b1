"""Queries of votes, fuzzy windows, anchor weights and novel registers over the words of the documents and the parts, and their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import scoring
from seqloom.functions import sequences as S
from seqloom.operators import candidates, cassette, counts, density, neighbours, ranking, tiling
from seqloom.operators.rounds import Rounds

#: Windows of fuzzy search, substitutions in each, and best references of a word that are reported.
K, SUBS, PLACES = 5, 1, 10
#: Places of a groove, of part types; lengths of registers.
GROOVE, LENGTHS = 20, (8, 9)


def _words(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """Distinct words of all texts, of any length, in upper case."""
    w = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns, F.explode(F.split("text", "[^A-Za-z]+")).alias("w"))
    return w.where(F.length("w") > 0).select(*columns, F.upper("w").alias("pep")).distinct()


def _w(table: str, columns: str = "") -> str:
    return f"(SELECT DISTINCT {columns} upper(w) AS pep FROM (SELECT {columns} unnest(string_split_regex(text, '[^A-Za-z]+')) AS w FROM {table}) WHERE length(w) > 0)"


def word_votes(spark, sf_dir):
    """Votes of the sources of documents for every word of the benchmark, by words of near signatures, of both classes."""
    panel = _words(spark, sf_dir, "documents", "source").select(F.col("pep").alias("epitope"), F.coalesce("source", F.lit("")).alias("allele"))
    asked = _words(spark, sf_dir, "benchmark").select(F.col("pep").alias("query"))
    both = [neighbours.votes(asked, panel, cls=cls).select(F.lit(cls).alias("cls"), "query", "allele", F.col("votes").cast("bigint").alias("votes"), F.col("n").cast("bigint").alias("n")) for cls in ("mhc1", "mhc2")]
    return both[0].unionByName(both[1])


def _votes() -> str:
    letter = lambda j: f"substr(pep, s + {j}, 1)"
    score = (
        f"(CASE WHEN {letter(0)} IN ('F', 'Y', 'W') THEN 4 WHEN {letter(0)} IN ('I', 'L', 'V', 'M') THEN 3 ELSE 0 END + CASE WHEN {letter(3)} IN ('L', 'I', 'V', 'M', 'F', 'A', 'Q') THEN 1 ELSE 0 END"
        f" + CASE WHEN {letter(5)} IN ('T', 'S', 'A', 'G', 'N', 'V') THEN 1 ELSE 0 END + CASE WHEN {letter(8)} IN ('L', 'I', 'V', 'A', 'K', 'Y', 'F') THEN 1 ELSE 0 END)"
    )
    return f"""WITH p AS (SELECT DISTINCT pep, coalesce(source, '') AS a FROM {_w("documents", "source,")}), q AS {_w("benchmark")},
u AS (SELECT pep FROM p UNION SELECT pep FROM q),
r AS (SELECT pep, arg_max(s, (sc, -s)) AS s FROM (SELECT pep, s, {score} AS sc FROM (SELECT pep, unnest(range(1, length(pep) - 7)) AS s FROM u WHERE length(pep) >= 9)) GROUP BY pep),
g AS (SELECT 'mhc1' AS cls, pep, left(pep, 3) || right(pep, 2) AS sig FROM u UNION ALL SELECT 'mhc2', pep, {letter(0)} || {letter(3)} || {letter(5)} || {letter(8)} FROM r),
qs AS (SELECT cls, pep AS query, sig FROM g JOIN q USING (pep)), ps AS (SELECT cls, pep, a, sig FROM g JOIN p USING (pep)),
k AS (SELECT x.cls, x.sig AS sq, y.sig AS sp, hamming(x.sig, y.sig) AS d FROM (SELECT DISTINCT cls, sig FROM qs) x JOIN (SELECT DISTINCT cls, sig FROM ps) y ON x.cls = y.cls AND length(x.sig) = length(y.sig) WHERE d <= 3),
c AS (SELECT qs.cls, qs.query, sum(n) FILTER (d <= 0) AS n0, sum(n) FILTER (d <= 1) AS n1, sum(n) FILTER (d <= 2) AS n2 FROM qs JOIN k ON k.cls = qs.cls AND k.sq = qs.sig
  JOIN (SELECT cls, sig, count(*) AS n FROM ps GROUP BY ALL) t ON t.cls = k.cls AND t.sig = k.sp GROUP BY qs.cls, qs.query),
o AS (SELECT pep, count(*) AS own FROM p GROUP BY pep),
s AS (SELECT cls, query, CASE WHEN coalesce(n0, 0) - coalesce(own, 0) >= {neighbours.ENOUGH} THEN 0 WHEN coalesce(n1, 0) - coalesce(own, 0) >= {neighbours.ENOUGH} THEN 1 WHEN coalesce(n2, 0) - coalesce(own, 0) >= {neighbours.ENOUGH} THEN 2 ELSE 3 END AS scope FROM c LEFT JOIN o ON o.pep = c.query),
h AS (SELECT qs.cls, qs.query, ps.pep, ps.a, d FROM qs JOIN s ON s.cls = qs.cls AND s.query = qs.query JOIN k ON k.cls = qs.cls AND k.sq = qs.sig AND k.d <= s.scope JOIN ps ON ps.cls = k.cls AND ps.sig = k.sp WHERE ps.pep <> qs.query
  QUALIFY row_number() OVER (PARTITION BY qs.cls, qs.query ORDER BY d, ps.pep, ps.a) <= {neighbours.CAP})
SELECT cls, query, a AS allele, count(*) AS votes, (sum(count(*)) OVER (PARTITION BY cls, query))::BIGINT AS n FROM h GROUP BY cls, query, a"""


def fuzzy_words(spark, sf_dir):
    """Of every word of the benchmark the ten words of the documents that share most of its windows of five letters, one substitution allowed in each, itself left out."""
    asked = _words(spark, sf_dir, "benchmark").select(F.col("pep").alias("query"))
    refs = Rounds(spark, "words").kept(_words(spark, sf_dir, "documents").where(F.length("pep") >= K).select(F.col("pep").alias("ref")))
    found = neighbours.fuzzy_best(asked, refs, K, PLACES + 1, subs=SUBS)  # one more, as a word may be found itself
    mine = found.groupBy("query").agg(F.max(F.when(F.col("ref") == F.col("query"), F.col("place"))).alias("own"))
    others = found.join(mine, "query").where(F.col("ref") != F.col("query")).withColumn("place", F.col("place") - F.when(F.col("own") < F.col("place"), 1).otherwise(0))
    return others.where(F.col("place") <= PLACES).select("query", "ref", "shared", F.col("score").cast("bigint").alias("score"), "place")


_FUZZY = f"""WITH q AS {_w("benchmark")}, r AS {_w("documents")},
qw AS (SELECT DISTINCT pep, substr(pep, o::INT, {K}) AS w FROM (SELECT pep, unnest(range(1, length(pep) - {K - 2})) AS o FROM q WHERE length(pep) >= {K})),
rw AS (SELECT DISTINCT pep, substr(pep, o::INT, {K}) AS w FROM (SELECT pep, unnest(range(1, length(pep) - {K - 2})) AS o FROM r WHERE length(pep) >= {K})),
p AS (SELECT a.w AS a, b.w AS b, hamming(a.w, b.w) AS d FROM (SELECT DISTINCT w FROM qw) a, (SELECT DISTINCT w FROM rw) b WHERE d <= {SUBS}),
m AS (SELECT qw.pep AS query, rw.pep AS ref, qw.w, min(d) AS d FROM qw JOIN p ON p.a = qw.w JOIN rw ON rw.w = p.b GROUP BY ALL),
g AS (SELECT query, ref, count(*) AS shared, min(d)::BIGINT AS score FROM m WHERE query <> ref GROUP BY query, ref)
SELECT query, ref, shared, score, (row_number() OVER (PARTITION BY query ORDER BY shared DESC, score, ref))::INTEGER AS place FROM g QUALIFY place <= {PLACES}"""


def groove_weights(spark, sf_dir):
    """How much each letter of a part's type tells of the last digit of its brand, with and without pruning of places that others explain."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("string").alias("allele"), F.rpad("p_type", GROOVE, "X").alias("seq"), F.right("p_brand", F.lit(1)).alias("residue"))
    both = [counts.anchor_weights(part.select("allele", "seq"), part.select("allele", "residue"), GROOVE, prune=p).select(F.lit(p).alias("pruned"), "pos", F.round("mi", 9).alias("mi"), F.round("w", 6).alias("w")) for p in (False, True)]
    return both[0].unionByName(both[1])


_WEIGHTS = f"""WITH a AS (SELECT p_partkey AS k, rpad(p_type, {GROOVE}, 'X') AS s, right(p_brand, 1) AS y FROM part WHERE p_type IS NOT NULL AND p_brand IS NOT NULL),
e AS (SELECT k, y, i - 1 AS pos, substr(s, i::INT, 1) AS x FROM (SELECT *, unnest(range(1, {GROOVE + 1})) AS i FROM a)), t AS (SELECT count(*)::DOUBLE AS t FROM a),
j AS (SELECT pos, x, y, count(*)::DOUBLE AS n FROM e GROUP BY ALL),
mi AS (SELECT pos, greatest(round(sum(n / t * log2(n * t / (nx * ny))), 12), 0) AS mi FROM (SELECT *, sum(n) OVER (PARTITION BY pos, x) AS nx, sum(n) OVER (PARTITION BY pos, y) AS ny FROM j), t GROUP BY pos),
jj AS (SELECT a.pos, b.pos AS q, a.x, b.x AS z, count(*)::DOUBLE AS n FROM e a JOIN e b ON a.k = b.k AND a.pos <> b.pos GROUP BY ALL),
sh AS (SELECT pos, q, greatest(round(sum(n / t * log2(n * t / (nx * nz))), 12), 0) AS s FROM (SELECT *, sum(n) OVER (PARTITION BY pos, q, x) AS nx, sum(n) OVER (PARTITION BY pos, q, z) AS nz FROM jj), t GROUP BY pos, q),
gone AS (SELECT DISTINCT sh.pos FROM sh JOIN mi m ON m.pos = sh.pos JOIN mi o ON o.pos = sh.q WHERE m.mi > 0 AND o.mi > m.mi AND m.mi <= s),
w AS (SELECT false AS pruned, pos, mi, mi AS w FROM mi UNION ALL SELECT true, pos, mi, CASE WHEN pos IN (SELECT pos FROM gone) THEN 0 ELSE mi END FROM mi)
SELECT pruned, pos::INTEGER AS pos, round(mi, 9) AS mi, round(CASE WHEN sum(w) OVER (PARTITION BY pruned) > 0 THEN w * {GROOVE} / sum(w) OVER (PARTITION BY pruned) ELSE 1 END, 6) AS w FROM w"""


def register_novelty(spark, sf_dir):
    """Registers of every benchmark passage as a unit around its middle, a tract for every third: how many there are, how many are novel, and how many of these some document's letters hold."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("peptide")).where(F.length("peptide") > 0)
    units = b.select("item_id", F.col("item_id").cast("string").alias("unit"), F.lit("").alias("gene"), "peptide", F.floor(F.length("peptide") / 2).cast("int").alias("mutation_index"), F.when(F.col("item_id") % 3 == 0, "fusion").otherwise("missense").alias("kind"))
    registers = cassette.novel_registers(units, LENGTHS)
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    wanted = registers.where("novel").select("register").distinct()
    cut = tiling.windows_among(text, "text", wanted, list(LENGTHS), kmer="register", distinct=True)
    there = cut.select("register").join(wanted, "register", "left_semi").distinct().withColumn("held", F.lit(True))
    return registers.join(there, "register", "left").groupBy("unit").agg(F.count("*").alias("n"), F.count_if("novel").alias("n_novel"), F.count_if(F.col("novel") & F.coalesce("held", F.lit(False))).alias("n_held"))


def _novelty() -> str:
    cuts = " UNION ALL ".join(f"SELECT unit, kind, m, o, substr(s, o::INT + 1, {n}) AS r, {n} AS n FROM (SELECT *, unnest(range(0, length(s) - {n - 1})) AS o FROM u WHERE length(s) >= {n})" for n in LENGTHS)
    docs = " UNION ALL ".join(f"SELECT DISTINCT substr(s, o::INT + 1, {n}) AS r FROM (SELECT s, unnest(range(0, length(s) - {n - 1})) AS o FROM d WHERE length(s) >= {n})" for n in LENGTHS)
    return f"""WITH u AS (SELECT item_id::VARCHAR AS unit, CASE WHEN item_id % 3 = 0 THEN 'fusion' ELSE 'missense' END AS kind, s, length(s) // 2 AS m FROM (SELECT item_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS s FROM benchmark) WHERE length(s) > 0),
d AS (SELECT upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS s FROM documents),
c AS ({cuts}), g AS (SELECT unit, r, bool_or(o + n > m AND (kind = 'fusion' OR o <= m)) AS novel FROM c GROUP BY unit, r),
h AS (SELECT DISTINCT r FROM ({docs}) WHERE r IN (SELECT r FROM g WHERE novel))
SELECT unit, count(*) AS n, count(*) FILTER (novel) AS n_novel, count(*) FILTER (novel AND r IN (SELECT r FROM h)) AS n_held FROM g GROUP BY unit"""


#: A model of candidates: feature, coefficient, mean and deviation, by a rule.
FEATURES = ("pres", "occupancy", "d_occupancy", "wt_absent", "expr", "expr_missing", *candidates.CHANNELS)
MODEL = tuple({"feature": f, "coef": (i % 4 - 1.5) / 2, "mu": i / 8, "sigma": 1 + i / 4} for i, f in enumerate(FEATURES))
CHANNEL_LANGS = dict(zip(candidates.CHANNELS, ("en", "de", "fr"), strict=True))


def ranked_candidates(spark, sf_dir):
    """Words of the benchmark as candidates of their item, scored over affinities by a rule and how large a part of the words of three languages each is, with dense ranks; words of the fourth language are known."""
    words = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", F.explode(F.split("text", "[^A-Za-z]+")).alias("w")).where(F.length("w") > 0)
    counted = words.groupBy("lang", F.upper("w").alias("peptide")).agg(F.count("*").alias("n"))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("t"))
    shares = counted.join(totals, "lang").select("lang", "peptide", (1000.0 * F.col("n") / F.col("t")).alias("value"))
    channels = {c: shares.where(F.col("lang") == lang).select("peptide", "value") for c, lang in CHANNEL_LANGS.items()}
    known = shares.where(F.col("lang") == "es").select("peptide", F.lit("es").alias("set"), F.lit(1).alias("priority"))
    own = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("string").alias("gene"), F.explode(F.split("text", "[^A-Za-z]+")).alias("w")).where(F.length("w") > 0)
    n = F.length("peptide")
    rows = own.groupBy("gene", F.upper("w").alias("peptide")).agg(F.count("*").alias("times"))
    rows = rows.select("peptide", F.lit("A").alias("allele"), "gene", (n * 7 % 50 + 0.5).alias("presentation_rank"), F.lit(None).cast("double").alias("binder_rank"), (n * 25.0).alias("affinity_nm"), F.when(n % 3 > 0, n * 40.0).alias("wt_affinity_nm"), F.when(F.col("times") > 1, F.col("times") * 1.5).alias("tpm"))
    filled = candidates.fill_channels(candidates.features(rows), channels)
    scored = scoring.linear(filled, MODEL).withColumn("score", F.round("score", 6))
    named = ranking.known_set(scored, known, "peptide").withColumn("listing", F.col("known").isNull().cast("int"))
    return ranking.dense_tiers(named, "score", "listing").select("gene", "peptide", "score", "imputed", F.col("rank").cast("bigint").alias("rank"), F.col("listing").cast("bigint").alias("listing"))


def _candidates() -> str:
    o = lambda nm: f"((10.0::DOUBLE / ({nm})) / (1 + 10.0::DOUBLE / ({nm})))"
    value = {"pres": "-log10(greatest(n * 7 % 50 + 0.5, 0.0001))", "occupancy": o("n * 25.0"), "d_occupancy": f"{o('n * 25.0')} - CASE WHEN n % 3 > 0 THEN {o('n * 40.0')} ELSE 0 END", "wt_absent": "CASE WHEN n % 3 > 0 THEN 0 ELSE 1 END", "expr": "CASE WHEN times > 1 THEN ln(1 + times * 1.5) END", "expr_missing": "CASE WHEN times > 1 THEN 0 ELSE 1 END"}
    value |= {c: f"(SELECT v FROM s WHERE s.lang = '{lang}' AND s.p = b.p)" for c, lang in CHANNEL_LANGS.items()}
    cols = ", ".join(f"({v})::DOUBLE AS {f}" for f, v in value.items())
    total = " + ".join(f"coalesce(({m['feature']} - {m['mu']}::DOUBLE) / {m['sigma']}::DOUBLE, 0) * {m['coef']}::DOUBLE" for m in MODEL)
    names = ", ".join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in FEATURES)
    return f"""WITH w AS (SELECT lang, upper(w) AS p, count(*) AS n FROM (SELECT lang, unnest(string_split_regex(text, '[^A-Za-z]+')) AS w FROM documents) WHERE length(w) > 0 GROUP BY ALL),
s AS (SELECT lang, p, 1000.0::DOUBLE * n / sum(n) OVER (PARTITION BY lang) AS v FROM w),
b AS (SELECT gene, upper(w) AS p, length(upper(w)) AS n, count(*) AS times FROM (SELECT item_id::VARCHAR AS gene, unnest(string_split_regex(text, '[^A-Za-z]+')) AS w FROM benchmark) WHERE length(w) > 0 GROUP BY gene, upper(w)),
f AS (SELECT gene, p, {cols} FROM b),
z AS (SELECT gene, p, round({total}, 6) AS score, concat_ws(';', {names}) AS imputed FROM f)
SELECT gene, p AS peptide, score, imputed, dense_rank() OVER (ORDER BY score DESC) AS rank, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.lang = 'es' AND s.p = z.p) THEN 0::BIGINT ELSE 1 END AS listing FROM z"""


def masked_density(spark, sf_dir):
    """Mean count of the 4-mers of every word of standard residues, anchors of its class as wildcards, among those of all words; classes by length, the core of class II by its register."""
    words = Rounds(spark, "words").kept(_words(spark, sf_dir, "documents").where(S.is_standard("pep")))  # read six times below
    out = None
    for cls, own in (("mhc1", F.length("pep") <= S.CLASS_I_MOST), ("mhc2", F.length("pep") > S.CLASS_I_MOST)):
        face = partial(S.face_kmers, cls=cls, wildcard=True)
        mine = words.where(own)
        one = density.density(mine, density.code_counts(mine, "pep", 4, face=face), "pep", 4, face=face).select("pep", F.lit(cls).alias("cls"), F.round("density", 12).alias("density"))
        out = one if out is None else out.unionByName(one)
    return out


def _masked() -> str:
    letter = lambda j: f"substr(pep, s + {j}, 1)"
    score = (
        f"(CASE WHEN {letter(0)} IN ('F', 'Y', 'W') THEN 4 WHEN {letter(0)} IN ('I', 'L', 'V', 'M') THEN 3 ELSE 0 END + CASE WHEN {letter(3)} IN ('L', 'I', 'V', 'M', 'F', 'A', 'Q') THEN 1 ELSE 0 END"
        f" + CASE WHEN {letter(5)} IN ('T', 'S', 'A', 'G', 'N', 'V') THEN 1 ELSE 0 END + CASE WHEN {letter(8)} IN ('L', 'I', 'V', 'A', 'K', 'Y', 'F') THEN 1 ELSE 0 END)"
    )
    return f"""WITH p AS (SELECT pep, length(pep) AS n FROM {_w("documents")} WHERE regexp_full_match(pep, '[{S.RESIDUES}]+')),
r AS (SELECT pep, arg_max(s, (sc, -s)) AS s FROM (SELECT pep, s, {score} AS sc FROM (SELECT pep, unnest(range(1, n - 7)) AS s FROM p WHERE n > {S.CLASS_I_MOST})) GROUP BY pep),
a AS (SELECT p.pep, n, CASE WHEN n <= {S.CLASS_I_MOST} THEN 'mhc1' ELSE 'mhc2' END AS cls, CASE WHEN n <= {S.CLASS_I_MOST} THEN [1, 2, 3, n - 1, n] ELSE [s, s + 3, s + 5, s + 8] END AS pl FROM p LEFT JOIN r USING (pep)),
f AS (SELECT pep, cls, n, array_to_string(list_transform(string_split(pep, ''), lambda c, i: CASE WHEN list_contains(pl, i) THEN '*' ELSE c END), '') AS face FROM a),
w AS (SELECT pep, cls, substr(face, o::INT, 4) AS w FROM (SELECT *, unnest(range(1, n - 2)) AS o FROM f WHERE n >= 4)),
c AS (SELECT cls, w, count(*) AS m FROM w GROUP BY cls, w), t AS (SELECT cls, sum(m) AS t FROM c GROUP BY cls),
d AS (SELECT pep, cls, sum(m)::DOUBLE / (count(*) * any_value(t)) AS d FROM w JOIN c USING (cls, w) JOIN t USING (cls) GROUP BY pep, cls)
SELECT a.pep, a.cls, round(d, 12) AS density FROM a LEFT JOIN d USING (pep)"""


QUERIES = {f.__name__: f for f in (word_votes, fuzzy_words, groove_weights, register_novelty, ranked_candidates, masked_density)}
ORACLE_SQL = {"word_votes": _votes(), "fuzzy_words": _FUZZY, "groove_weights": _WEIGHTS, "register_novelty": _novelty(), "ranked_candidates": _candidates(), "masked_density": _masked()}
