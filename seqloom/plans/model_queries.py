"""Queries of the anchor model over the words of each source of documents, and their SQL.

A source stands for an allele, an occurrence of a word in it for a row of the panel; sources whose numbers are near are alike.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import anchor_model as M
from seqloom.operators import scorer
from seqloom.operators.rounds import shared_folder

ANCHORS = M.ANCHORS["mhc1"]
#: Scale of the kernel over numbers of sources; lengths that the model knows, the longer ones by their shares over all lengths.
H, LENGTHS = 4.0, tuple(range(3, 41))


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """epitope, allele, w: words of three letters and more (an anchor needs them), their sources, and how often they stand there."""
    w = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.coalesce("source", F.lit("")).alias("allele"), F.explode(F.split("text", "[^A-Za-z]+")).alias("w"))
    return w.where(F.length("w") >= 3).groupBy(F.upper("w").alias("epitope"), "allele").agg(F.count("*").alias("w"))


def _kernel(panel: DataFrame) -> DataFrame:
    a = panel.select("allele").distinct().withColumn("i", F.coalesce(F.regexp_extract("allele", r"(\d+)$", 1).try_cast("int"), F.lit(0)))
    return a.join(a.select(F.col("allele").alias("other"), F.col("i").alias("j"))).where("allele <> other").select("allele", "other", F.exp(-F.abs(F.col("i") - F.col("j")) / H).alias("k"))  # a row for each pair of sources


def _fitted(spark, sf_dir):
    kept = M.Rounds(spark, "anchors")
    panel = kept.kept(_panel(spark, sf_dir))  # texts are read once
    counts, kernel = kept.kept(M.anchor_counts(panel, ANCHORS, weight="w")), kept.kept(_kernel(panel))
    return panel, counts, kernel, M.distributions(counts, kernel, M.fitted_tau(counts, ANCHORS))


def anchor_distributions(spark, sf_dir):
    """Shares of residues at the anchors of every source, over all lengths and at each, in two stages of back-off with fitted prior strengths."""
    return _fitted(spark, sf_dir)[3].select("anchor", "length", "allele", "residue", F.round("p", 9).alias("p"))


def anchor_scores(spark, sf_dir):
    """Every word with the source that its anchors fit best, the log odds there, and how many sources fit it better than the background."""
    panel, counts, kernel, shares = _fitted(spark, sf_dir)
    model = M.models(shares, counts, LENGTHS, terms=M.length_terms(panel, kernel, LENGTHS, weight="w"))
    words = panel.select(F.col("epitope").alias("pep")).where(F.length("epitope") <= LENGTHS[-1]).distinct()
    scored = M.score(words, model, ANCHORS).withColumn("score", F.round("score", 6))
    best = F.min(F.struct((-F.col("score")).alias("s"), "allele")).alias("b")
    return scored.groupBy("pep").agg(best, F.count_if(F.col("score") > 0).alias("above")).select("pep", F.col("b.allele").alias("allele"), (-F.col("b.s")).alias("score"), "above")


def _theta() -> str:
    array = "[" + ", ".join(map(str, ANCHORS)) + "]"
    return f"""
w AS (SELECT upper(w) AS ep, coalesce(source, '') AS a, count(*)::DOUBLE AS n FROM (SELECT source, unnest(string_split_regex(text, '[^A-Za-z]+')) AS w FROM documents) WHERE length(w) >= 3 GROUP BY ALL),
s AS (SELECT DISTINCT a, coalesce(try_cast(regexp_extract(a, '(\\d+)$', 1) AS INT), 0) AS i FROM w),
k AS (SELECT x.a, y.a AS o, exp(-abs(x.i - y.i) / {H}::DOUBLE) AS k FROM s x JOIN s y ON x.a <> y.a),
e AS (SELECT ep, a, n, length(ep) AS len, unnest({array}) AS j FROM w),
p AS (SELECT *, CASE WHEN j > 0 THEN j ELSE len + j + 1 END AS pl FROM e),
f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY ep, a, pl ORDER BY list_position({array}, j)) = 1),
c AS (SELECT j, len, a, substr(ep, pl::INT, 1) AS r, sum(n) AS c FROM f GROUP BY ALL),
c0 AS (SELECT j, a, r, sum(c) AS c FROM c GROUP BY ALL),
rich AS (SELECT *, sum(c) OVER (PARTITION BY j, a) AS n FROM c0 QUALIFY n >= {M.RICH}),
al AS (SELECT DISTINCT j, a, n FROM rich), tot AS (SELECT j, sum(n) AS t, count(*) AS k FROM al GROUP BY j),
m AS (SELECT j, r, sum(c) / any_value(t) AS m FROM rich JOIN tot USING (j) WHERE r IN ({", ".join(repr(x) for x in M.S.RESIDUES)}) GROUP BY j, r),
v AS (SELECT al.j, m.r, any_value(m.m) AS m, avg((coalesce(rich.c / rich.n, 0) - m.m) ** 2) AS v FROM al JOIN m ON al.j = m.j LEFT JOIN rich ON rich.j = al.j AND rich.a = al.a AND rich.r = m.r GROUP BY al.j, m.r),
tau AS (SELECT x.j, coalesce(least({M.TAU_MOST}, greatest({M.TAU_LEAST}, num / var - 1)), {M.TAU}) AS tau FROM (SELECT unnest({array}) AS j) x
  LEFT JOIN (SELECT j, sum(m * (1 - m)) AS num, sum(v) AS var FROM v JOIN tot USING (j) WHERE k >= {M.RICH_ALLELES} GROUP BY j) USING (j)),
o AS (SELECT j, a, r, sum(c) AS c, sum(m) AS m FROM (SELECT j, a, r, c, 0 AS m FROM c0 UNION ALL SELECT j, k.a, r, 0, k * c FROM c0 JOIN k ON k.o = c0.a) GROUP BY ALL),
over_all AS (SELECT j, a, r, (c + CASE WHEN sm > 0 THEN tau * m / sm ELSE 0 END) / (n + CASE WHEN sm > 0 THEN tau ELSE 0 END) AS p
  FROM (SELECT *, sum(c) OVER w AS n, sum(m) OVER w AS sm FROM o WINDOW w AS (PARTITION BY j, a)) JOIN tau USING (j)),
ol AS (SELECT j, len, a, r, sum(c) AS c, sum(m) AS m FROM (SELECT j, len, a, r, c, 0 AS m FROM c UNION ALL SELECT j, len, k.a, r, 0, k * c FROM c JOIN k ON k.o = c.a) GROUP BY ALL),
at_len AS (SELECT j, len, a, r, n, tau, (c + CASE WHEN sm > 0 THEN tau * m / sm ELSE 0 END) / (n + CASE WHEN sm > 0 THEN tau ELSE 0 END) AS p
  FROM (SELECT *, sum(c) OVER w AS n, sum(m) OVER w AS sm FROM ol WINDOW w AS (PARTITION BY j, len, a)) JOIN tau USING (j) WHERE n > 0),
own AS (SELECT DISTINCT j, len, a, n, tau FROM at_len),
keys AS (SELECT j, len, a, r FROM at_len UNION SELECT j, len, a, r FROM own JOIN over_all USING (j, a)),
theta AS (SELECT j, 0 AS len, a, r, p FROM over_all UNION ALL
  SELECT keys.j, keys.len, keys.a, keys.r, (own.n * coalesce(at_len.p, 0) + own.tau * coalesce(over_all.p, 0)) / (own.n + own.tau)
  FROM keys JOIN own USING (j, len, a) LEFT JOIN at_len USING (j, len, a, r) LEFT JOIN over_all ON over_all.j = keys.j AND over_all.a = keys.a AND over_all.r = keys.r)"""


def _scores() -> str:
    m, n = LENGTHS[-1], len(LENGTHS)
    return f"""WITH {_theta()},
b AS (SELECT j, r, sum(c) / sum(sum(c)) OVER (PARTITION BY j) AS b FROM c0 GROUP BY j, r),
lc AS (SELECT a, length(ep) AS len, sum(n) AS c FROM w GROUP BY ALL),
lo AS (SELECT a, len, sum(c) AS c, sum(m) AS m FROM (SELECT a, len, c, 0 AS m FROM lc UNION ALL SELECT k.a, len, 0, k * c FROM lc JOIN k ON k.o = lc.a) GROUP BY ALL),
lp AS (SELECT a, len, (c + CASE WHEN sm > 0 THEN {M.TAU} * m / sm ELSE 0 END) / (n + CASE WHEN sm > 0 THEN {M.TAU} ELSE 0 END) AS p FROM (SELECT *, sum(c) OVER w AS n, sum(m) OVER w AS sm FROM lo WINDOW w AS (PARTITION BY a))),
q AS (SELECT DISTINCT j, pl, ep, len, substr(ep, pl::INT, 1) AS r FROM f WHERE len <= {m}),
z AS (SELECT q.ep, s.a, any_value(q.len) AS len, sum(ln((coalesce(theta.p, 0) + {M.EPS}) / (b.b + {M.EPS}))) AS z
  FROM q JOIN s ON true JOIN b ON b.j = q.j AND b.r = q.r LEFT JOIN own ON own.j = q.j AND own.len = q.len AND own.a = s.a
  LEFT JOIN theta ON theta.j = q.j AND theta.a = s.a AND theta.r = q.r AND theta.len = CASE WHEN own.a IS NULL THEN 0 ELSE q.len END GROUP BY q.ep, s.a),
y AS (SELECT ep, z.a, round(z + ln((coalesce(p, 0) + {M.EPS}) / (1.0 / {n} + {M.EPS})), 6) AS z FROM z LEFT JOIN lp ON lp.a = z.a AND lp.len = z.len)
SELECT ep AS pep, arg_min(a, (-z, a)) AS allele, max(z) AS score, count(*) FILTER (z > 0) AS above FROM y GROUP BY ep"""


#: Strings of the null, their letters in even parts, and seed; a second head of the calibrated scores: a value of each letter by a rule.
NULLS, SEED, NULL_LENGTHS = 400, 1, (6, 8)


def _value(letter: str) -> float:
    return (M.S.RESIDUES.index(letter) * 7 % 11 - 5) / 4


def _second_head(rows: DataFrame) -> DataFrame:
    table = F.create_map(*(F.lit(x) for r in M.S.RESIDUES for x in (r, _value(r))))
    values = F.aggregate(F.transform(F.split("pep", ""), lambda c: F.coalesce(F.try_element_at(table, c), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn("score", values)


def binder_scores(spark, sf_dir):
    """Every word of the benchmark with every source: percent ranks of both heads, and of the two together, against null strings that are built once for each model."""
    panel, counts, kernel, shares = _fitted(spark, sf_dir)
    kept = M.Rounds(spark, "models")
    model = kept.kept(M.models(shares, counts, LENGTHS, terms=M.length_terms(panel, kernel, LENGTHS, weight="w")))
    words = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.explode(F.split("text", "[^A-Za-z]+")).alias("w")).where(F.length("w").between(LENGTHS[0], LENGTHS[-1])).select(F.upper("w").alias("pep")).distinct()
    prints = scorer.fingerprints(model, f"null {NULLS} {SEED} {NULL_LENGTHS}")
    nulls = scorer.null_peptides(spark, NULLS, dict.fromkeys(M.S.RESIDUES, 1.0), dict.fromkeys(NULL_LENGTHS, 1.0), seed=SEED)
    at = scorer.Calibrations(spark, f"{shared_folder(spark)}/calibrations-{uuid.uuid4().hex}")  # new on each call, so that no run profits from one before
    first = lambda rows: M.score(rows, model, ANCHORS).withColumn("score", F.round("score", 6))
    pairs = words.join(model.select("allele", "length"), F.length("pep") == F.col("length")).select("pep", "allele")
    found = scorer.binder_scores(pairs, at, prints, nulls, first, _second_head)
    return found.select("pep", "allele", F.round("presentation_rank", 6).alias("presentation_rank"), F.round("affinity_rank", 6).alias("affinity_rank"), F.round("binder_rank", 6).alias("binder_rank"), "band")


def _binders() -> str:
    m, n = LENGTHS[-1], len(LENGTHS)
    bounds = [int((i + 1) / 20 * 2**32) for i in range(19)]
    half = 2**31
    draw = lambda no, i: f"CAST('0x' || substr(md5('{SEED}:' || {no} || ':' || {i}), 1, 8) AS BIGINT)"
    letter = f"substr('{M.S.RESIDUES}', 1 + len(list_filter({bounds}, lambda b: b <= h)), 1)"
    value = "CASE r " + " ".join(f"WHEN '{r}' THEN {_value(r)}::DOUBLE" for r in M.S.RESIDUES) + " ELSE 0 END"
    array = "[" + ", ".join(map(str, ANCHORS)) + "]"
    return f"""WITH {_theta()},
b AS (SELECT j, r, sum(c) / sum(sum(c)) OVER (PARTITION BY j) AS b FROM c0 GROUP BY j, r),
lc AS (SELECT a, length(ep) AS len, sum(n) AS c FROM w GROUP BY ALL),
lo AS (SELECT a, len, sum(c) AS c, sum(m) AS m FROM (SELECT a, len, c, 0 AS m FROM lc UNION ALL SELECT k.a, len, 0, k * c FROM lc JOIN k ON k.o = lc.a) GROUP BY ALL),
lp AS (SELECT a, len, (c + CASE WHEN sm > 0 THEN {M.TAU} * m / sm ELSE 0 END) / (n + CASE WHEN sm > 0 THEN {M.TAU} ELSE 0 END) AS p FROM (SELECT *, sum(c) OVER w AS n, sum(m) OVER w AS sm FROM lo WINDOW w AS (PARTITION BY a))),
nl AS (SELECT no, CASE WHEN {draw("no", "0")} >= {half} THEN {NULL_LENGTHS[1]} ELSE {NULL_LENGTHS[0]} END AS len FROM (SELECT unnest(range({NULLS})) AS no)),
ni AS (SELECT no, len, i, {draw("no", "i")} AS h FROM (SELECT *, unnest(range(1, len + 1)) AS i FROM nl)),
np AS (SELECT no, string_agg({letter}, '' ORDER BY i) AS ep FROM ni GROUP BY no),
q AS (SELECT 'q' AS of, ep, row_number() OVER () AS no FROM (SELECT DISTINCT upper(w) AS ep FROM (SELECT unnest(string_split_regex(text, '[^A-Za-z]+')) AS w FROM benchmark) WHERE length(w) BETWEEN {LENGTHS[0]} AND {m})),
x AS (SELECT of, no, ep, length(ep) AS len FROM q UNION ALL SELECT 'n', no, ep, length(ep) FROM np),
xj AS (SELECT *, CASE WHEN j > 0 THEN j ELSE len + j + 1 END AS pl FROM (SELECT *, unnest({array}) AS j FROM x)),
xf AS (SELECT *, substr(ep, pl::INT, 1) AS r FROM xj QUALIFY row_number() OVER (PARTITION BY of, no, pl ORDER BY list_position({array}, j)) = 1),
z AS (SELECT xf.of, xf.no, s.a, any_value(xf.len) AS len, sum(ln((coalesce(theta.p, 0) + {M.EPS}) / (coalesce(b.b, 0) + {M.EPS}))) AS z
  FROM xf JOIN s ON true LEFT JOIN b ON b.j = xf.j AND b.r = xf.r LEFT JOIN own ON own.j = xf.j AND own.len = xf.len AND own.a = s.a
  LEFT JOIN theta ON theta.j = xf.j AND theta.a = s.a AND theta.r = xf.r AND theta.len = CASE WHEN own.a IS NULL THEN 0 ELSE xf.len END GROUP BY xf.of, xf.no, s.a),
h2 AS (SELECT of, no, sum({value}) AS g FROM (SELECT of, no, unnest(string_split(ep, '')) AS r FROM x) GROUP BY of, no),
y AS (SELECT z.of, z.no, z.a, round(z + ln((coalesce(p, 0) + {M.EPS}) / (1.0 / {n} + {M.EPS})), 6) AS z, g FROM z JOIN h2 USING (of, no) LEFT JOIN lp ON lp.a = z.a AND lp.len = z.len),
r1 AS (SELECT y.of, y.no, y.a, 100.0 * count(*) FILTER (o.z > y.z) / {NULLS} AS p1, 100.0 * count(*) FILTER (o.g > y.g) / {NULLS} AS p2 FROM y JOIN y o ON o.of = 'n' AND o.a = y.a GROUP BY ALL),
r2 AS (SELECT *, round(-ln(greatest(p1, {scorer.FLOOR}::DOUBLE)) - ln(greatest(p2, {scorer.FLOOR}::DOUBLE)), 9) AS f FROM r1),
r3 AS (SELECT u.no, u.a, any_value(u.p1) AS p1, any_value(u.p2) AS p2, 100.0 * count(*) FILTER (o.f > u.f) / {NULLS} AS p3 FROM r2 u JOIN r2 o ON o.of = 'n' AND o.a = u.a WHERE u.of = 'q' GROUP BY u.no, u.a)
SELECT ep AS pep, a AS allele, round(CAST(p1 AS DOUBLE), 6) AS presentation_rank, round(CAST(p2 AS DOUBLE), 6) AS affinity_rank, round(CAST(p3 AS DOUBLE), 6) AS binder_rank,
  CASE WHEN p3 <= 0.5 THEN 'strong' WHEN p3 <= 2 THEN 'weak' ELSE 'none' END AS band FROM r3 JOIN q USING (no)"""


QUERIES = {f.__name__: f for f in (anchor_distributions, anchor_scores, binder_scores)}
ORACLE_SQL = {"anchor_distributions": f"WITH {_theta()} SELECT j AS anchor, len::INTEGER AS length, a AS allele, r AS residue, round(p, 9) AS p FROM theta", "anchor_scores": _scores(), "binder_scores": _binders()}
