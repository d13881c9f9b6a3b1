"""Queries of heads, channels and sources over all words of the texts. Weights and scales are made by a rule: they test operators, not biology."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import sequences as S
from seqloom.operators import immunity, neighbours
from seqloom.plans.word_queries import _read, _w, _words

R = S.RESIDUES
SCALE = {r: i / 19.0 for i, r in enumerate(R)}
WEIGHTS = {"anchor": {r: (i % 7 - 3) / 10.0 for i, r in enumerate(R)}, "tcrface": {r: (i % 5 - 2) / 10.0 for i, r in enumerate(R)}}
PRIOR = 0.03
_LETTERS = "list_transform(string_split(pep, ''), lambda c, i: {r: CAST(instr('" + R + "', c) - 1 AS INT), a: i <= 3 OR i >= length(pep) - 1})"


def face_heads(spark, sf_dir):
    """Of every word of standard residues the mean burial of its face, sums of a scale by role, the likelihood ratio and its probability at a prior."""
    p = _words(spark, sf_dir, "documents", 8).where(S.is_standard("pep"))
    out = p.select("pep", immunity.burial("pep", SCALE).alias("burial"), *immunity.scale_design("pep", {"scale": SCALE}), immunity.llr("pep", WEIGHTS).alias("llr"))
    out = out.withColumn("posterior", immunity.posterior("llr", PRIOR))
    return out.select("pep", *(F.round(c, 9).alias(c) for c in out.columns[1:]))


_HEADS = f"""WITH p AS (SELECT pep, {_LETTERS} AS l FROM {_w("documents", 8)} WHERE regexp_full_match(pep, '[{R}]+')),
s AS (SELECT pep, list_sum(list_transform(list_filter(l, lambda x: NOT x.a), lambda x: x.r / 19.0::DOUBLE)) AS t, coalesce(list_sum(list_transform(list_filter(l, lambda x: x.a), lambda x: x.r / 19.0::DOUBLE)), 0) AS a, len(list_filter(l, lambda x: NOT x.a)) AS n,
list_sum(list_transform(l, lambda x: CASE WHEN x.a THEN x.r % 7 - 3 ELSE x.r % 5 - 2 END)) / 10.0::DOUBLE AS z FROM p)
SELECT pep, round(t / n, 9) AS burial, round(a, 9) AS scale_anchor, round(t, 9) AS scale_tcr, round(a + t, 9) AS scale_all, round(z, 9) AS llr, round(1 / (1 + exp(-(z + ln({PRIOR}::DOUBLE / (1 - {PRIOR}::DOUBLE))))), 9) AS posterior FROM s"""


def channel_search(spark, sf_dir):
    """Benchmark words by groove and by face against the documents' words of each language: hits within a substitution, by a million projections, and the nearest."""
    refs = _words(spark, sf_dir, "documents", 8, "lang").select(F.col("lang").alias("component"), "pep", F.col("lang").alias("source"))
    found = immunity.channel_search(_words(spark, sf_dir, "benchmark", 8), immunity.channel_references(refs), {"anchor": 1, "tcr": 1})
    return found.select("pep", "component", "channel", F.col("n").cast("bigint").alias("n"), F.round("density", 9).alias("density"), F.coalesce("subs", F.lit(2)).cast("bigint").alias("subs"), "mimic")


_KEYS = "SELECT *, 'anchor' AS channel, substr(pep, 1, 3) || right(pep, 2) AS k FROM {0} UNION ALL SELECT *, 'tcr', substr(pep, 4, length(pep) - 5) FROM {0}"
_CHANNELS = f"""WITH q0 AS (SELECT pep FROM {_w("benchmark", 8)} WHERE regexp_full_match(pep, '[{R}]+')), r0 AS (SELECT lang, pep FROM {_w("documents", 8, "lang,")} WHERE regexp_full_match(pep, '[{R}]+')),
q AS ({_KEYS.format("q0")}), r AS (SELECT lang, channel, length(pep) AS n, k, min(pep) AS mimic FROM ({_KEYS.format("r0")}) GROUP BY ALL),
t AS (SELECT lang, channel, n, count(*) AS w FROM r GROUP BY ALL),
h AS (SELECT q.pep, r.lang, q.channel, hamming(q.k, r.k) AS d, mimic FROM q JOIN r ON q.channel = r.channel AND length(q.pep) = r.n WHERE hamming(q.k, r.k) <= 1),
b AS (SELECT pep, lang, channel, count(*) AS hits, min(d) AS subs, arg_min(mimic, (d, mimic)) AS mimic FROM h GROUP BY ALL)
SELECT q.pep, t.lang AS component, q.channel, coalesce(hits, 0) AS n, round(ln(1 + 1e6 * coalesce(hits, 0) / w), 9) AS density, CAST(coalesce(subs, 2) AS BIGINT) AS subs, mimic
FROM q JOIN t ON q.channel = t.channel AND length(q.pep) = t.n LEFT JOIN b ON b.pep = q.pep AND b.lang = t.lang AND b.channel = q.channel"""


def word_sources(spark, sf_dir):
    """Every place of the benchmark within a substitution of its own words of standard residues, with what differs there."""
    words = _words(spark, sf_dir, "benchmark", 10).where(S.is_standard("pep"))
    proteins = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("name"), S.letters("text").alias("seq"))
    found = neighbours.find_sources(words, proteins, 1)
    text = F.array_join(F.transform("mutations", lambda m: F.concat(m["query"], m["at"].cast("string"), m["window"])), ";")
    return found.select("query", "name", F.col("offset").cast("bigint").alias("offset"), "window", F.col("n_subs").cast("bigint").alias("n_subs"), text.alias("mutations"))


_SOURCES = f"""WITH q AS (SELECT pep FROM {_w("benchmark", 10)} WHERE regexp_full_match(pep, '[{R}]+')),
t AS (SELECT item_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM benchmark),
c AS (SELECT item_id, k, o, substr(seq, CAST(o AS INT) + 1, CAST(k AS INT)) AS w FROM (SELECT item_id, seq, k, unnest(range(0, length(seq) - k + 1)) AS o FROM t, (SELECT DISTINCT length(pep) AS k FROM q) WHERE length(seq) >= k)),
d AS (SELECT DISTINCT w FROM c WHERE regexp_full_match(w, '[{R}]+')), h AS (SELECT pep, w, hamming(pep, w) AS n FROM q JOIN d ON length(pep) = length(w) WHERE hamming(pep, w) <= 1)
SELECT pep AS query, item_id AS name, o AS "offset", w AS "window", CAST(n AS BIGINT) AS n_subs,
array_to_string(list_transform(list_filter(range(0, length(pep)), lambda i: substr(pep, CAST(i AS INT) + 1, 1) <> substr(w, CAST(i AS INT) + 1, 1)), lambda i: substr(pep, CAST(i AS INT) + 1, 1) || i || substr(w, CAST(i AS INT) + 1, 1)), ';') AS mutations FROM h JOIN c USING (w)"""

QUERIES = {f.__name__: f for f in (face_heads, channel_search, word_sources)}
ORACLE_SQL = {"face_heads": _HEADS, "channel_search": _CHANNELS, "word_sources": _SOURCES}
