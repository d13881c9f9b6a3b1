"""Queries of encodings over all words of the texts. Tables and scales are made by a rule: they test operators, not biology."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import sequences as S
from seqloom.operators import complement
from seqloom.plans.word_queries import _w, _words

R = S.RESIDUES
SCALE = {r: i / 19.0 for i, r in enumerate(R)}
ONE = {r: (i % 7 - 3) / 10.0 for i, r in enumerate(R)}
TWO = {a + b: (i * j % 5 - 2) / 10.0 for i, a in enumerate(R) for j, b in enumerate(R)}
#: of each class the zone and the length bin that a table is for
PARTS = {"mhc1": ("tcr_m", 9), "mhc2": ("cflank", 0)}


def receptor_encoding(spark, sf_dir):
    """Of every word, as class I and around a core in its middle as class II: tables by role, zone, length bin and pair, sums and mean of a scale, runs."""
    p = _words(spark, sf_dir, "documents", 9)
    out = None
    for cls, (zone, number) in PARTS.items():
        tables = {"anchors": ("anchor", ONE), "face": ("tcr", ONE), "zone": (zone, ONE), "binned": (f"tcr@{number}", ONE), "pairs": ("pair", TWO)}
        middle = F.floor((F.length("pep") - 9) / 2).cast("int")
        d = complement.design(p, "pep", tables, {"scale": SCALE}, runs=("scale", 0.6), means=["scale"], cls=cls, register=middle).withColumn("cls", F.lit(cls))
        out = d if out is None else out.unionByName(d)
    return out.select("pep", "cls", *(F.round(c, 9).alias(c) for c in out.columns if c not in ("pep", "cls")))


_ROLE1 = "CASE WHEN i < 3 OR i >= n - 2 THEN 'anchor' WHEN i - 3 < (n - 5) // 3 THEN 'n' WHEN i - 3 < 2 * (n - 5) // 3 THEN 'z' ELSE 'c' END"
_ROLE2 = "CASE WHEN i - s IN (0, 3, 5, 8) THEN 'anchor' WHEN i < s THEN 'n' WHEN i < s + 9 THEN 'c' ELSE 'z' END"
_SQL = f"""WITH p AS (SELECT pep, length(pep) AS n, (length(pep) - 9) // 2 AS s FROM {_w("documents", 9)}),
e AS (SELECT *, unnest(range(n)) AS i FROM p),
r AS (SELECT pep, n, i, 'mhc1' AS cls, {_ROLE1} AS role, n = 9 AS b FROM e UNION ALL SELECT pep, n, i, 'mhc2', {_ROLE2}, n < 14 FROM e),
l AS (SELECT *, instr('{R}', substr(pep, CAST(i AS INT) + 1, 1)) - 1 AS x FROM r),
m AS (SELECT *, role <> 'anchor' AS f, lead(x) OVER w AS y, lead(role) OVER w <> 'anchor' AS g FROM l WINDOW w AS (PARTITION BY pep, cls ORDER BY i)),
t AS (SELECT pep, cls, any_value(n) AS n, any_value(b) AS b, coalesce(sum(x % 7 - 3) FILTER (x >= 0 AND NOT f), 0) AS a, coalesce(sum(x % 7 - 3) FILTER (x >= 0 AND f), 0) AS c, coalesce(sum(x % 7 - 3) FILTER (x >= 0 AND role = 'z'), 0) AS z,
coalesce(sum(x * y % 5 - 2) FILTER (x >= 0 AND y >= 0 AND f AND g), 0) AS q, coalesce(sum(x) FILTER (x >= 0 AND NOT f), 0) AS sa, coalesce(sum(x) FILTER (x >= 0 AND f), 0) AS sf, count(*) FILTER (x >= 0 AND f) AS k, count(*) FILTER (f) AS w,
list_filter(string_split_regex(string_agg(CASE WHEN f AND x / 19.0::DOUBLE > 0.6 THEN '1' ELSE '0' END, '' ORDER BY i), '0+'), lambda v: v <> '') AS runs FROM m GROUP BY pep, cls)
SELECT pep, cls, n::DOUBLE AS length, round(a / 10.0::DOUBLE, 9) AS anchors, round(c / 10.0::DOUBLE, 9) AS face, round(z / 10.0::DOUBLE, 9) AS "zone", round(CASE WHEN b THEN c / 10.0::DOUBLE ELSE 0 END, 9) AS binned, round(q / 10.0::DOUBLE, 9) AS pairs,
round((sa + sf) / 19.0::DOUBLE, 9) AS scale_all, round(sa / 19.0::DOUBLE, 9) AS scale_anchor, round(sf / 19.0::DOUBLE, 9) AS scale_tcr, round(sf / 19.0::DOUBLE / greatest(k, 1), 9) AS scale_mean,
coalesce(list_max(list_transform(runs, lambda v: length(v))), 0)::DOUBLE AS run_max, len(runs)::DOUBLE AS run_n, round(coalesce(list_sum(list_transform(runs, lambda v: length(v))), 0)::DOUBLE / greatest(w, 1), 9) AS run_frac FROM t"""

QUERIES = {"receptor_encoding": receptor_encoding}
ORACLE_SQL = {"receptor_encoding": _SQL}
