"""Queries over the relational tables: ranks, false discovery, coverage, fronts, stop rules, linear scores, joins of intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import scoring
from seqloom.operators import calibration, cassette, counts, portfolio, ranking

MODEL = (
    {"feature": "balance", "coef": 0.5, "mu": 4500.0, "sigma": 3000.0},
    {"feature": "spent", "coef": 0.3, "mu": 1500000.0, "sigma": 900000.0},
    {"feature": "orders", "coef": -0.2, "mu": 10.0, "sigma": 5.0},
)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def percent_rank(spark, sf_dir):
    """Percent rank of every customer's balance within the market segment, and its band."""
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.col("c_acctbal").alias("score"))
    r = calibration.percent_rank(c, c, ["c_mktsegment"])
    return r.select("c_custkey", F.round("pct_rank", 6).alias("pct_rank"), calibration.band("pct_rank").alias("band"))


_PCT = """WITH n AS (SELECT c_mktsegment, c_acctbal, count(*) AS m FROM customer GROUP BY ALL),
r AS (SELECT c_mktsegment, c_acctbal, 100.0 * coalesce(sum(m) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(m) OVER (PARTITION BY c_mktsegment) AS p FROM n)
SELECT c_custkey, round(CAST(p AS DOUBLE), 6) AS pct_rank, CASE WHEN p <= 0.5 THEN 'strong' WHEN p <= 2 THEN 'weak' ELSE 'none' END AS band FROM customer JOIN r USING (c_mktsegment, c_acctbal)"""


def false_discovery(spark, sf_dir):
    """Benjamini-Hochberg over part sizes and prices read as p-values."""
    p = _read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 50.0 * F.col("p_partkey") / 100000.0).alias("p"))
    return calibration.bh_cut(p, "p", 0.05).select("p_partkey", F.round("bh_cut", 9).alias("bh_cut"), "significant")


_BH = """WITH p AS (SELECT p_partkey, p_size / 50.0::DOUBLE * p_partkey / 100000.0::DOUBLE AS p FROM part),
r AS (SELECT p, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS r, count(*) OVER () AS m FROM p),
c AS (SELECT coalesce(max(p) FILTER (p <= r / m::DOUBLE * 0.05), 0.0) AS cut FROM r)
SELECT p_partkey, round(cut, 9) AS bh_cut, p <= cut AND cut > 0 AS significant FROM p, c"""


def mutual_information(spark, sf_dir):
    return counts.mutual_information(_read(spark, sf_dir, "part"), "p_brand", "p_type").select(F.round("mi", 6).alias("mi"))


_MI = """WITH j AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL), t AS (SELECT sum(n) AS t FROM j)
SELECT round(CAST(sum(n / t * log2(n * t / (nx * ny))) AS DOUBLE), 6) AS mi FROM (SELECT j.*, t.t::DOUBLE AS t, CAST(sum(n) OVER (PARTITION BY p_brand) AS DOUBLE) AS nx, CAST(sum(n) OVER (PARTITION BY p_type) AS DOUBLE) AS ny FROM j, t)"""


def kernel_shrink(spark, sf_dir):
    """Shares of order priorities by nation, drawn towards those of nations of the same region."""
    n = _read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    o = _read(spark, sf_dir, "orders").join(_read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    prefs = o.groupBy(F.col("c_nationkey").alias("allele"), F.col("o_orderpriority").alias("residue")).agg(F.count("*").cast("double").alias("cnt")).withColumn("anchor", F.lit(1))
    m = n.select(F.col("n_nationkey").alias("other"), F.col("n_regionkey").alias("_r"))
    kernel = n.join(m, F.col("n_regionkey") == F.col("_r")).select(F.col("n_nationkey").alias("allele"), "other", F.when(F.col("n_nationkey") == F.col("other"), 1.0).otherwise(0.25).alias("k"))
    return counts.shrink(prefs, kernel, 25.0).select("allele", "residue", F.round("p", 6).alias("p"))


_SHRINK = """WITH c AS (SELECT c_nationkey AS allele, o_orderpriority AS residue, CAST(count(*) AS DOUBLE) AS cnt FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
k AS (SELECT a.n_nationkey AS allele, b.n_nationkey AS other, CASE WHEN a.n_nationkey = b.n_nationkey THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS k FROM nation a JOIN nation b USING (n_regionkey)),
m AS (SELECT k.allele, residue, sum(k * cnt) AS m FROM k JOIN c ON k.other = c.allele GROUP BY ALL),
q AS (SELECT *, m / sum(m) OVER (PARTITION BY allele) AS mm FROM m), s AS (SELECT allele, sum(cnt) AS n FROM c GROUP BY allele)
SELECT q.allele, q.residue, round((n * coalesce(c.cnt / n, 0) + 25.0::DOUBLE * mm) / (n + 25.0::DOUBLE), 6) AS p FROM q JOIN s USING (allele) LEFT JOIN c USING (allele, residue)"""


def coverage(spark, sf_dir):
    """How evenly parts cover the brands."""
    p = _read(spark, sf_dir, "part").select(F.col("p_brand").alias("label"))
    return counts.coverage(p, p, "label").select("n_labels", "n_covered", F.round("gini", 6).alias("gini"), F.round("entropy_ratio", 6).alias("entropy_ratio"))


_COV = """WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand), r AS (SELECT n, row_number() OVER (ORDER BY n, p_brand) AS r FROM c),
s AS (SELECT count(*) AS m, sum(n)::DOUBLE AS t, sum(r * n)::DOUBLE AS w, sum(n * ln(n)) AS l FROM r)
SELECT m AS n_labels, m AS n_covered, round(2 * w / (m * t) - (m + 1) / m::DOUBLE, 6) AS gini, round((ln(t) - l / t) / ln(m), 6) AS entropy_ratio FROM s"""


def dispersion(spark, sf_dir):
    """Dispersion of the share of urgent orders over customers."""
    o = _read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("m"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("k"))
    return counts.dispersion(o, "m", "k").select(*(F.round(c, 9).alias(c) for c in ("p", "variance", "binomial_variance", "ratio")))


_DISP = """WITH o AS (SELECT o_custkey, count(*) AS m, count(*) FILTER (o_orderpriority LIKE '1%') AS k FROM orders GROUP BY o_custkey),
a AS (SELECT sum(k)::DOUBLE / sum(m) AS p, var_samp(k / m::DOUBLE) AS v, avg(1 / m::DOUBLE) AS i FROM o)
SELECT round(p, 9) AS p, round(v, 9) AS variance, round(p * (1 - p) * i, 9) AS binomial_variance, round(v / (p * (1 - p) * i), 9) AS ratio FROM a"""


def pareto_front(spark, sf_dir):
    """Parts of which no other is larger and cheaper."""
    p = _read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), (-F.col("p_retailprice")).alias("cheap"))
    return portfolio.pareto_front(p, ["size", "cheap"])


_PARETO = """WITH p AS (SELECT p_partkey, p_size::DOUBLE AS size, -p_retailprice AS cheap FROM part)
SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.size >= a.size AND b.cheap >= a.cheap AND (b.size > a.size OR b.cheap > a.cheap))"""


def pareto_three(spark, sf_dir):
    """Suppliers' front in balance, low key and nation, by cells of quantiles."""
    s = _read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("a"), (-F.col("s_suppkey")).cast("double").alias("b"), F.col("s_nationkey").cast("double").alias("c"))
    return portfolio.pareto_front(s, ["a", "b", "c"])


_PARETO3 = """WITH p AS (SELECT s_suppkey, s_acctbal AS a, (-s_suppkey)::DOUBLE AS b, s_nationkey::DOUBLE AS c FROM supplier)
SELECT * FROM p x WHERE NOT EXISTS (SELECT 1 FROM p y WHERE y.a >= x.a AND y.b >= x.b AND y.c >= x.c AND (y.a > x.a OR y.b > x.b OR y.c > x.c))"""


def crowding(spark, sf_dir):
    p = _read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    c = portfolio.crowding(p, ["p_retailprice"], "p_partkey", ["p_brand"])
    return c.select("p_partkey", F.when(F.col("crowding") == float("inf"), -1.0).otherwise(F.round("crowding", 9)).alias("crowding"))


_CROWD = """WITH w AS (SELECT p_partkey, lag(p_retailprice) OVER b AS l, lead(p_retailprice) OVER b AS r, max(p_retailprice) OVER (PARTITION BY p_brand) - min(p_retailprice) OVER (PARTITION BY p_brand) AS span FROM part WINDOW b AS (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey))
SELECT p_partkey, CASE WHEN l IS NULL OR r IS NULL THEN -1.0::DOUBLE WHEN span = 0 THEN 0.0::DOUBLE ELSE round((r - l) / span, 9) END AS crowding FROM w"""


def corner(spark, sf_dir):
    p = _read(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return portfolio.corner(p, ["size", "price"], "p_partkey", ["p_brand"]).select("p_partkey", "corner")


_CORNER = """WITH r AS (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS a, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS b FROM part)
SELECT p_partkey, CASE WHEN a >= b THEN 'size' ELSE 'price' END AS corner FROM r"""


def chebyshev(spark, sf_dir):
    p = _read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return portfolio.chebyshev(p, {"size": 1.0, "price": 0.05}).select("p_partkey", F.round("chebyshev", 6).alias("chebyshev"))


_CHEB = """WITH i AS (SELECT max(p_size)::DOUBLE AS a, max(p_retailprice) AS b FROM part)
SELECT p_partkey, round(greatest(a - p_size, (b - p_retailprice) * 0.05::DOUBLE) + 0.05::DOUBLE * ((a - p_size) + (b - p_retailprice) * 0.05::DOUBLE), 6) AS chebyshev FROM part, i"""


def select_saturating(spark, sf_dir):
    """Customers that the saturating stop rule keeps in each nation, balance scaled to a probability."""
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.greatest(F.lit(0.0), F.col("c_acctbal") / 10000.0).alias("p"))
    return portfolio.select_saturating(c, "p", "c_nationkey", "c_custkey", 4.0).select("c_custkey", "c_nationkey", F.round("p", 6).alias("p"))


_STOP = """WITH c AS (SELECT c_custkey, c_nationkey, greatest(0.0::DOUBLE, c_acctbal / 10000.0::DOUBLE) AS p FROM customer),
b AS (SELECT *, coalesce(sum(p) OVER w, 0) / (4.0::DOUBLE + count(*) OVER w) AS bar FROM c WINDOW w AS (PARTITION BY c_nationkey ORDER BY p DESC, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, min(CASE WHEN p > bar THEN 1 ELSE 0 END) OVER (PARTITION BY c_nationkey ORDER BY p DESC, c_custkey ROWS UNBOUNDED PRECEDING) AS ok FROM b)
SELECT c_custkey, c_nationkey, round(p, 6) AS p FROM o WHERE ok = 1"""


def selection_yield(spark, sf_dir):
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.greatest(F.lit(0.0), F.col("c_acctbal") / 10000.0).alias("p"))
    kept = portfolio.select_saturating(c, "p", "c_nationkey", "c_custkey", 4.0)
    return portfolio.expected_yield(kept, "p", "c_nationkey", 4.0).select("c_nationkey", "n", F.round("expected", 4).alias("expected"))


_YIELD = f"SELECT c_nationkey, count(*) AS n, round(4.0::DOUBLE * sum(q) / (4.0::DOUBLE + count(*)), 4) AS expected FROM (SELECT k.c_nationkey, greatest(0.0::DOUBLE, c_acctbal / 10000.0::DOUBLE) AS q FROM ({_STOP}) k JOIN customer USING (c_custkey)) GROUP BY c_nationkey"


def at_least_one(spark, sf_dir):
    """P(at least one) over customers of a nation, market segments as blocks that work with probability 0.8."""
    c = _read(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", (F.greatest(F.lit(0.0), F.col("c_acctbal")) / 1e6).alias("p"))
    return portfolio.at_least_one(c, "p", "c_mktsegment", 0.8, ["c_nationkey"]).select("c_nationkey", F.round("p_ge1", 9).alias("p_ge1"))


_ONE = """WITH b AS (SELECT c_nationkey, c_mktsegment, product(1 - greatest(0.0::DOUBLE, c_acctbal) / 1e6 / 0.8::DOUBLE) AS none FROM customer GROUP BY ALL)
SELECT c_nationkey, round(1 - product(1 - 0.8::DOUBLE + 0.8::DOUBLE * none), 9) AS p_ge1 FROM b GROUP BY c_nationkey"""


def survival(spark, sf_dir):
    """P(at least k) of the customers of each nation, for k from 0 to their number; a convolution, tested by enumeration."""
    c = _read(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", (F.greatest(F.lit(0.0), F.col("c_acctbal")) / 1e6).alias("p"))
    return portfolio.survival(c, "p", "c_mktsegment", 0.8, ["c_nationkey"]).select("c_nationkey", F.col("k").cast("bigint").alias("k"), F.round("p_ge_k", 9).alias("p_ge_k"))


def linear_score(spark, sf_dir):
    """A standardised linear score of every customer; those without orders have imputed features, which are named."""
    o = _read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spent"), F.count("*").cast("double").alias("orders"))
    c = _read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("balance")).join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return scoring.linear(c, MODEL, intercept=-0.5).select("c_custkey", F.round("score", 6).alias("score"), "imputed")


_LIN = """WITH o AS (SELECT o_custkey, sum(o_totalprice) AS spent, count(*)::DOUBLE AS orders FROM orders GROUP BY o_custkey)
SELECT c_custkey, round(-0.5::DOUBLE + coalesce((c_acctbal - 4500.0::DOUBLE) / 3000.0::DOUBLE, 0) * 0.5::DOUBLE + coalesce((spent - 1500000.0::DOUBLE) / 900000.0::DOUBLE, 0) * 0.3::DOUBLE + coalesce((orders - 10.0::DOUBLE) / 5.0::DOUBLE, 0) * -0.2::DOUBLE, 6) AS score,
 CASE WHEN spent IS NULL THEN 'spent;orders' ELSE '' END AS imputed FROM customer LEFT JOIN o ON c_custkey = o_custkey"""


def combined_scores(spark, sf_dir):
    """Affinities, occupancy, Fisher's sum and the gate of every order line, quantity and price read as affinities in nM."""
    line = _read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), F.col("l_quantity").alias("m"), F.col("l_extendedprice").alias("w"), (F.col("l_discount") + 0.01).alias("p1"), (F.col("l_tax") + 0.01).alias("p2"))
    r = lambda c, n: F.round(c, 6).alias(n)
    return line.select("l_orderkey", "l_linenumber", r(scoring.affinity_to_unit("m"), "unit"), r(scoring.amplitude("w", "m"), "amplitude"), r(scoring.occupancy_gain("m", "w"), "gain"), r(scoring.fisher("p1", "p2"), "fisher"), r(scoring.gate("p1", "p2", 2.0, -0.1, 3.0, -0.2), "gate"))


_COMB = """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber,
 round(1 - ln(least(greatest(l_quantity, 0.001::DOUBLE), 50000.0::DOUBLE)) / ln(50000.0::DOUBLE), 6) AS unit,
 round(l_extendedprice / l_quantity / (1 + l_extendedprice / 3687.0::DOUBLE), 6) AS amplitude,
 round(10.0::DOUBLE / l_quantity / (1 + 10.0::DOUBLE / l_quantity) - 10.0::DOUBLE / l_extendedprice / (1 + 10.0::DOUBLE / l_extendedprice), 6) AS gain,
 round(-ln(l_discount + 0.01::DOUBLE) - ln(l_tax + 0.01::DOUBLE), 6) AS fisher,
 round(1 / (1 + exp(-(2.0::DOUBLE * (l_discount + 0.01::DOUBLE) - 0.1::DOUBLE))) * (1 / (1 + exp(-(3.0::DOUBLE * (l_tax + 0.01::DOUBLE) - 0.2::DOUBLE)))), 6) AS gate FROM lineitem"""


def known_priority(spark, sf_dir):
    """Each document's known set of the best priority; toxic documents are no members of the good set."""
    labels = _read(spark, sf_dir, "labels")
    sets = labels.where("toxic = 1").select("doc_id", F.lit("toxic").alias("set"), F.lit(1).alias("priority")).unionByName(labels.where("quality = 1").join(labels.where("toxic = 1").select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit("good").alias("set"), F.lit(2).alias("priority")))
    return ranking.known_set(_read(spark, sf_dir, "documents").select("doc_id"), sets, "doc_id")


_KNOWN = "SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' END AS known FROM documents LEFT JOIN labels USING (doc_id)"


def impute_flag(spark, sf_dir):
    """Line prices above 40 units filled from the part's price, and flagged."""
    line = _read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_partkey", F.when(F.col("l_quantity") <= 40, F.col("l_extendedprice")).alias("price"))
    both = line.join(_read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice"), "l_partkey", "left")
    return ranking.impute(both, "price", "p_retailprice").select("l_orderkey", "l_linenumber", "price", F.col("price_missing").cast("bigint").alias("price_missing"))


_IMP = "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_quantity <= 40 THEN l_extendedprice ELSE p_retailprice END AS price, CASE WHEN l_quantity <= 40 THEN 0 ELSE 1 END::BIGINT AS price_missing FROM lineitem LEFT JOIN part ON l_partkey = p_partkey"


def interval_overlap(spark, sf_dir):
    """Pairs of purchase and click intervals of one user that overlap, an interval being the event's number and 200 after it."""
    e = _read(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("id"), F.col("event_id").alias("start"), (F.col("event_id") + 200).alias("end"))
    return cassette.overlaps(e.where("event_type = 'purchase'"), e.where("event_type = 'click'"), width=256, keys=["user_id"])


_OVER = "SELECT a.user_id, a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id <= b.event_id + 200 AND b.event_id <= a.event_id + 200 WHERE a.event_type = 'purchase' AND b.event_type = 'click'"


def dense_tiers(spark, sf_dir):
    """Dense rank of order totals within status; priority orders the listing."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    return ranking.dense_tiers(o, "o_totalprice", "o_orderpriority", ["o_orderstatus"]).select("o_orderkey", F.col("rank").cast("bigint").alias("rank"))


_TIERS = "SELECT o_orderkey, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC) AS rank FROM orders"


def best_priority(spark, sf_dir):
    """The cheapest order's priority of each customer, and priorities with an order of at most 50000."""
    o = _read(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_totalprice").alias("r"))
    return ranking.best_group(o, ["o_custkey"], "o_orderpriority", "r", 50000.0)


_BEST = """WITH o AS (SELECT o_custkey, o_orderpriority, min(o_totalprice) AS r FROM orders GROUP BY ALL)
SELECT o_custkey, arg_min(o_orderpriority, (r, o_orderpriority)) AS best, min(r) AS best_rank, count(*) FILTER (r <= 50000) AS n_presenting, coalesce(string_agg(o_orderpriority, ';' ORDER BY o_orderpriority) FILTER (r <= 50000), '') AS presenting FROM o GROUP BY o_custkey"""


def neighbourhood_score(spark, sf_dir):
    """Z / (1 + Z) from orders at three distances, customers' open, finished and other orders read as neighbours."""
    o = _read(spark, sf_dir, "orders").groupBy("o_custkey").agg(*(F.count_if(F.col("o_orderstatus") == s).alias(f"n{i}") for i, s in enumerate("FOP")))
    return o.select("o_custkey", F.round(scoring.recognition({0: "n0", 1: "n1", 2: "n2"}, F.lit(9), a0=9.0, k=0.8), 9).alias("r"))


_REC = """WITH o AS (SELECT o_custkey, sum(CASE o_orderstatus WHEN 'F' THEN exp(-0.8::DOUBLE * 0) WHEN 'O' THEN exp(-0.8::DOUBLE * 1) WHEN 'P' THEN exp(-0.8::DOUBLE * 2) ELSE 0 END) AS z FROM orders GROUP BY o_custkey)
SELECT o_custkey, round(z / (1 + z), 9) AS r FROM o"""


def isotonic_steps(spark, sf_dir):
    """Chance of good quality by length of a document, as steps in each language; sequential, tested by a quadratic fit."""
    d = _read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(_read(spark, sf_dir, "labels"), "doc_id")
    s = calibration.isotonic_steps(d, "n_chars", "quality", ["lang"])
    return s.select("lang", F.explode("steps").alias("s")).select("lang", F.col("s.x").alias("x"), F.round("s.y", 9).alias("y"))


def class_shares(spark, sf_dir):
    return counts.group_shares(_read(spark, sf_dir, "customer"), "c_mktsegment").select("c_mktsegment", "n", F.round("share", 9).alias("share"))


QUERIES = {f.__name__: f for f in (percent_rank, false_discovery, mutual_information, kernel_shrink, coverage, dispersion, pareto_front, pareto_three, crowding, corner, chebyshev, select_saturating, selection_yield, at_least_one, survival, linear_score, combined_scores, known_priority, impute_flag, interval_overlap, dense_tiers, best_priority, neighbourhood_score, isotonic_steps, class_shares)}
#: survival and isotonic_steps have no SQL form that is worth the name; tests hold them against plain versions.
ORACLE_SQL = {
    "percent_rank": _PCT, "false_discovery": _BH, "mutual_information": _MI, "kernel_shrink": _SHRINK, "coverage": _COV, "dispersion": _DISP, "pareto_front": _PARETO, "pareto_three": _PARETO3, "crowding": _CROWD,
    "corner": _CORNER, "chebyshev": _CHEB, "select_saturating": _STOP, "selection_yield": _YIELD, "at_least_one": _ONE, "linear_score": _LIN, "combined_scores": _COMB, "known_priority": _KNOWN, "impute_flag": _IMP,
    "interval_overlap": _OVER, "dense_tiers": _TIERS, "best_priority": _BEST, "neighbourhood_score": _REC,
    "class_shares": "SELECT c_mktsegment, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 9) AS share FROM customer GROUP BY c_mktsegment",
}
