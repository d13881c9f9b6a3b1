"""URL filters: host suffixes and path prefixes, joined on short hash prefixes and confirmed by full digests.

A rule is a host, a path and a verdict. It fits a URL whose host is the rule's or a subdomain of it and whose path starts
with the rule's path. Each distinct pair of host and path is expanded into expressions, a suffix of the host followed by a
prefix of the path, as many as the shapes of the rules ask for (numbers of labels, lengths of paths). The first bytes of
their digests meet the rules in an equi-join; what meets there is confirmed by the full digest, and by host and path
themselves. Of the rules that fit, the longest wins (characters of host and path together), then the one with the longer host,
then a blocking one. Where no rule fits, the verdict is the default: a list blocks only what it names.

Only the shapes of the rules come to the driver: the largest number of labels and the distinct lengths of paths. The rules
themselves are joined, and Spark chooses how by their size. Pairs of host and path are made distinct before they are
expanded, and the verdicts are a table of their own before pages are joined to them, so that adaptive execution can split a
URL that a third of the pages have.

Cases: a null URL, and one without "://", has an empty host and path, which no rule with a host fits; repeated rows each get
their verdict; null ids stay; no rules, or no pages, give the defaults, or nothing; a long URL is read whole; extra columns are
never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import stored

#: Fixed values, the contract's: host, path, verdict.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Bytes of a digest that are joined on; verdict where no rule fits.
SHORT, DEFAULT = 4, "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ://, null without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """Up to the first slash, question or number sign, A-Z in lower case; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host to the first question or number sign; empty without ://."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def labels_of(host: Column) -> Column:
    return F.size(F.split(host, r"\.", -1))


def suffix(host: Column, labels: Column) -> Column:
    """The last so many labels of a host that has them."""
    return F.call_function("substring_index", host, F.lit("."), -labels)


def digest(host: Column, path: Column) -> Column:
    return F.unhex(F.sha2(F.concat(host, path), 256))


def shortened(found: Column) -> Column:
    return F.substring(found, 1, SHORT)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def expanded(urls: DataFrame, labels: int, lengths: list[int]) -> DataFrame:
    """urls (host, path) once for each distinct short digest of an expression, as column short."""
    host, path = F.col("host"), F.col("path")
    suffixes = F.transform(F.filter(F.array(*(F.lit(k) for k in range(1, labels + 1))), lambda k: k <= labels_of(host)), lambda k: suffix(host, k))
    lefts = F.transform(F.filter(F.array(*(F.lit(n) for n in lengths)), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    shorts = F.flatten(F.transform(suffixes, lambda s: F.transform(lefts, lambda p: shortened(digest(s, p)))))
    return urls.select("host", "path", F.explode(F.array_distinct(shorts)).alias("short"))


def verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule, verdict of each distinct row of urls (host, path) that some rule fits; rules: host, path, verdict."""
    r = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
    shape = r.agg(F.max(labels_of(F.col("host"))).alias("labels"), F.sort_array(F.collect_set(F.length("path"))).alias("lengths")).first()
    r = r.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"), labels_of(F.col("host")).alias("r_labels"), digest(F.col("host"), F.col("path")).alias("r_digest"))
    r = r.withColumn("short", shortened(F.col("r_digest")))
    if not shape.labels:
        return r.limit(0).select(F.col("r_host").alias("host"), F.col("r_path").alias("path"), F.lit("").alias("rule"), F.col("r_verdict").alias("verdict"))
    met = expanded(urls.distinct(), shape.labels, shape.lengths).join(r, "short")
    own_host, own_path = suffix(F.col("host"), F.col("r_labels")), F.substring(F.col("path"), F.lit(1), F.length("r_path"))
    fits = met.where((digest(own_host, own_path) == F.col("r_digest")) & (own_host == F.col("r_host")) & (own_path == F.col("r_path")))
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("length"), F.length("r_host").alias("host"), (F.col("r_verdict") == "block").alias("block"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))
    return fits.groupBy("host", "path").agg(F.max(rank).alias("m")).select("host", "path", "m.rule", "m.verdict")


def judge(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """id, host, path, rule (null where none fits), verdict of every row."""
    rows = pages.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    found = stored(verdicts(rows.select("host", "path"), rules), "url_verdicts")
    out = rows.join(found.hint("merge"), ["host", "path"], "left")  # as files they are far smaller than in memory, so Spark would broadcast too many
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark))


def _oracle() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return f"""
WITH s AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
r AS (SELECT * FROM (VALUES {rules}) v(rh, rp, rv)),
f AS (SELECT n, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
  FROM u JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY n)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(rv, '{DEFAULT}') AS verdict FROM u LEFT JOIN f USING (n)"""


QUERIES = {"op11_url_filter": op11_url_filter}
ORACLE_SQL = {"op11_url_filter": _oracle()}
