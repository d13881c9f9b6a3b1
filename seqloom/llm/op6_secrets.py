"""Secret scans by corpus-wide ownership frequency, in DataFrame and SQL functions only.

Candidates of every kind are found in whole texts with their places in code points. Each candidate's value is hashed, and
the hashes are aggregated over the corpus by distinct repositories and owners. The owner is the source column; documents has
no column for repositories, so a document stands for one unless the caller names another column. A value that several owners
hold, and that several repositories hold, is a widely copied example; one that few owners hold, in however many repositories, looks like a
live credential. Candidates of the three base kinds always stay and are told apart; those of the further kinds count only
while they look live.

Values are pre-aggregated by owner and repository before they are shuffled by hash, and texts never cross a shuffle. Owner
counts are a table of their own before they are joined back by hash, so that adaptive execution can split a value that a
third of the rows hold. Patterns run only where a fixed part of them occurs, and none looks back over a long run of letters.

Cases: a null or empty text has no spans, and the digest of the empty string; repeated rows each get their own result; null and
empty owners count as one owner together, null and empty repositories as one repository; an empty table gives an empty result; a long text is scanned
whole, in time proportional to its length and its candidates; extra columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import documents, stored, text_or_empty

#: A value that this many owners hold, in as many repositories, is a copied example.
COPIED_OWNERS = 3
#: Matches whose lengths are summed one by one; whole blocks of them are summed first.
BLOCK = 64
#: Fixed values, the contract's: kind, pattern, group of the value, least length of the value.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 16),
    ("hex", r"([0-9a-f]{32,})", 1, 32),  # a run of [0-9a-f]+ of 32 or more characters
)
#: Further kinds that public services document: personal and chat tokens, signed tokens, private keys, passwords in addresses, mixed strings.
ADDED = (
    ("github", r"(gh[pousr]_[A-Za-z0-9]{36,})", 1, 36),
    ("slack", r"(xox[abprs]-[A-Za-z0-9-]{10,})", 1, 10),
    ("jwt", r"(eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})", 1, 32),
    ("pem", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1, 1),
    ("login", r"([a-z][a-z0-9+]{0,15}://[^\x00-\x20:/@]+:[^\x00-\x20:/@]{3,}@)", 1, 1),
    ("mixed", r"([A-Za-z0-9_+-]{24,})", 1, 24),
)
KINDS = (*BASE, *ADDED)
#: Strings of which every match of a kind has one.
PARTS = {"assign": (":", "="), "access": ("AKIA",), "github": ("gh",), "slack": ("xox",), "jwt": ("eyJ",), "pem": ("PRIVATE KEY-----",), "login": ("://",)}
#: A mixed string needs all of these.
MIXED = ("[0-9]", "[a-z]", "[A-Z]")


def found(text: Column, number: int) -> Column:
    """array<struct<start, end, number, value>> of one kind: leftmost matches that do not overlap, then those that are long enough."""
    name, pattern, group, least = KINDS[number]
    rx = F.lit(pattern)
    # the place of a match is what lies before it: the text between matches, and the matches
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("part"), F.regexp_extract_all(text, rx, F.lit(0)).alias("hit"), *([F.regexp_extract_all(text, rx, F.lit(group)).alias("value")] if group > 1 else []))
    rows = F.filter(rows, lambda x: x["hit"].isNotNull())

    def placed(rows: Column) -> Column:
        sums = F.transform(rows, lambda x: F.length(x["part"]) + F.length(x["hit"]))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / BLOCK).cast("int")), lambda k: F.struct(k.alias("k")))
        return F.transform(F.array(F.struct(rows.alias("rows"), sums.alias("sums"), blocks.alias("blocks"))), _starts)[0]

    def _starts(x: Column) -> Column:
        """Bound to a variable, so that nothing is computed again for each match."""
        total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, y: a + y)
        before = F.aggregate(
            x["blocks"],
            F.array(F.lit(0)),
            lambda acc, k: F.concat(acc, F.array(F.element_at(acc, -1) + total(F.slice(x["sums"], k["k"] * BLOCK + 1, F.lit(BLOCK))))),
        )
        return F.transform(F.array(F.struct(x.alias("x"), before.alias("before"))), _spans)[0]

    def _spans(z: Column) -> Column:
        x = z["x"]

        def one(r: Column, i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            start = F.get(z["before"], block) + F.aggregate(F.slice(x["sums"], block * BLOCK + 1, i % BLOCK), F.lit(0), lambda a, y: a + y) + F.length(r["part"])
            value = r["value"] if group > 1 else r["hit"]
            return F.struct(start.alias("start"), (start + F.length(r["hit"])).alias("end"), F.lit(number).alias("number"), value.alias("value"))

        return F.transform(x["rows"], one)

    good = F.filter(placed(rows), lambda s: F.length(s["value"]) >= least)
    if name == "mixed":
        good = F.filter(good, lambda s: s["value"].rlike(MIXED[0]) & s["value"].rlike(MIXED[1]) & s["value"].rlike(MIXED[2]))
    may = text.rlike(pattern)
    if name in PARTS:
        some = F.lit(False)
        for part in PARTS[name]:
            some = some | text.contains(part)
        may = some & may
    return F.when(may, good).otherwise(F.from_json(F.lit("[]"), "array<struct<start: int, end: int, number: int, value: string>>"))


def spelled(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas; spans: array<struct<start, number, end>>."""
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["number"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(number: int):
    return lambda s: s["number"] == number


def _bare(spans: Column, keep) -> Column:
    return F.transform(F.filter(spans, keep), lambda s: F.struct(s["start"].alias("start"), s["number"].alias("number"), s["end"].alias("end")))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str = "", copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, live (array of the spans that look live, start, number of the kind, end)."""
    text = F.col("_text")
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("_owner"), F.coalesce(F.col(repository_col or id_col).cast("string"), F.lit("")).alias("_repository"), text_or_empty(text_col).alias("_text"))
    spans = F.flatten(F.array(*(found(text, k) for k in range(len(KINDS)))))
    hashed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["number"].alias("number"), F.xxhash64(s["value"]).alias("hash"), F.crc32(s["value"]).alias("check")))
    rows = stored(rows.select(F.monotonically_increasing_id().alias("_row"), "_id", "_owner", "_repository", hashed.alias("_spans")), "candidates")
    base = _bare(F.col("_spans"), lambda s: s["number"] < len(BASE))
    counted = [F.size(F.filter("_spans", _of_kind(k))).cast("bigint").alias(f"n_{BASE[k][0]}") for k in range(len(BASE))]
    shape = "array<struct<start: int, number: int, end: int>>"
    empty = F.from_json(F.lit("[]"), shape)
    none = rows.where(F.size("_spans") == 0).select("_id", *counted, F.sha2(F.lit(""), 256).alias("base_sha256"), F.lit("").alias("spans"), F.lit(0).cast("bigint").alias("n_live"), F.lit(0).cast("bigint").alias("n_copied"), empty.alias("live"))
    some = rows.where(F.size("_spans") > 0).withColumn("_base", base)
    each = some.select("_row", "_owner", "_repository", F.explode("_spans").alias("s")).select("_row", "_owner", "_repository", "s.*")
    # owners and repositories of a value are made distinct apart from each other: a repository of three owners is one
    held = each.select("hash", "check", F.explode(F.array(F.struct(F.lit(True).alias("owner"), F.col("_owner").alias("name")), F.struct(F.lit(False).alias("owner"), F.col("_repository").alias("name")))).alias("h"))
    held = held.groupBy("hash", "check", "h").agg(F.lit(1).alias("one"))
    owners = stored(held.groupBy("hash", "check").agg(F.count_if(F.col("h.owner")).alias("owners"), F.count_if(~F.col("h.owner")).alias("repositories")), "owners")
    copied = (F.col("owners") >= copied_owners) & (F.col("repositories") >= copied_owners)
    told = each.join(owners, ["hash", "check"]).select("_row", F.struct("start", "number", "end").alias("span"), (~copied).alias("is_live"), (F.col("number") < len(BASE)).alias("is_base"))
    told = told.groupBy("_row").agg(
        F.collect_list(F.when(F.col("is_live") & ~F.col("is_base"), F.col("span"))).alias("_added"),
        F.collect_list(F.when(F.col("is_live"), F.col("span"))).alias("live"),
        F.count_if("is_live").alias("n_live"),
        F.count_if(~F.col("is_live")).alias("n_copied"),
    )
    some = some.select("_row", "_id", *counted, "_base").join(told, "_row").select("_id", *(f"n_{b[0]}" for b in BASE), F.sha2(spelled(F.col("_base")), 256).alias("base_sha256"), spelled(F.concat("_base", "_added")).alias("spans"), "n_live", "n_copied", F.array_sort("live").alias("live"))
    return none.unionByName(some).withColumnRenamed("_id", id_col)


def redacted(text: Column, spans: Column) -> Column:
    """text with each of the spans ("kind:start:end,…") replaced by the name of its kind; overlapping spans become one."""
    parts = F.transform(F.filter(F.split(spans, ","), lambda s: s != ""), lambda s: F.split(s, ":"))

    def step(acc: Column, s: Column) -> Column:
        start, end = s[1].cast("int"), s[2].cast("int")
        before = F.concat(F.substring(text, acc["at"] + 1, start - acc["at"]), F.lit("["), s[0], F.lit("]"))
        return F.struct(F.greatest(acc["at"], end).alias("at"), F.concat(acc["out"], F.when(start >= acc["at"], before).otherwise(F.lit(""))).alias("out"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir)).drop("live")


def _oracle() -> str:
    kinds = []
    for number, (name, pattern, group, least) in enumerate(KINDS):
        rx = pattern.replace("'", "''")
        more = "".join(f" AND regexp_matches(v, '{m}')" for m in MIXED) if name == "mixed" else ""
        kinds.append(f"""
SELECT row, source, {number} AS number, '{name}' AS kind, start, start + length(h) AS stop, v FROM (
  SELECT row, source, hits[i] AS h, vals[i] AS v,
    list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
    SELECT row, source, string_split_regex(t, '{rx}') AS parts, regexp_extract_all(t, '{rx}', 0) AS hits, regexp_extract_all(t, '{rx}', {group}) AS vals FROM d)))
WHERE length(v) >= {least}{more}""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS repository, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
c AS ({" UNION ALL ".join(kinds)}),
o AS (SELECT v, count(DISTINCT d.source) AS owners, count(DISTINCT repository) AS repositories FROM c JOIN d USING (row) GROUP BY v),
e AS (SELECT c.*, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS said, owners < {COPIED_OWNERS} OR repositories < {COPIED_OWNERS} AS is_live FROM c JOIN o USING (v)),
g AS (SELECT row,
  count(*) FILTER (number = 0) AS n_assign, count(*) FILTER (number = 1) AS n_access, count(*) FILTER (number = 2) AS n_hex,
  coalesce(string_agg(said, ',' ORDER BY start, number) FILTER (number < {len(BASE)}), '') AS base,
  coalesce(string_agg(said, ',' ORDER BY start, number) FILTER (number < {len(BASE)} OR is_live), '') AS spans,
  count(*) FILTER (is_live) AS n_live, count(*) FILTER (NOT is_live) AS n_copied FROM e GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN g USING (row)"""


QUERIES = {"op6_secret_scans": op6_secret_scans}
ORACLE_SQL = {"op6_secret_scans": _oracle()}
