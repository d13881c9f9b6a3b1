"""Source divergence audit: how far each source of a language is from its others, and which terms set it apart.

Tasks count the terms of their own texts by (lang, source) and by documents, so that one row of each term, group and
task is shuffled. Terms in enough documents of a language are kept, and shares are whole numbers, p = 1 + floor(1e9 * (count +
1) / (N + V)), by long division, exact while a group has fewer than 9e15 occurrences.

Pairs are sparse: all terms that two groups lack add the same, so V times that baseline is corrected at the terms that
either has, and once more at those that both have. The kept terms of a language are cut into blocks by hash, its sources into
tiles; a task corrects the pairs of two tiles over one block, from a bounded number of rows, and gives one sum for each pair.

Terms are ranked by radix selection (seqloom/llm/radix.py): histograms over the bits of the values find the 200th of each
group, then ties are refined by bytes.

Cases: null text, lang and source count as empty ones, and an empty lang or source is one like any other; every row is a
document of its own, repeated rows as well; a group without terms has count 0 for all, is in all pairs and has no term rows; a
language without kept terms has pairs of value 0; a language with one source has no pairs; very long terms are terms; an empty table
gives an empty result; extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm.chunks import slices
from seqloom.llm.common import Scratch, documents, text_or_empty
from seqloom.llm.radix import top_ranked

#: Fixed values, the contract's: what parts terms (all ASCII but letters), documents of a kept term, unit of shares, ranks of terms.
SEPARATORS, LEAST_DOCS, UNIT, TOP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", 3, 1_000_000_000, 200
#: Sources in a tile; rows of one tile in a block, on average; pairs of rows that a task makes at a time.
TILE, BLOCK_ROWS, AT_ONCE = 64, 32_768, 1_000_000


def _tallied(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.RecordBatch:
    """lang, source, term, n, docs of a run of texts, and a row without a term for each of its groups."""
    group, names = pd.MultiIndex.from_arrays([lang.to_pandas(), source.to_pandas()]).factorize()
    lists = pc.split_pattern_regex(pc.ascii_lower(text), SEPARATORS)
    row = np.repeat(np.arange(len(text)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    flat = lists.flatten()
    words = pc.greater(pc.binary_length(flat), 0)  # what stands before the first and after the last separator may be empty
    row, flat = row[words.to_numpy(zero_copy_only=False)], pc.dictionary_encode(flat.filter(words))
    width = max(len(flat.dictionary), 1)
    in_doc, times = np.unique(row * width + flat.indices.to_numpy(zero_copy_only=False), return_counts=True)
    key = group[in_doc // width].astype(np.int64) * width + in_doc % width
    order = np.argsort(key, kind="stable")
    found, first, docs = np.unique(key[order], return_index=True, return_counts=True)
    n = np.add.reduceat(times[order], first) if len(found) else np.zeros(0, np.int64)
    of = np.concatenate([found // width, np.arange(len(names))])
    langs, sources = (pa.array(names.get_level_values(i), pa.string()) for i in (0, 1))
    term = flat.dictionary.cast(pa.string()).take(pa.array(np.concatenate([found % width, np.zeros(len(names), np.int64)]), mask=np.arange(len(of)) >= len(found)))
    none = np.zeros(len(names), np.int64)
    return pa.RecordBatch.from_arrays([langs.take(pa.array(of)), sources.take(pa.array(of)), term, pa.array(np.concatenate([n, none]).astype(np.int64)), pa.array(np.concatenate([docs, none]).astype(np.int64))], names=["lang", "source", "term", "n", "docs"])


def tallies(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents of each term in each group; term is null once for each group."""
    rows = docs.select(*(text_or_empty(F.col(c).cast("string")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for texts in slices(b.column(2)):
                yield _tallied(b.column(0).slice(at, len(texts)), b.column(1).slice(at, len(texts)), texts)
                at += len(texts)

    parts = rows.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str) -> Column:
    """1 + floor(UNIT * (count + 1) / total) of whole-number columns; total is count + 1 at least. Three digits at a time, so that nothing overflows."""
    out, rest = "1", f"({count} + 1)"
    for unit in (1_000_000, 1_000, 1):
        out, rest = f"{out} + {unit} * ((1000 * {rest}) div {total})", f"((1000 * {rest}) % {total})"
    return F.expr(out)


def divergence(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def corrections(source: np.ndarray, term: np.ndarray, p: np.ndarray, base: np.ndarray) -> np.ndarray:
    """out[a, b]: what the given terms add to the baseline of the pair (a, b), over terms that a, b or both have.

    source: places in base; term: any numbers; p: shares; base: the share of a term that each source lacks.
    """
    level = _f(base[:, None], base[None, :])
    out = np.zeros((len(base), len(base)), np.int64)
    kinds, times = np.unique(np.stack([source, p]), axis=1, return_counts=True)
    for a in range(0, kinds.shape[1], max(1, AT_ONCE // len(base))):
        (s, q), n = kinds[:, a : a + max(1, AT_ONCE // len(base))], times[a : a + max(1, AT_ONCE // len(base)), None]
        np.add.at(out, s, n * (_f(q[:, None], base[None, :]) - level[s]))
        np.add.at(out.T, s, n * (_f(base[None, :], q[:, None]) - level.T[s]))
    order = np.argsort(term, kind="stable")
    source, p = source[order], p[order]
    _, first, holders = np.unique(term[order], return_index=True, return_counts=True)
    part = np.cumsum(holders**2) // AT_ONCE
    for k in np.unique(part):
        start, size = first[part == k], holders[part == k]
        # each row of a term with each row of it
        left = np.repeat(np.arange(start[0], start[-1] + size[-1]), np.repeat(size, size))
        ends = np.cumsum(size**2)
        right = np.arange(ends[-1]) - np.repeat(ends - size**2, size**2)
        right = right % np.repeat(size, size**2) + np.repeat(start, size**2)
        s, t = source[left], source[right]
        np.add.at(out, (s, t), _f(p[left], p[right]) - _f(p[left], base[t]) - _f(base[s], p[right]) + level[s, t])
    return out


def _tiled(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value of all ordered pairs of sources of a language."""
    tiles = F.ceil(F.col("sources") / TILE).cast("bigint")
    blocks = F.greatest(F.ceil(F.col("lang_rows") / (tiles * BLOCK_ROWS)), F.lit(1)).cast("bigint")
    shape = groups.select("lang", "source", "base", "v", tiles.alias("tiles"), blocks.alias("blocks"), F.pmod(F.xxhash64("source"), tiles).alias("tile"))
    met = lambda df: df.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1))).withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other"))
    own = met(shape.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))).select("lang", "block", "low", "high", "tile", "source", F.lit(None).cast("string").alias("term"), F.col("base").alias("p"), "v")
    each = met(shares.join(shape.drop("base"), ["lang", "source"]).withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")))).select("lang", "block", "low", "high", "tile", "source", "term", "p", "v")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        heads = rows[rows.term.isna()].sort_values("source")
        terms = rows[rows.term.notna()]
        names, base, tile = heads.source.to_numpy(object), heads.p.to_numpy(np.int64), heads.tile.to_numpy()
        place = pd.Series(np.arange(len(names)), index=names)
        value = corrections(place[terms.source].to_numpy(np.int64), pd.factorize(terms.term)[0], terms.p.to_numpy(np.int64), base)
        wanted = ~np.eye(len(names), dtype=bool)
        if key[2] != key[3]:
            wanted &= tile[:, None] != tile[None, :]
        if key[1] == 0:  # every pair once, and its baseline
            value = value + _f(base[:, None], base[None, :]) * heads.v.to_numpy(np.int64)[:, None]
        else:
            wanted &= value != 0
        a, b = np.nonzero(wanted)
        return pd.DataFrame({"lang": key[0], "source": names[a], "item": names[b], "value": value[a, b]})

    parts = own.unionByName(each).groupBy("lang", "block", "low", "high").applyInPandas(run, "lang string, source string, item string, value bigint")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank."""
    scratch = Scratch(docs.sparkSession)
    counts = scratch.stored(tallies(docs, lang_col, source_col, text_col), "tallies")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least_docs)
    kept = scratch.stored(kept.select("lang", "term", "lang_n"), "kept")
    terms = scratch.stored(counts.where("term is not null").select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "kept_terms")
    # every language and every group, with or without terms
    group_n = terms.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    groups = counts.where("term is null").select("lang", "source").join(group_n, ["lang", "source"], "left").na.fill(0, ["n", "rows"])
    lang_v = kept.groupBy("lang").agg(F.count("*").alias("v"))
    of_lang = groups.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("rows").alias("lang_rows"), F.count("*").alias("sources")).join(lang_v, "lang", "left").na.fill(0, ["v"])
    groups = groups.join(of_lang, "lang")
    groups = groups.withColumn("zero", F.lit(0)).withColumn("total", F.col("n") + F.col("v"))
    groups = scratch.stored(groups.withColumn("base", F.when(F.col("v") > 0, share("zero", "total")).otherwise(1)).select("lang", "source", "total", "lang_total", "lang_rows", "sources", "v", F.col("base").cast("bigint")), "groups")
    shares = terms.join(groups.select("lang", "source", "total", (F.col("lang_total") + F.col("v")).alias("all")), ["lang", "source"]).select("lang", "source", "term", share("n", "total").alias("p"), share("lang_n", "all").alias("q"))
    shares = scratch.stored(shares, "shares")
    over = scratch.stored(shares.where("p > q").select("lang", "source", F.col("term").alias("item"), divergence("p", "q").alias("value")), "over")
    best = top_ranked(over, ["lang", "source"], "value", "item", top, "rank").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    ranks = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = _tiled(shares.select("lang", "source", "term", "p"), groups).withColumn("rank", ranks)
    out = scratch.stored(best.unionByName(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")), "divergence")
    scratch.drop(keep=1)
    return out


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))


def _oracle() -> str:
    pattern = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
    return f"""
WITH d AS (SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT n, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{pattern}')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS c FROM w GROUP BY lang, term HAVING count(DISTINCT n) >= {LEAST_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT lang, source, term, count(*) AS c FROM w JOIN k USING (lang, term) GROUP BY ALL),
a AS (SELECT g.lang, g.source, k.term, coalesce(o.c, 0)::HUGEINT AS c, k.c AS lc FROM g JOIN k USING (lang) LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
p AS (SELECT lang, source, term, c,
  1 + ({UNIT} * (c + 1)) // (sum(c) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source))::HUGEINT AS p,
  1 + ({UNIT} * (lc + 1)) // (sum(lc) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source))::HUGEINT AS q FROM a),
f AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p)::HUGEINT AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r
QUALIFY part = 'pair' OR rank <= {TOP}"""


QUERIES = {"op12_source_divergence": op12_source_divergence}
ORACLE_SQL = {"op12_source_divergence": _oracle()}
