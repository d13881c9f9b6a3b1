"""Every query with SQL against DuckDB on the smallest tables; the others run."""

import glob
import os

import duckdb
import pytest

from seqloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    got = registry.queries()[name](spark, SF).toPandas()
    sql = registry.oracle_sql().get(name)
    if not sql:
        assert len(got)
        return
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.sql(sql).df()
    rows = lambda df: sorted(map(str, df[sorted(df)].astype(object).where(df[sorted(df)].notna(), None).itertuples(index=False, name=None)))
    assert sorted(got) == sorted(want) and rows(got) == rows(want)


def test_entry_imports_and_lists_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "rare_kmers" in e.queries()


def test_nearest_other_name_asks_for_every_name(spark, tmp_path):
    rows = [(1, "almond one"), (3, "almond ons"), (2, "brown antique lace"), (4, "brown antique lacy"), (5, "x"), (7, "almond one"), (9, None)]
    spark.createDataFrame(rows, "p_partkey bigint, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    got = {r.query: (r.dist, r.nearest, r.n_within) for r in registry.queries()["nearest_other_name"](spark, str(tmp_path)).collect()}
    assert got == {"ALMONDONE": (1, "ALMONDONS", 1), "ALMONDONS": (1, "ALMONDONE", 1), "BROWNANTIQUELACE": (1, "BROWNANTIQUELACY", 1), "BROWNANTIQUELACY": (1, "BROWNANTIQUELACE", 1), "X": (3, None, 0)}


def test_passage_source_reports_whole_runs(spark, tmp_path):
    passage = "".join(chr(65 + (i * i + 3 * i) % 23) + chr(65 + i % 26) for i in range(40))
    docs = [(1, "xx " + passage), (2, passage[30:]), (3, passage[:26] + "zz" * 9), (4, passage[1:24]), (5, "qq short one qq")]
    spark.createDataFrame([(i, "en", t) for i, t in docs], "doc_id bigint, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage), (2, "Short one"), (3, "")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {(r.item_id, r.doc_id): (r.run, r.at, r.first, r.whole) for r in registry.queries()["passage_source"](spark, str(tmp_path)).collect()}
    assert got == {(1, 1): (80, 0, 2, True), (1, 2): (50, 30, 0, False), (1, 3): (26, 0, 0, False), (2, 5): (8, 0, 2, True)}
