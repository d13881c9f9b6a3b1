"""Readers, writers and stateless scorers over streams."""

import pytest
from pyspark.sql import functions as F

from seqloom.sources import sinks, tables
from seqloom.streaming import scorers


def test_fasta(spark, tmp_path):
    path = tmp_path / "x.fa"
    path.write_text(">sp|P1|A_HUMAN Protein GN=ABC1 PE=1\nMKT\nAYI\n>P2 no gene\nacdef\n>P3\n")
    assert [(r.name, r.seq) for r in tables.fasta(spark, str(path)).collect()] == [("sp|P1|A_HUMAN", "MKTAYI"), ("P2", "ACDEF"), ("P3", "")]
    assert {(r.key, r.gene) for r in tables.gene_symbols(spark, str(path), by_accession=True).collect()} == {("P1", "ABC1"), ("P2", None), ("P3", None)}


def test_tables(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_bytes("﻿epitope\tmhc_a\tmhc_b\tmhc_class\nsiinfekl\tA*02:01\t\tMHCI\nABZ\tA*02:01\t\tMHCI\nPKYVKQNTLKLAT\tDRA\tDRB1*01:01\tMHCII\n".encode())
    raw = tables.delimited(spark, str(path), required=["epitope", "mhc_a"])
    assert sorted((r.cls, r.epitope, r.allele, r.weight) for r in tables.panel(raw).collect()) == [("mhc1", "SIINFEKL", "A*02:01", 1.0), ("mhc2", "PKYVKQNTLKLAT", "DRB1_0101", 1.0)]
    with pytest.raises(ValueError, match="gene, p"):
        tables.delimited(spark, str(path), required=["epitope", "gene", "p"])
    df = spark.createDataFrame([("5", "7"), ("x", "8"), (None, "9")], "ic50 string, affinity string")
    assert [r[0] for r in df.select(tables.affinity_of(df)).collect()] == [5.0, 8.0, 9.0]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "x"), (2, 0.5, "y")], "id int, p double, k string")
    out = str(tmp_path / "out")
    sinks.delimited(df.coalesce(1), out, columns=["id", "p", "absent"])
    text = next((tmp_path / "out").glob("part-*")).read_bytes()
    assert text == b"id\tp\tabsent\n1\t\t\n2\t0.5\t\n"
    cache = str(tmp_path / "cache")
    sinks.replace_partitions(df, cache, ["k"])
    sinks.replace_partitions(df.where("k = 'x'").withColumn("id", F.lit(9)), cache, ["k"])
    assert sorted(r.id for r in spark.read.parquet(cache).collect()) == [2, 9]
    assert sinks.content_hash(df).collect() == sinks.content_hash(df.orderBy(F.desc("id")).repartition(3)).collect()


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(1, "acdefghik"), (2, "lmnpqrstvw")], "id int, text string")
    df.write.parquet(str(tmp_path / "in"))
    s = scorers.tiled(scorers.read(spark, str(tmp_path / "in"), "id int, text string"), "text", 5)
    q = s.writeStream.format("memory").queryName("tiles").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.id, r.kmer) for r in spark.sql("select * from tiles").collect())
    assert got == sorted((i, t[o : o + 5].upper()) for i, t in ((1, "acdefghik"), (2, "lmnpqrstvw")) for o in range(len(t) - 4))
