"""Sinks: delimited tables with nulls as empty fields, JSON, and tables replaced partition by partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def delimited(df: DataFrame, path: str, *, sep: str = "\t", columns: Sequence[str] | None = None) -> None:
    """Exactly these columns in this order, an absent one empty; line feeds only."""
    chosen = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in (columns or df.columns)]
    df.select(*chosen).write.csv(path, sep=sep, header=True, nullValue="", emptyValue="", lineSep="\n")


def json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path, lineSep="\n", ignoreNullFields=False)


def replace_partitions(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Parquet of which only the partitions that df has are replaced, each by an atomic commit: the cache of calibrations by model fingerprint."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def content_hash(df: DataFrame) -> DataFrame:
    """One row: n and a hash of all rows that does not depend on their order."""
    row = F.xxhash64(*(F.col(c) for c in df.columns))
    return df.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("hash"))
