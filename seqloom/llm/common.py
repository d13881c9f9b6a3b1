"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever extra columns it carries."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_or_empty(text: str | Column) -> Column:
    """A null text counts as the empty one."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def row_key(row_id: str | Column, text: str | Column) -> Column:
    """16-byte digest of a row's id and text: equal for repeated rows only, whether ids are null or repeat with other texts."""
    i = (F.col(row_id) if isinstance(row_id, str) else row_id).cast("string")
    return F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("i"), F.length(i).cast("string"), F.lit(":"), i), F.lit("n")), text_or_empty(text))))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; the warehouse only where that is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (found or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch").rstrip("/")


class Scratch:
    """Tables written once to the shared folder and read again: later steps neither recompute them nor depend on an executor."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, keep: int = 0) -> None:
        """Deletes all tables but the last `keep`; nothing may read them any more."""
        gone, self.paths = self.paths[: len(self.paths) - keep], self.paths[len(self.paths) - keep :]
        for path in gone:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder for as long as the caller's result may be read."""
    return Scratch(df.sparkSession).stored(df, name)
