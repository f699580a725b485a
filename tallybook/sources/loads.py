"""Loads of statement files one after the other, with a registry of the contents that came before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .publish import exists
from .texts import distinct_texts

REGISTRY = "hash string, path string, load string"


def registry(spark: SparkSession, folder: str) -> DataFrame:
    """hash, path, load of every content that was kept, by the load that brought it first."""
    if not exists(spark, folder):
        return spark.createDataFrame([], REGISTRY)
    return spark.read.schema(REGISTRY).parquet(folder)


def load(files: DataFrame, folder: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) of files (path, text) that come as a load of this name.

    A content that an earlier load brought is dropped, as is one that an earlier path of this load has. What is kept is
    registered under the load's name, which replaces what an attempt of that name registered before: a load that is repeated
    keeps the same files, and the same files under another name add nothing. Only hashes and paths are read again.
    """
    spark = files.sparkSession
    known = registry(spark, folder).where(F.col("load") != name).select("hash", F.col("path").alias("first"))
    kept, repeated = distinct_texts(files)
    kept.join(known, "hash", "left_anti").select("hash", "path").write.mode("overwrite").parquet(f"{folder}/load={name}")
    said = F.concat(F.lit("Duplicate file content, first loaded as "), "first")
    late = kept.join(known, "hash").select("path", said.alias("message"))
    return kept.join(known, "hash", "left_anti"), repeated.unionByName(late)
