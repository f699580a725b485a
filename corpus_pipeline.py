"""A training corpus from raw documents: toxic ones out, exact and near copies out, sources mixed, texts as token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm import bpe, exact_dedup, mixing, similar, toxicity
from tallybook.llm.common import PLACE, passing, shared_dir, small, unfolded, written


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go; it is fitted on labelled documents of the input.

    Null and empty texts stay. Without labels of both kinds all documents stay. An empty table gives an empty one.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space the one with the smallest doc_id stays.

    Of rows that repeat that id the first by place in the files stays; rows without an id come after all others. Null texts
    are empty texts. An empty table gives an empty one.
    """
    return exact_dedup.keep_first(docs)


def near_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links of close fingerprints or of similar texts, or both in turn, the one with the smallest doc_id stays.

    Rows are known by their place in the files: of rows that share an id the first by place is the smallest, and rows
    without an id come after all others. Null and empty texts are similar to each other. An empty table gives an empty one.
    """
    rows, groups = similar.near_groups(docs)
    groups = written(groups.withColumn("rank", F.struct(F.col("doc_id").isNull(), "doc_id", *PLACE)))
    stay = groups.groupBy("root").agg(F.min("rank").alias("first"))
    dropped = written(groups.join(small(stay), "root").where(F.col("rank") != F.col("first")).select(*PLACE))
    return unfolded(rows.join(small(dropped), PLACE, "left_anti"), docs.columns)


def sources_mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, in the order of the mix; null sources are one source. An empty table gives an empty one."""
    return mixing.mixed(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids and the text that they decode to; null and empty texts have no ids. An empty table gives an empty one."""
    found = bpe.encode_decode(docs, keep=("source",))
    return found.select("doc_id", "source", F.size("ids").alias("n_tokens"), "ids", "decoded")


STAGES = [("toxicity", toxic_out), ("exact_dedup", exact_out), ("near_dedup", near_out), ("mixing", sources_mixed), ("bpe", tokenised)]

#: SQL can't express the severity model, so no stage's rows are given in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents, each to the written table of the one before.

    Tables that a stage works with are removed when its own is written, and a stage's table when the next one's is.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        path = shared_dir(spark)
        with passing(spark) as made:
            stage(spark, docs, sf_dir).write.parquet(path)
            made += [last] if last else []
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
