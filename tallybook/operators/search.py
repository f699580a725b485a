"""Search in descriptions by their trigrams, so that only texts that can match are read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

GRAM = 3


def grams(text: Column) -> Column:
    """The distinct trigrams of a text in small letters."""
    low = F.lower(text)
    every = F.transform(F.sequence(F.lit(1), F.length(low) - GRAM + 1), lambda i: low.substr(i, F.lit(GRAM)))
    return F.when(F.length(low) >= GRAM, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def index(words: DataFrame) -> DataFrame:
    """(gram, text_id) of a dictionary (text_id, description), written in the order of grams, so that a search reads a few ranges."""
    pairs = words.select(F.explode(grams(F.col("description"))).alias("gram"), "text_id")
    return written(pairs.repartitionByRange("gram", "text_id").sortWithinPartitions("gram", "text_id"))


def candidates(found: DataFrame, text: str) -> DataFrame:
    """text_id of the descriptions that hold every trigram of text, which has GRAM characters at least."""
    low = text.lower()
    wanted = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
    return found.where(F.col("gram").isin(wanted)).groupBy("text_id").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("text_id")


def matching(words: DataFrame, found: DataFrame, text: str) -> DataFrame:
    """text_id of the descriptions that hold text in any case. A text of fewer characters than a trigram is sought in all."""
    holds = F.lower("description").contains(text.lower())
    rows = words.select("text_id", "description")
    return (rows if len(text) < GRAM else rows.join(candidates(found, text), "text_id", "left_semi")).where(holds).select("text_id")


def holding(tx: DataFrame, words: DataFrame, found: DataFrame, *texts: str) -> DataFrame:
    """Rows of tx (text_id) whose description holds every one of texts."""
    ids = reduce(lambda a, b: a.join(b, "text_id", "left_semi"), (matching(words, found, t) for t in texts))
    return tx.join(ids, "text_id", "left_semi")
