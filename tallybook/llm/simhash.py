"""Near-duplicate detection by SimHash fingerprints and pigeonhole blocks (operator 4).

A 64-bit fingerprint is split into four blocks of 16 bits. Two fingerprints that differ in at most two bits agree in at
least two whole blocks, so they meet under one of the six pairs of blocks; what meets is verified by its Hamming
distance. Only distinct fingerprints take part, with the smallest doc_id of each; copies follow by their fingerprint.

A value of a block pair that very many fingerprints share is not paired out. Its fingerprints get as keys themselves and
every variant with one bit changed: two fingerprints have a key in common exactly if they differ in two bits or
fewer, and a key has at most 65 of them. So such blocks cost 65 rows a fingerprint and lose no link.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, text_of, written
from .graph import components

SEED = 42
BLOCKS = 4
DISTANCE = 2
#: Blocks shared by more fingerprints than this are linked by one-bit variants instead of pairs.
PAIRED = 256


def fingerprint(text: str, words: int) -> int:
    """The signed 64-bit fingerprint of a text's word shingles; zero if it has no word."""
    found = text.encode().lower().split()
    if not found:
        return 0
    shingles = [b" ".join(found)] if len(found) < words else map(b" ".join, zip(*(found[i:] for i in range(words))))
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(text: Column, words: int) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return of(text)


def _block_keys(nodes: DataFrame) -> DataFrame:
    """(pair, value, fp): a row for each pair of blocks."""
    width = 64 // BLOCKS
    block = [F.shiftrightunsigned("fp", i * width).bitwiseAND((1 << width) - 1) for i in range(BLOCKS)]
    keys = [F.struct(F.lit(n).alias("pair"), (F.shiftleft(block[i], width) + block[j]).alias("value")) for n, (i, j) in enumerate(combinations(range(BLOCKS), BLOCKS - DISTANCE))]
    return nodes.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.pair", "k.value", "fp")


def links(nodes: DataFrame, paired: int = PAIRED) -> DataFrame:
    """(u, v): links between distinct fingerprints (fp) that differ in at most two bits; they connect what is close."""
    keys = _block_keys(nodes)
    shared = keys.groupBy("pair", "value").agg(F.count("*").alias("n")).where("n > 1")
    met = written(keys.join(shared, ["pair", "value"]))
    few, many = met.where(F.col("n") <= paired), met.where(F.col("n") > paired).select("fp").distinct()
    a, b = (few.select("pair", "value", F.col("fp").alias(x)) for x in "uv")
    pairs = a.join(b, ["pair", "value"]).where("u > v").where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE).select("u", "v")
    changed = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    near = many.select("fp", F.explode(changed).alias("key")).groupBy("key").agg(F.min("fp").alias("v"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    return pairs.unionByName(near.select(F.explode("all").alias("u"), "v").where("u != v")).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, paired: int = PAIRED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fp (signed 64-bit fingerprint), component_id (smallest doc_id reachable).

    A fingerprint bit is set if it is set in over half of the XXH64 hashes of the word shingles, repeats included, of
    the text with A-Z in lower case. Fewer words than a shingle: the whole sequence is one; none, as in null and empty
    texts: fingerprint zero, linked like any other. Repeated rows share a fingerprint. Null doc_ids take part and never
    name a component that has another id. An empty table gives an empty result. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    fps = written(docs.select(F.col(id_col).alias("doc_id"), fingerprints(text_of(docs, text_col), words).alias("fp")))
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    linked = written(components(links(nodes, paired)))
    named = linked.join(nodes.withColumnRenamed("fp", "node"), "node")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    joined = named.join(least, "root").select(F.col("node").alias("fp"), "component_id")
    ids = written(nodes.join(joined, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id")))
    return fps.join(ids, "fp").select("doc_id", "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
