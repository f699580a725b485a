"""Exact deduplication by a stateful stream (operator 8), in DataFrame operations only.

The documents' digests pass through a streaming aggregation whose keyed state lies in RocksDB on the executors' disks
and never expires. For each digest the state keeps the smallest identifier, the content locator of that row (file and
row in the file) and the number of arrivals. Digests that were hit more than once are then checked on the full bytes,
which the locator finds again wherever the row came from.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.publish import exists, put_text
from .common import BLANKS, PLACE, file_backed, located, shared_dir, small, text_of, unfolded, whole, written

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",  # stores of a stream that has ended go soon
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no disk set aside for each
}


def normalised(df: DataFrame, text_col: str = "text") -> Column:
    """The text with every run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(text_of(df, text_col), BLANKS, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _rank(id_col: str) -> Column:
    return F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col("__file").alias("file"), F.col("__row").alias("row"))


#: Files of arrivals that one batch of the stream takes at most.
FILES = 1000


def _streamed(spark: SparkSession, folder: str, schema: str, call: str) -> DataFrame:
    """(digest, keeper, group_size) of the digests that this call touched, by going on with the stream and its state in folder."""
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    out = f"{folder}/digests/call={call}"
    try:
        arrivals = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(f"{folder}/arrivals")
        state = arrivals.groupBy("digest").agg(F.min(_rank("id")).alias("keeper"), F.count("*").alias("group_size"))
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(lambda rows, batch: rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/of={batch}"))
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    last = spark.read.schema(state.withColumn("batch", F.lit(0).cast("long")).schema).option("recursiveFileLookup", "true").parquet(out)
    return last.groupBy("digest").agg(F.max_by(F.struct("keeper", "group_size"), "batch").alias("s")).select("digest", "s.keeper", "s.group_size")


def _begun(spark: SparkSession, folder: str, call: str) -> list[str]:
    """The calls that ended before this one first began. A call that was begun and has not ended has to be repeated first."""
    path = f"{folder}/calls.json"
    calls = json.loads(spark.read.text(path, wholetext=True).first().value) if exists(spark, path) else {}
    if others := sorted(c for c, x in calls.items() if c != call and not x["ended"]):
        raise ValueError(f"call {others[0]} has not ended; it has to be repeated before {call}")
    if call not in calls:
        put_text(spark, path, json.dumps({**calls, call: {"after": sorted(calls), "ended": False}}))
        return sorted(calls)
    return calls[call]["after"]


def _ended(spark: SparkSession, folder: str, call: str) -> None:
    path = f"{folder}/calls.json"
    calls = json.loads(spark.read.text(path, wholetext=True).first().value)
    put_text(spark, path, json.dumps({**calls, call: {**calls[call], "ended": True}}))


def _texts_at(places: DataFrame, text_col: str) -> DataFrame:
    """places (PLACE, ...) with norm, read again from the files that they name."""
    files = [r[0] for r in places.select(PLACE[0]).distinct().collect()]
    if not files:
        return places.withColumn("norm", F.lit("")).limit(0)
    read = places.sparkSession.read.parquet(*files)
    rows = located(read, F.col(f"`{text_col}`").alias("text"))
    return rows.join(small(places), PLACE).withColumn("norm", normalised(rows)).drop("text")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, state: str | None = None, call: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, file, row (the row's content locator).

    Equal are texts that are identical once runs of ASCII white space are single spaces. The row with the smallest id
    stays; of rows that repeat that id, the first by content locator; a null id comes after all others. Null texts
    count as empty, and empty texts are equal to each other. An empty table gives an empty result. Other columns of
    docs are not read, whatever their names. digest may be replaced by a weaker function: rows whose digests are equal
    and whose bytes are not are told apart by the full text.

    state: a folder that all executors share. The stream's state stays there, and a later call with more docs goes on
    from it: its rows are held against all that came before, and group_size counts these too. call: the caller's name for
    these docs. A call that failed is repeated under its name and gives what it would have given; one that ended gives the
    same again. A call reads the state of the digests that it brings, its own texts, and of earlier texts those whose
    digests it hits, by their locators; so files of earlier calls have to stay where they were.
    """
    if (state is None) != (call is None):
        raise ValueError("state and call go together")
    spark = docs.sparkSession
    folder, call = state or shared_dir(spark), call or "only"
    after = _begun(spark, folder, call) if state else []
    rows = located(docs, F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    norm = normalised(rows)
    made = rows.select("id", digest(norm).alias("digest"), sha256(norm).alias("text_sha256"), *PLACE)
    if not exists(spark, f"{folder}/arrivals/call={call}/_SUCCESS"):
        made.write.mode("overwrite").parquet(f"{folder}/arrivals/call={call}")
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema)
    arrivals = spark.read.schema(own).parquet(f"{folder}/arrivals/call={call}")
    if not arrivals.take(1):
        if state:
            _ended(spark, folder, call)
        return arrivals.select(F.col("id").alias("doc_id"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", F.col("__file").alias("file"), F.col("__row").alias("row"))
    found = written(_streamed(spark, folder, f"{own}, call string", call))
    hits = found.where("group_size > 1").select("digest")
    texts = rows.select("id", *PLACE, norm.alias("norm")).withColumn("digest", digest(F.col("norm")))
    read = texts.select("digest", "norm").join(small(hits), "digest", "left_semi")
    if after:
        keepers = found.where("group_size > 1").select("digest", F.col("keeper.file").alias(PLACE[0]), F.col("keeper.row").alias(PLACE[1]))
        earlier = written(keepers.join(arrivals.select(*PLACE), PLACE, "left_anti"))
        read = read.unionByName(_texts_at(earlier, text_col).select("digest", "norm"))
    checked = read.groupBy("digest", "norm").agg(F.count("*").alias("n"))
    clash = checked.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")
    for c in after:  # a digest that stood for several texts once always does
        clash = clash.unionByName(spark.read.schema("digest string").parquet(f"{folder}/clashes/call={c}").join(small(hits), "digest", "left_semi"))
    clash.distinct().write.mode("overwrite").parquet(clashes := f"{folder}/clashes/call={call}")
    clash = spark.read.schema("digest string").parquet(clashes)
    split = None
    if clash.take(1):
        apart = texts.join(small(clash), "digest", "left_semi").select("id", "digest", "norm", *PLACE)
        if after:
            paths = [f"{folder}/arrivals/call={c}" for c in after]
            places = spark.read.schema(own).parquet(*paths).join(small(clash), "digest", "left_semi").select("id", "digest", *PLACE)
            apart = apart.unionByName(_texts_at(written(places), text_col).select("id", "digest", "norm", *PLACE))
        apart = written(apart)
        each = apart.groupBy("digest", "norm").agg(F.min(_rank("id")).alias("keeper"), F.count("*").alias("group_size"))
        split = apart.join(each, ["digest", "norm"]).select("id", *PLACE, sha256(F.col("norm")).alias("text_sha256"), "keeper", "group_size")
        split = split.join(arrivals.join(small(clash), "digest", "left_semi").select(*PLACE), PLACE, "left_semi")
        arrivals = arrivals.join(small(clash), "digest", "left_anti")
    if state:
        _ended(spark, folder, call)
    out = arrivals.join(found, "digest").select("id", *PLACE, "text_sha256", "keeper", "group_size")
    out = out if split is None else out.unionByName(split)
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("keeper.id").alias("keep_id"),
        "group_size",
        ((F.col("__file") == F.col("keeper.file")) & (F.col("__row") == F.col("keeper.row"))).alias("kept"),
        "text_sha256",
        F.col("__file").alias("file"),
        F.col("__row").alias("row"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", state: str | None = None, call: str | None = None) -> DataFrame:
    """docs without the rows that exact_dedup drops; all columns and all other rows stay.

    With a state folder of earlier calls, a row stays if it is the smallest of all so far.
    """
    columns, docs = docs.columns, docs if file_backed(docs) else written(docs)
    dropped = exact_dedup(docs, id_col, text_col, state=state, call=call).where("not kept").select(F.col("file").alias("__file"), F.col("row").alias("__row"))
    return unfolded(located(docs, whole(docs)).join(small(written(dropped)), PLACE, "left_anti"), columns)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP8_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
