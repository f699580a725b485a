"""Tables that are worked out once and read several times, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that setting is absent, a temporary folder in local mode, else an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("tallybook.shared.dir", None)
    if not base:
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("tallybook.shared.dir", base)
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    for made in _open:
        made.append(path)
    return path


#: What is asked for while a passing() is open, for each of these.
_open: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """Folders that shared_dir gives within the block are removed at its end, but for those that the block takes off the list."""
    made: list[str] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open.remove(made)
        for path in made:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Files of a table of narrow rows for each core of the cluster at most.
FILES = 4


def written(df: DataFrame, narrow: bool = False) -> DataFrame:
    """The rows of df, written to the shared folder and read again: lineage ends, and any executor may be lost.

    narrow: the rows are a few numbers each, so that a few files a core are enough however many partitions there are.
    """
    spark = df.sparkSession
    df = df.coalesce(FILES * spark.sparkContext.defaultParallelism) if narrow else df
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
