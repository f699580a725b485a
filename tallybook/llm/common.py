"""Helpers shared by the training-data operators: the shared folder, written tables, checked broadcasts."""

from __future__ import annotations

import gc
import os
import tempfile

import numpy as np
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import passing, shared_dir, written

__all__ = ["passing", "shared_dir", "written"]

#: ASCII white space, as the contracts of the text operators have it.
BLANKS = r"[\x20\x09-\x0D]+"
#: A side of a join is sent to every executor only if it was counted and has at most so many narrow rows.
BROADCAST_ROWS = 200_000


#: Bytes of an Arrow batch between the JVM and Python at most, so that batches of long texts stay small.
BATCH = 4 << 20


def small_batches(spark: SparkSession, most: int = BATCH) -> None:
    """Lowers the session's bound on Arrow batches to so many bytes; a lower one stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = spark.conf.get(name).rstrip("b")
    if not given.isdigit() or int(given) > most:
        spark.conf.set(name, f"{most}b")


#: Caches, by lru_cache, that a Python worker keeps from task to task.
_kept: list = []


def kept(cache):
    """Marks a cache that tasks of the same operator share, and that let_go() empties."""
    _kept.append(cache)
    return cache


def let_go() -> None:
    """Empties what other operators' tasks have left in this worker: Spark hands its workers on from one to the next."""
    if full := [cache for cache in _kept if cache.cache_info().currsize]:
        for cache in full:
            cache.cache_clear()
        gc.collect()


def file_backed(df: DataFrame) -> bool:
    try:
        df.select("_metadata.file_path", "_metadata.row_index")
        return True
    except AnalysisException:
        return False


PLACE = ["__file", "__row"]


def located(df: DataFrame, *columns: Column) -> DataFrame:
    """columns of df with the place of each row, __file and __row (in the file), at the end; rows from no file are written first.

    Columns of df that are not asked for are left out, whatever their names.
    """
    if not file_backed(df):
        df = written(df)
    return df.select(*columns, F.col("_metadata.file_path").alias(PLACE[0]), F.col("_metadata.row_index").alias(PLACE[1]))


#: The name under which all columns of a row are kept as one.
WHOLE = "__whole"


def whole(df: DataFrame) -> Column:
    """All columns of df as one, so that none clashes with what is worked out beside it."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(WHOLE)


def unfolded(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that whole() put together."""
    return df.select([F.col(WHOLE).getField(c).alias(c) for c in columns])


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Asks for a broadcast of df if a count of it stays within rows, else for a shuffled join that hashes it."""
    return F.broadcast(df) if df.count() <= rows else df.hint("shuffle_hash")


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}"


def put(path: str, data: bytes) -> None:
    """Writes a file from a task: under another name first, so that a lost or repeated task leaves no half file."""
    store, at = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(at), recursive=True)
    tmp = f"{at}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.tmp"
    with store.open_output_stream(tmp) as f:
        f.write(data)
    store.move(tmp, at)


def mapped(path: str) -> np.ndarray | None:
    """The bytes of a file: mapped into memory where the folder is mounted, else from a copy that is mapped. None: no such file."""
    store, at = fs.FileSystem.from_uri(path)
    if store.get_file_info(at).type == fs.FileType.NotFound:
        return None
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(at, np.uint8, "r")
    with store.open_input_stream(at) as f, tempfile.TemporaryFile() as copy:
        while part := f.read(1 << 24):
            copy.write(part)
        copy.flush()
        return np.memmap(copy, np.uint8, "r")  # the mapping outlives the unlinked file


def met(left: DataFrame, right: DataFrame, on: str, rows: str) -> DataFrame:
    """left joined with right, whose rows are unique on a column; a column of right says how many rows of left have its value.

    Values that hold over a BROADCAST_ROWS-th of left's rows are so many at most, by arithmetic: these are broadcast, so
    that none of them fills a task. The others are met by a shuffle.
    """
    most = right.agg(F.count("*"), F.sum(rows)).first()
    if most[0] <= BROADCAST_ROWS:
        return left.join(F.broadcast(right.drop(rows)), on)
    hot = F.col(rows) * BROADCAST_ROWS > int(most[1])
    many, few = F.broadcast(right.where(hot).drop(rows)), right.where(~hot).drop(rows)
    return left.join(many, on).unionByName(left.join(F.broadcast(right.where(hot).select(on)), on, "left_anti").join(few, on))
