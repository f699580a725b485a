"""Several outputs that appear together or not at all.

A run writes its outputs below a folder of its own; a manifest, put in place last by one rename, says which run's folder
holds each output. Readers go by the manifest, so they see all outputs of a run or none.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "manifest.json"


class Exists(FileExistsError):
    """Outputs that are there already and were not to be replaced."""


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    _, at, files = _files(spark, path)
    return bool(files.exists(at))


def manifest(spark: SparkSession, target: str) -> dict[str, str]:
    """The folder of each published output, relative to target; empty before the first run."""
    path = f"{target}/{MANIFEST}"
    if not exists(spark, path):
        return {}
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Puts a small file in place by one rename: readers see the file before or the whole new one."""
    jvm, at, files = _files(spark, path)
    folder, _, name = path.rpartition("/")
    staged = jvm.org.apache.hadoop.fs.Path(f"{folder}/_{uuid.uuid4().hex}-{name}")
    out = files.create(staged)
    out.write(bytearray(text.encode()))
    out.close()
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(files.makeQualified(staged), files.makeQualified(at), how)


def publish(outputs: dict[str, DataFrame], target: str, overwrite: bool = False, form: str = "csv", **options: str) -> dict[str, str]:
    """Writes all outputs and then makes them the published ones; returns the manifest.

    Before anything is written, each name is looked up: one that is published already is an error unless overwrite. If an
    output fails, what was published stays as it was, and so does everything that a reader may be in the middle of.
    Outputs of earlier runs that this run does not name stay published. options: of the writer, such as compression; as both
    the run before and this one are on disk until the end, and CSV takes many times the room of the tables, large ones want it.
    """
    if not outputs:
        raise ValueError("nothing to publish")
    spark = next(iter(outputs.values())).sparkSession
    before = manifest(spark, target)
    if taken := sorted(set(before) & set(outputs)):
        if not overwrite:
            raise Exists(f"published already: {', '.join(taken)}")
    run = f"run-{uuid.uuid4().hex}"
    for name, df in outputs.items():
        df.write.mode("errorifexists").option("header", True).options(**options).format(form).save(f"{target}/{run}/{name}")
    after = {**before, **{name: f"{run}/{name}" for name in outputs}}
    put_text(spark, f"{target}/{MANIFEST}", json.dumps(after, sort_keys=True))
    return after


def published(spark: SparkSession, target: str, name: str, form: str = "csv") -> DataFrame:
    return spark.read.option("header", True).format(form).load(f"{target}/{manifest(spark, target)[name]}")


def prune(spark: SparkSession, target: str) -> list[str]:
    """Removes the folders of runs of which nothing is published any more; returns their names."""
    used = {p.partition("/")[0] for p in manifest(spark, target).values()}
    _, at, files = _files(spark, target)
    gone = [s.getPath() for s in files.listStatus(at) if s.isDirectory() and s.getPath().getName().startswith("run-") and s.getPath().getName() not in used]
    for path in gone:
        files.delete(path, True)
    return sorted(p.getName() for p in gone)
