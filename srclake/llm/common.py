"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def qualified(spark: SparkSession, path: str) -> str:
    """The path with scheme and host as Hadoop resolves it, so that JVM and Python mean one place."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full


def filesystem(uri: str):
    """(pyarrow file system, path) of a qualified path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("s3" + uri[3:] if uri.startswith("s3a:") else uri)


def scratch_root(spark: SparkSession) -> str:
    """URI of the shared folder for written intermediates.

    The cluster names it in ``spark.checkpoint.dir``. Only on a local master
    where that is unset (tests) a temporary folder of this machine is made, and
    it is removed at exit.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return qualified(spark, named.rstrip("/"))
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "root" not in _LOCAL:
        folder = tempfile.mkdtemp(prefix="srclake-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL["root"] = f"file://{folder}"
    return _LOCAL["root"]


def for_texts(spark: SparkSession) -> SparkSession:
    """Smaller Arrow batches, unless the session sets its own: rows hold whole texts, and 10,000 of them are tens of megabytes on either side."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/srclake-{uuid.uuid4().hex[:12]}-{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage durably: a lost executor costs a re-read, not a
    recomputation, and a frame used twice is computed once.
    """
    return materialize_at(df, scratch_path(df.sparkSession, name))


def materialize_at(df: DataFrame, path: str) -> DataFrame:
    """As ``materialize``, at a path that can be dropped later."""
    spark = df.sparkSession
    with freeing_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def freeing_shuffles(spark: SparkSession):
    """What is executed within leaves no shuffle files behind: its result is written, and nothing runs it again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    if before is None:  # a version without it
        yield
        return
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, with underscores added until no column has that name."""
    lower = {t.lower() for t in taken}
    while wanted.lower() in lower:
        wanted = "_" + wanted
    return wanted
