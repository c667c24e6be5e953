"""Files in the folder that driver and executors share: scratch space, and writes that never replace a file."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch that goes to a Python worker, and Spark's own setting for them.
BATCH_BYTES, _BATCH, _DEFAULT = "8m", "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bound_batches(spark: SparkSession) -> None:
    """Holds batches to Python workers to ``BATCH_BYTES``, unless the session has a bound of its own: texts' lengths differ by orders of magnitude."""
    if spark.conf.get(_BATCH) == _DEFAULT:
        spark.conf.set(_BATCH, BATCH_BYTES)


def _at(spark: SparkSession, path: str):
    """Hadoop's path and file system of a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder; the folder goes when the driver ends.

    The cluster names the folder in ``spark.checkpoint.dir``, or the program by ``setCheckpointDir``. Where neither has been
    done, the warehouse serves a driver that is its own executor; on a cluster that is an error.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    path = f"{base.rstrip('/')}/quillmill-{uuid.uuid4().hex}"
    at, fs = _at(spark, path)
    fs.deleteOnExit(at)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and of no consequence to a lost executor."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a whole file unless there is one at ``path`` already; False if there is.

    Of several writers one succeeds, and no reader sees a part of a file: the text is written beside it and
    then given its name. On a machine's own file system that is a hard link, elsewhere a rename that doesn't
    replace, which is one step in HDFS.
    """
    jvm = spark._jvm
    at, fs = _at(spark, path)
    beside, _ = _at(spark, f"{at.getParent()}/.{uuid.uuid4().hex}")
    out = fs.create(beside, False)
    out.write(bytearray(text.encode()))
    out.close()
    from py4j.protocol import Py4JJavaError

    try:
        if fs.getUri().getScheme() == "file":
            own = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(own(at), own(beside))
        else:
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(beside, at, none)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
            raise
        return False
    finally:
        fs.delete(beside, False)
    return True


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders at ``path``; none if it isn't there."""
    at, fs = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def make_folder(spark: SparkSession, path: str) -> None:
    at, fs = _at(spark, path)
    fs.mkdirs(at)


def read_text(spark: SparkSession, path: str) -> str:
    at, fs = _at(spark, path)
    file = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
    finally:
        file.close()


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        at, fs = _at(spark, path)
        fs.delete(at, True)
