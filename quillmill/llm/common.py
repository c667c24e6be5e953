"""What the operators of this subpackage share: tables, shared scratch space, row streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of a batch that goes to a Python worker, and Spark's own setting for them.
BATCH_BYTES, _BATCH, _DEFAULT = "8m", "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One input table; the path may be in any store that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Holds batches to Python workers to ``BATCH_BYTES``, unless the session has a bound of its own.

    Texts differ in length by orders of magnitude, and a worker holds a batch or two.
    """
    if spark.conf.get(_BATCH) == _DEFAULT:
        spark.conf.set(_BATCH, BATCH_BYTES)


def scratch_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``, or the program by ``setCheckpointDir``.
    Where neither has been done, the warehouse folder serves a driver that is its own
    executor (as in local tests); on a cluster that is an error, as the folder may be a
    machine's own.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    return f"{base.rstrip('/')}/quillmill-{uuid.uuid4().hex}"


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """A table that results may read for as long as the driver runs is deleted when it ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, and its path.

    This cuts lineage: a lost executor costs at most the stage that runs, and the
    rows are computed once however often they are read. The table is deleted by
    ``remove``, or else when the driver ends.
    """
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    forget_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no later plan reads."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def map_columns(df: DataFrame, fn: Callable[..., tuple], schema: str | StructType, *, rows: int = 2048) -> DataFrame:
    """``fn`` gets the columns of some rows as lists and returns the result's columns.

    Batches are cut to ``rows`` rows, so that memory in a worker follows the
    longest texts of a few rows and not those of a whole partition.
    """
    bound_batches(df.sparkSession)
    out = to_arrow_schema(schema if isinstance(schema, StructType) else StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                got = fn(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(got, out, strict=True)], schema=out)

    return df.mapInArrow(run, schema)


def with_columns(df: DataFrame, reads: list[str], fn: Callable[..., tuple], adds: str | StructType, *, drop: tuple[str, ...] = (), rows: int = 2048) -> DataFrame:
    """``df`` and the columns ``adds`` that ``fn`` makes of the columns ``reads`` (as lists); they replace those of their names.

    Columns in ``drop`` go. All others pass through the worker as Arrow has them,
    whatever their types, and keep their places.
    """
    bound_batches(df.sparkSession)
    adds = adds if isinstance(adds, StructType) else StructType.fromDDL(adds)
    made = to_arrow_schema(adds)
    schema = StructType([adds[f.name] if f.name in adds.names else f for f in df.schema if f.name not in drop])
    schema = StructType([*schema, *(f for f in adds if f.name not in schema.names)])
    # only what is read or passed on goes to the worker
    sent = df.select(*(c for c in df.columns if c in reads or c not in drop and c not in adds.names))
    at, names = {c: k for k, c in enumerate(sent.columns)}, schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, rows):
                part = batch.slice(first, rows)
                got = fn(*(part.column(at[c]).to_pylist() for c in reads))
                own = {f.name: pa.array(v, type=f.type) for v, f in zip(got, made, strict=True)}
                yield pa.RecordBatch.from_arrays([own[c] if c in own else part.column(at[c]) for c in names], names=names)

    return sent.mapInArrow(run, schema)


def make_room(df: DataFrame, names: set) -> DataFrame:
    """``df`` with columns of these names renamed: a number after the name, the first that is free."""
    for name in sorted(names & set(df.columns)):
        free = next(f"{name}{k}" for k in range(len(df.columns) + 1) if f"{name}{k}" not in df.columns)
        df = df.withColumnRenamed(name, free)
    return df


def train_rows(labels: DataFrame, label: str, modulus: int, held: int, most: int) -> DataFrame:
    """Labelled rows that a classifier may learn from: doc_id and label.

    ``crc32(doc_id as text) mod modulus`` equal to ``held`` marks the held-out fold.
    Of the rest at most ``most`` rows are taken, in the order of a hash of doc_id,
    so that the choice depends on the rows alone. Null ids or labels teach nothing;
    of repeated ids the largest label counts.
    """
    return (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
        .where(fold(F.col("doc_id"), modulus) != held)
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )


def train_texts(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, most: int) -> DataFrame:
    """doc_id, text and label of the rows that teach: ``most`` at most, whatever repeats in ``docs``.

    Of rows that share an id the smallest text counts (null as empty); they are combined
    before they are shuffled. The chosen labels are broadcast, as their number is bounded.
    """
    chosen = F.broadcast(train_rows(labels, label, modulus, held, most))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))


def fold(doc_id, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus
