"""Shared plumbing of the training-data operators: table access, scratch tables, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Rows, and bytes, that the JVM puts in one Arrow batch; whole texts are long, so batches are kept short.
BATCH_ROWS, BATCH_BYTES = 512, 32 << 20

ROOT = str(Path(__file__).resolve().parents[2])

TOKENIZER_DIR = "/opt/tokenizers"


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; executors have the same package, else TOKENIZER_DIR."""
    try:
        import public_tokenizers
    except ImportError:
        return f"{TOKENIZER_DIR}/{name}"
    return public_tokenizers.path(name)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it (executors elsewhere need it installed)."""
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds a Python worker's memory: an Arrow batch holds at most ``rows`` texts, and few bytes beyond BATCH_BYTES."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is made only where none is set and all runs on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes ``df`` to the shared folder and reads it back, so lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(*tables: DataFrame) -> None:
    """Frees the folders of written tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for path in {x.rsplit("/", 1)[0] for x in table.inputFiles()}:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of finished steps, which else stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def release_memory() -> None:
    """Gives freed memory back at a task's end: idle Python workers live on while the JVM needs the room."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_batches(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]], schema: T.StructType
) -> DataFrame:
    """``mapInArrow`` with a function made once per task (its caches live as long as the task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows:
                yield from each(batch)
        del each
        release_memory()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
