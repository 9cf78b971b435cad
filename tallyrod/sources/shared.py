"""Tables in between, written where the driver and all executors can read them."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path below spark.checkpoint.dir, in one folder for each run of an application, named by its id, which
    can be removed as a whole once the run has ended. Where the setting is unset, on one machine, a temporary folder takes
    its place; on a cluster it is an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = _own_dir()
    return f"{top.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


@functools.cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")


def saved(df: DataFrame, name: str = "t") -> DataFrame:
    """The rows written as Parquet in the shared folder and read back: lineage ends there, and a lost executor
    costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches cut into few rows each, so that what a worker makes of one is small however many rows a batch has."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
