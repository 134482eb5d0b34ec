"""Where the operators keep what must outlive an executor, and how large one Arrow batch may grow."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..runtime import discard, importable, shared_folder, written  # noqa: F401  (the operators take both from here)

#: Rows and bytes of one Arrow batch, so that a Python worker holds a few tens of MB whatever the length of a text.
BATCH_ROWS, BATCH_BYTES = 1_000, 6 << 20


def bounded_batches(spark: SparkSession) -> None:
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def released() -> None:
    """Gives the memory that a worker has freed back to the system: workers of one stage stay idle beside those of the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(f):
    """A function of batches that releases memory at its end."""

    def run(batches):
        yield from f(batches)
        released()

    return run


def in_blocks(df: DataFrame, size: Column, most: int) -> Iterator[list[Row]]:
    """The rows of df, collected in blocks of about `most` bytes by their cumulated size; a longer row is a block."""
    spark = df.sparkSession
    sized = df.withColumn("size__", F.coalesce(size.cast("bigint"), F.lit(0)) + 64)
    total = sized.agg(F.coalesce(F.sum("size__"), F.lit(0))).first()[0]
    if total <= most:
        yield df.collect()
        return

    names = [*df.columns, "block__"]

    def numbered(batches):
        held = 0
        base = TaskContext.get().partitionId() << 32
        for batch in batches:
            ends = held + np.cumsum(batch.column(batch.num_columns - 1).to_numpy())
            held = int(ends[-1]) if len(ends) else held
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(base + ends // most)], names)

    schema = StructType([*df.schema.fields, StructField("block__", LongType())])
    rows = written(sized.repartition(-(-total // most)).mapInArrow(numbered, schema), "blocks")
    for number in sorted(r[0] for r in rows.select("block__").distinct().collect()):
        yield rows.where(F.col("block__") == number).drop("block__").collect()
    discard(rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
